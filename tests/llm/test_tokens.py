"""Fragments give the ids of whole texts; mixtures keep their bounds."""

import random

import pytest

from mossgrid.llm.mixture import budgets, exponent_for_entropy, mix_sources, powered
from mossgrid.llm.tokens import TOKENIZER, Encoder, encode, inner_pairs

tokenizers = pytest.importorskip("tokenizers")
BITS = [" ", "  ", "\n", "\t", "\r\n", " ", "　", "\x0b", "\x85", "'s", "'", "é", "à", "€", "日本", "​", "a", "B", "12", ".", "!!", "<|endoftext|>", "😀", "́", "\x1c"]


@pytest.fixture(scope="module")
def whole():
    t = tokenizers.Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return t


def test_random_texts(whole):
    r = random.Random(7)
    texts = ["".join(r.choice(BITS) for _ in range(r.randint(0, 40))) for _ in range(5000)]
    got = [[i for f in parts for i in f] for parts in Encoder(open(TOKENIZER, encoding="utf-8").read()).batch(texts)]
    assert got == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_inner_pairs():
    assert inner_pairs(["ab", "Ġa"]) == {(97, 98), (32, 97)}


def test_encode(spark, whole):
    texts = [None, "", " ", "a b\n", "word " * 50_000, "x" * 100_000]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate([*texts, "a b\n"])], "doc_id long, text string, ids array<int>")
    got = {r["doc_id"]: r["ids"] for r in encode(df).collect()}
    assert got == {i: whole.encode(t or "").ids for i, t in enumerate([*texts, "a b\n"])}
    assert encode(df.limit(0)).count() == 0


def test_weights():
    assert powered([0.5, 0.5, 0], 0.3) == [0.5, 0.5, 0.0]
    assert exponent_for_entropy([0.9, 0.1], 5.0) == 0.0
    e = exponent_for_entropy([0.9, 0.1], 0.5)
    assert 0 < e < 1
    rows = budgets([{"permille": 500, "tokens": 10, "max_repeats": 1}, {"permille": 500, "tokens": 100, "max_repeats": 2}, {"permille": 0, "tokens": 5, "max_repeats": 1}], 100)
    assert [r["short"] for r in rows] == [True, False, False] and sum(r["budget"] for r in rows) == 100
    assert all(r["budget"] <= r["capacity"] for r in rows)


def test_mixture(spark):
    rows = [(i, "big", "word " * 20) for i in range(200)] + [(1000 + i, "small", "word " * 20) for i in range(10)] + [(2000 + i, None, "word " * 20) for i in range(50)]
    rows += [(3000, "big", None), (3001, "big", ""), (3002, "tiny", "a")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("big", 600, 2), ("small", 200, 3), ("tiny", 100, 5), ("none", 100, 5)], "source string, target_permille int, max_repeats int")
    mixture, report = mix_sources(df, targets)
    got = {r["source"]: r for r in report.collect()}
    assert {s for s, r in got.items() if r["short"]} == {"tiny", "none"}
    assert got["small"]["passes"] <= 3 and got["tiny"]["drawn"] == 5 * got["tiny"]["tokens"]
    drawn = sum(r["drawn"] for r in got.values())
    assert abs(drawn - sum(r["wanted"] for r in got.values())) < 60
    per = {(r["doc_id"], r["pass"]) for r in mixture.collect()}
    assert len(per) == mixture.count()
    assert mix_sources(df.limit(0), targets)[0].count() == 0
