"""Shared spans against all windows of small texts."""

import random

import pytest

from mossgrid.llm import spans


def brute(rows, n):
    owner = {}
    for i, t in rows:
        for s in range(len(t or "") - n + 1):
            w = t[s : s + n]
            owner[w] = i if owner.get(w, i) == i else -1
    out = {}
    for i, t in dict(rows).items():
        end = total = 0
        for s in range(len(t or "") - n + 1):
            if owner[t[s : s + n]] == -1:
                total += s + n - max(s, end)
                end = s + n
        if total:
            out[i] = total
    return out


@pytest.mark.parametrize("group_rows", [4000, 2])
@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh é日😀"])
def test_random(spark, monkeypatch, group_rows, alphabet):
    monkeypatch.setattr(spans, "GROUP_ROWS", group_rows)
    r = random.Random(len(alphabet))
    text = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    parts = [text(r.randint(5, 60)) for _ in range(12)]
    rows = [(i, "".join(r.choice(parts) if r.random() < 0.4 else text(20) for _ in range(r.randint(0, 6)))) for i in range(60)]
    rows += [(100, rows[5][1] + "tail"), (101, rows[7][1]), (102, rows[7][1]), (103, None), (104, ""), (105, "a" * 300), (106, "a" * 90), rows[9]]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, id string")
    got = {x["doc_id"]: x["shared_chars"] for x in spans.shared_spans(df, length=20).collect()}
    assert got == brute(rows, 20)


def test_none(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    assert spans.shared_spans(df).count() == 0
    assert spans.shared_spans(df.limit(0)).count() == 0
