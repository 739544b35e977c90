"""Spans of periodic texts, hot boilerplate, repeated ids and colliding names."""

import random

import numpy as np
import pandas as pd
import pytest

from mossgrid.llm import spans
from tests.llm.test_spans import brute


def test_stretches_of_periodic_texts():
    for text in ("a" * 100_000, "ab " * 40_000):
        _, _, n, _ = spans.stretches([text], 200)
        assert len(n) < 200 and n.sum() == len(text) - 199


def test_periodic_texts(spark):
    rows = [(1, "a" * 100_000), (2, "b" + "a" * 5_000), (3, "ab " * 20_000), (4, "-" + "b a" * 100), (5, "c" * 1_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["shared_chars"] for x in spans.shared_spans(df).collect()}
    assert got == {1: 100_000, 2: 5_000, 3: 60_000, 4: 300}


@pytest.mark.parametrize("group_rows", [8_000, 3])
def test_hot_boilerplate(spark, monkeypatch, group_rows):
    monkeypatch.setattr(spans, "GROUP_ROWS", group_rows)
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdefghé") for _ in range(n))
    hot, line = text(90), "-" * 70
    rows = []
    for i in range(90):
        body = hot[r.randint(0, 60) if i % 7 == 0 else 0 : r.randint(60, 90) if i % 5 == 0 else 90]
        rows.append((i, text(r.randint(0, 30)) + (body if i % 3 else "") + text(r.randint(0, 30)) + (line[: r.randint(15, 70)] if i % 4 == 0 else "")))
    rows += [(i, rows[1][1]) for i in range(200, 240)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["shared_chars"] for x in spans.shared_spans(df, length=20).collect()}
    assert got == brute(rows, 20)


def test_repeated_ids(spark):
    a, b = "x" * 30 + "yz" * 20, "pq" * 25
    rows = [(1, a)] * 50 + [(1, b)] + [(2, b + "tail")] + [(3, "q" * 40)] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"]: x["shared_chars"] for x in spans.shared_spans(df, length=20).collect()} == {1: 50, 2: 50}


def test_colliding_names(monkeypatch):
    """With one name for all windows the characters alone decide."""
    monkeypatch.setattr(spans, "rolling", lambda codes, k: np.zeros(max(0, len(codes) - k + 1), np.uint64))
    pieces = ["abcdefgh", "bcdefghi", "zzzzzzzz", "zzzzzzzz"]
    frame = pd.DataFrame({"id": [1, 2, 3, 3], "v": 0, "begin": [0, 10, 0, 20], "n": 4, "prefix": 7, "piece": pieces})
    got = spans.shared_in_groups(frame, 5).values.tolist()
    assert got == [[1, 0, 1, 8], [2, 0, 10, 17]]
