"""Formatting duplicates: what counts and what doesn't."""

import json

from mossgrid.llm.canonical import collapsed_records, formatting_duplicates

BASE = {"TaskType": "Detection", "Modality": "X-ray", "ImageName": "imagesTr/a_1.png", "Question": "How many, 3.5 or -2?", "Answer": "[[1,23]]"}


def line(**changes):
    return json.dumps(BASE | changes)


def groups(spark, lines):
    df = spark.createDataFrame([(i, x, "f", "d", 0) for i, x in enumerate(lines)], "raw_id long, record string, line string, digest string, n int")
    found = {}
    for r in formatting_duplicates(df).collect():
        found.setdefault(r["first_id"], set()).add(r["raw_id"])
    return found


def test_equal(spark):
    lines = [
        line(),
        json.dumps(dict(reversed(BASE.items())), indent=1),
        line(Question="HOW MANY 3.5  or: -2"),
        line(ImageName=["./imagesTr//A_1.png "], Answer=" [[1, 23]]"),
        line(ImageName="imagesTr\\a_1.png", TaskType="detection"),
        line(),
    ]
    assert groups(spark, lines) == {0: {1, 2, 3, 4, 5}}
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "raw_id long, record string")
    assert [tuple(r) for r in collapsed_records(df).collect()] == [(0, 6, 5)]


def test_unequal(spark):
    missing = {k: v for k, v in BASE.items() if k != "Modality"}
    lines = [
        line(), line(Question="How many, 35 or -2?"), line(Question="How many, 3.5 or 2?"), line(Answer="[[12,3]]"), line(Modality=None),
        json.dumps(missing), line(ImageName="a_1.png"), line(ImageName=["imagesTr/a_1.png", "b_1.png"]), line(Modality=""), line(Question="Hów many, 3.5 or -2?"),
    ]
    assert groups(spark, lines) == {}


def test_odd_lines(spark):
    lines = [None, "", "{", line()[:40], "[1]", "3", line()[:40], "{}", "{ }", line(Question="x" * 200_000), line(Question="X" * 200_000), '"a"', '"a"']
    assert groups(spark, lines) == {7: {8}, 9: {10}}
    assert groups(spark, []) == {}
