"""Hostile answers, failing rows and real images."""

import base64
import json

import pytest

from mossgrid.functions import answers
from mossgrid.operators import preparation as P
from mossgrid.operators import submit
from mossgrid.sources import question_files as Q
from tests.test_answers import run
from tests.test_preparation import tree  # noqa: F401

#: A PNG of one grey pixel.
PIXEL = base64.b64decode("iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAAAAAA6fptVAAAACklEQVR4nGNoAAAAggCBd81ytgAAAABJRU5ErkJggg==")


def test_boxes(spark):
    rows = ['{"1": [[1e30,2,3,4],[1,2,3,4]]}', '{"1": [[1,1,1,1]], "2": [[2,2,2,2]], "1": [[3,3,3,3]]}', '{"1": "x", "2": null, "3": [[1,2,3]]}', '{"1": [[1.9,2,3,4]]}', "{'1': [[1,2,3,4]]}"]
    assert run(spark, answers.boxes, rows) == [[[1, 2, 3, 4]], [[3, 3, 3, 3], [2, 2, 2, 2]], [], [[1, 2, 3, 4]], [[1, 2, 3, 4]]]
    assert run(spark, answers.instances, rows) == [
        {"1": [[1, 2, 3, 4]]}, {"1": [[3, 3, 3, 3]], "2": [[2, 2, 2, 2]]}, {}, {"1": [[1, 2, 3, 4]]}, {},
    ]
    assert run(spark, answers.instances, ['{"1": [1e30,2,3,4]}', '{"1": [1,2,3,4], "1": 5}']) == [{"1": []}, {}]


def test_one_failing_row(spark):
    def picky(batch):
        if (batch["q"] == "bad").any():
            raise RuntimeError("model")
        return [q.upper() for q in batch["q"]]

    df = spark.createDataFrame([(i, "bad" if i == 3 else f"q{i}") for i in range(20)], "i int, q string").coalesce(1)
    got = {r["i"]: r["output"] for r in submit.with_outputs(df, picky).collect()}
    assert got == {i: None if i == 3 else f"Q{i}" for i in range(20)}
    short = submit.with_outputs(df, lambda b: ["x"] if len(b) > 1 else ["y"])
    assert {r["output"] for r in short.collect()} == {"y"}


def test_parts(spark, tree):  # noqa: F811
    base, said = str(tree / "base/validation-hidden"), lambda b: ["B"] * len(b)
    submit.submit(spark, base, said, str(tree / "parts"))
    assert [json.loads(r["value"])["Answer"] for r in spark.read.text(str(tree / "parts")).collect()] == ["B"]
    (tree / "none/x").mkdir(parents=True)
    (tree / "none/x/y.txt").write_text("")
    submit.submit(spark, str(tree / "none"), said, str(tree / "none.json"))
    assert json.loads((tree / "none.json").read_text()) == []


def test_decoded_images(spark, tmp_path):
    for name, data in (("a/good.png", PIXEL), ("a/cut.PNG", PIXEL[:40]), ("b/none.jpg", b"no image"), ("b/x.txt", PIXEL)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    ok = lambda **k: {r["path"].rsplit("/", 1)[1]: r["ok"] for r in Q.checked_images(spark, str(tmp_path), **k).collect()}
    assert ok() == {"good.png": True, "cut.PNG": True, "none.jpg": False}
    assert ok(decode=True) == {"good.png": True, "cut.PNG": False, "none.jpg": False}


def test_prepare_decodes(spark, tree):  # noqa: F811
    with pytest.raises(ValueError):
        P.prepare(spark, str(tree / "base"), str(tree / "out"), decode=True)
    (tree / "base/training/Retinography/retino/imagesTr/a.png").write_bytes(PIXEL)
    assert P.prepare(spark, str(tree / "base"), str(tree / "out"), decode=True).count() == 1
    assert P.saved_counts(spark, str(tree / "out")) == {"train": 2, "validation": 0, "test": 0}


def test_issues(spark):
    issues = spark.createDataFrame([(f"issue {i:02}",) for i in range(30)], "issue string")
    lines = P.shown_issues(issues)
    assert lines[0] == "30 issues" and len(lines) == 11 and lines[1].endswith("issue 00")
    assert Q.registry(spark, Q.TRIAL).count() == 3
