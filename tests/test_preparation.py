"""Preparation, validation and submission on a small tree of files."""

import json

import pytest

from mossgrid.operators import preparation as P
from mossgrid.operators import submit
from mossgrid.sources import question_files as Q

PNG = bytes.fromhex("89504E470D0A1A0A") + b"rest"


@pytest.fixture()
def tree(tmp_path):
    def put(path, data):
        f = tmp_path / "base" / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(data if isinstance(data, bytes) else json.dumps(data).encode())

    q = lambda name, image, **more: {"Question": name, "Answer": "A", "TaskType": "Classification", "Modality": "Xray", "ImageName": image} | more
    put("training/Retinography/retino/imagesTr/a.png", PNG)
    put("training/Retinography/retino/imagesTr/bad.png", b"no image")
    put("training/Retinography/retino/retino_questions_train.json", [q("one", "imagesTr/a.png"), q("two", ["a.png", "bad.png"]), q("three", "missing.png"), q("four", "bad.png")])
    put("validation-hidden/Retinography/retino/imagesVal/v.png", PNG)
    put("validation-hidden/Retinography/retino/retino_questions_val.json", [q("plain", "v.png")])
    put("validation-hidden/Retinography/retino/retino_questions_val_withGT.json", [q("answered", "imagesVal/v.png", Answer=12)])
    put("validation-hidden/Xray/dental/imagesVal/d.png", PNG)
    put("validation-public/Xray/dental/imagesVal/d.png", PNG)
    put("validation-public/Xray/dental/dental_questions_val.json", [q("shadowed", "d.png")])
    put("validation-public/Xray/chestdr/imagesVal/c.png", PNG)
    put("validation-public/Xray/chestdr/chestdr_questions_val.json", b"{broken")
    return tmp_path


def test_prepare(spark, tree):
    stats = {r["dataset"]: (r["train"], r["val"], r["test"]) for r in P.prepare(spark, str(tree / "base"), str(tree / "out")).collect()}
    assert stats == {"retino": (2, 1, 0)}
    rows = {r["question"]: r for r in spark.read.parquet(str(tree / "out/train")).collect()}
    assert rows["two"]["num_images"] == 1 and rows["one"]["images"][0].endswith("imagesTr/a.png")
    assert spark.read.parquet(str(tree / "out/validation")).first()["answer"] == "12"
    info = json.loads((tree / "out/dataset_info.json").read_text())
    assert info["train_samples"] == 2 and info["task_type_distribution"] == {"Classification": 2}
    with pytest.raises(ValueError):
        P.prepare(spark, str(tree / "base"), str(tree / "none"), datasets=["dental"])


def test_validate(spark, tree):
    ok, issues = P.validate(spark, str(tree / "base"), check_images=True)
    found = sorted(r["issue"].split(":")[0] for r in issues.collect())
    assert not ok
    assert sum(i.startswith("Missing question file") for i in found) == 1  # the hidden dental folder has none
    assert sum(i.startswith("Error reading") for i in found) == 1 and sum(i.startswith("Corrupted image") for i in found) == 1
    assert "Total datasets" in P.validation_report(spark, str(tree / "base"))
    (tree / "empty/x").mkdir(parents=True)
    (tree / "empty/x/y.txt").write_text("")
    assert not P.validate(spark, str(tree / "empty"))[0]


def test_submit(spark, tree):
    out = str(tree / "predictions.json")
    counts = {r["TaskType"]: r["n"] for r in submit.submit(spark, str(tree / "base/validation-hidden"), lambda b: ["The answer: B"] * len(b), out).collect()}
    assert counts == {"Classification": 1}
    assert [r["Answer"] for r in json.loads(open(out).read())] == ["B"]

    def fails(batch):
        raise RuntimeError("model")

    submit.submit(spark, str(tree / "base/validation-hidden"), fails, out)
    assert [r["Answer"] for r in json.loads(open(out).read())] == [""]


def test_registry(spark):
    assert Q.registry(spark).count() == 19 and Q.registry(spark, ["dental"]).count() == 1
