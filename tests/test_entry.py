"""Entry points: evaluation with its files, the pipeline, the command line."""

import json
import os

import pytest

from mossgrid import __main__ as cli
from mossgrid.operators import entry
from mossgrid.operators import evaluation as E
from tests.test_preparation import tree  # noqa: F401

D = os.environ.get("MOSSGRID_TEST_DATA", "/root/testdata/sf0.001")


def table(spark, name):
    return spark.read.parquet(f"{D}/{name}.parquet")


def test_evaluate(spark, tmp_path):
    out = str(tmp_path)
    long = entry.evaluate(table(spark, "predictions"), table(spark, "questions"), out, tuned="lumen-7", base="orbis-small", save_predictions=True)
    got = {(r["model"], r["task"], r["metric"]): r["value"] for r in long.collect()}
    saved = json.loads((tmp_path / "lumen-7/evaluation_results.json").read_text())
    assert saved["detection"]["metrics"]["f1_score"] == got["lumen-7", "detection", "f1_score"]
    compared = json.loads((tmp_path / "model_comparison.json").read_text())
    assert compared["overall"]["total_tasks"] == len(compared["overall"]["details"]) == 7
    assert "Evaluation summary" in (tmp_path / "evaluation_summary.txt").read_text()
    assert "valid_samples" not in (tmp_path / "model_comparison.txt").read_text()
    n = table(spark, "predictions").where("model IN ('lumen-7', 'orbis-small')").count()
    assert spark.read.parquet(f"{out}/predictions").count() == n == saved["overall"]["num_examples"] + json.loads((tmp_path / "orbis-small/evaluation_results.json").read_text())["overall"]["num_examples"]


def test_one_task_and_defaults(spark, tmp_path):
    tables = table(spark, "predictions"), table(spark, "questions")
    long = entry.evaluate(*tables, str(tmp_path), tuned="lumen-7", task="counting", max_samples=3)
    assert {r["task"] for r in long.collect()} == {"counting"}
    assert json.loads((tmp_path / "lumen-7/evaluation_results.json").read_text())["counting"]["num_examples"] == 3
    with pytest.raises(ValueError):
        entry.evaluate(*tables, str(tmp_path), tuned="lumen-7", task="painting")
    full = {(r["task"], r["metric"]): r["value"] for r in E.with_no_pairs(long).collect()}
    assert full["regression", "mean_absolute_error"] == float("inf") and full["report_generation", "green_score"] == 0.0
    assert {t for t, _ in full} == set(E.NO_PAIRS)


def test_run(spark, tree):  # noqa: F811
    models = {"base": lambda b: ["A"] * len(b), "tuned": lambda b: ["12"] * len(b)}
    with pytest.raises(ValueError, match="issues"):
        entry.run(spark, str(tree / "base"), str(tree / "work"), models)
    long = entry.run(spark, str(tree / "base"), str(tree / "work"), models, skip_validation=True)
    got = {(r["model"], r["metric"]): r["value"] for r in long.collect()}
    assert got["base", "accuracy"] == 0.0 and got["tuned", "accuracy"] == 1.0
    assert json.loads((tree / "work/evaluation/model_comparison.json").read_text())["overall"]["improved_tasks"] == 1
    assert entry.run(spark, str(tree / "base"), str(tree / "work"), models, skip_validation=True, skip_prepare=True, skip_eval=True) is None


def test_command_line(spark, tree, capsys):  # noqa: F811
    base = str(tree / "base")
    assert cli.main(["validate", "--base_dir", base, "--report", str(tree / "report.txt")]) == 1
    assert "issues" in capsys.readouterr().out and "retino" in (tree / "report.txt").read_text()
    assert cli.main(["prepare", "--base_dir", base, "--output_dir", str(tree / "out")]) == 0
    assert "'train': 2" in capsys.readouterr().out
    files = [x for name in ("predictions", "references") for x in (f"--{name}", f"{D}/{'questions' if name == 'references' else name}.parquet")]
    assert cli.main(["evaluate", *files, "--tuned", "lumen-7", "--task_type", "detection", "--output_dir", str(tree / "eval")]) == 0
    assert "f1_score" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["paint"])
