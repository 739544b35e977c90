"""Result files and the small training helpers."""

import json

from pyspark.sql import functions as F

from mossgrid.functions import prompts
from mossgrid.operators import evaluation as E
from mossgrid.operators import preparation as P
from mossgrid.sources import results


def test_files(spark, tmp_path):
    inf = float("inf")
    metrics = spark.createDataFrame([("b", "counting", "mean_absolute_error", inf), ("b", "detection", "f1_score", 0.25), ("t", "counting", "mean_absolute_error", 2.0), ("t", "detection", "f1_score", 0.5)], "model string, task string, metric string, value double")
    counts = spark.createDataFrame([("b", "counting", 3, 0, 3), ("b", "detection", 2, 2, 0), ("b", "overall", 5, 2, 3)], "model string, task string, num_examples long, valid_examples long, skipped_examples long")
    results.write_results(metrics, counts, "b", str(tmp_path / "r.json"))
    got = json.loads((tmp_path / "r.json").read_text())
    assert got["counting"]["metrics"] == {"mean_absolute_error": "Infinity"} and got["overall"]["skipped_examples"] == 3
    compared = E.compare(metrics.where("model = 'b'").drop("model"), metrics.where("model = 't'").drop("model"))
    results.write_comparison(compared, E.comparison_rollup(compared), str(tmp_path / "c.json"))
    got = json.loads((tmp_path / "c.json").read_text())
    assert got["overall"]["improved_tasks"] == 2 and got["tasks"]["detection"]["f1_score"]["improvement_magnitude_percent"] == 100.0
    assert "f1_score: 0.2500" in results.summary_text(metrics, counts)
    text = results.comparison_text(compared)
    assert "* mean_absolute_error: inf -> 2.0000 (up inf)" in text and "* f1_score: 0.2500 -> 0.5000 (up 100.0%)" in text


def test_helpers(spark):
    df = spark.createDataFrame([(1, 2, ["c"], 4.0), (1, 1, ["a", "b"], 2.0), (2, 1, [], 1.0)], "b int, o int, images array<string>, s double")
    got = {r["b"]: (r["images"], r["counts"]) for r in P.batched_images(df, "b", "o").collect()}
    assert got == {1: (["a", "b", "c"], [2, 1]), 2: ([], [0])}
    means = {(r["b"], r["o"]): r["mean"] for r in P.running_mean(df, "o", "s", ["b"]).collect()}
    assert means[1, 2] == 3.0
    files = spark.createDataFrame([("a",), ("c",)], "path string")
    assert [r["path"] for r in P.missing_images(df, files).collect()] == ["b"]
    row = df.select(prompts.hit_rate(F.lit(3), F.lit(1)).alias("h"), prompts.image_tokens(F.array(F.lit(7), F.lit(1), F.lit(7)), 7).alias("n")).first()
    assert (row["h"], row["n"]) == (0.75, 2)
