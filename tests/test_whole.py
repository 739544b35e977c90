"""Results that were partial once: every box, order, image and row of a bounded table."""

import math
import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mossgrid.operators import evaluation as E
from mossgrid.plans.queries import QUERIES, values
from tests.test_evaluation import iou

D = os.environ.get("MOSSGRID_TEST_DATA", "/root/testdata/sf0.001")


def test_every_pair_of_boxes(spark):
    boxes = {1: ([[0, 0, 4, 4], [2, 2, 6, 6], [9, 9, 9, 9]], [[2, 2, 6, 6], [0, 0, 2, 4]]), 2: ([], [[0, 0, 1, 1]]), 3: ([[1, 2, 3]], [[1, 2, 3, 4]])}
    df = spark.createDataFrame([(i, p, r) for i, (p, r) in boxes.items()], "pred_id long, p_boxes array<array<bigint>>, r_boxes array<array<bigint>>")
    got = {(r["pred_id"], r["p_pos"], r["r_pos"]): r["iou"] for r in E.box_pairs(df).collect()}
    assert got.pop((3, 0, 0)) is None
    want = {(1, i, k): iou(p, r) for i, p in enumerate(boxes[1][0]) for k, r in enumerate(boxes[1][1])}
    assert set(got) == set(want) and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_query_has_later_boxes(spark):
    rows = QUERIES["iou_all_pairs"](spark, D).collect()
    n = values(spark, D, "detection").agg(F.sum(F.size("p_boxes") * F.size("r_boxes"))).first()[0]
    assert len(rows) == n and any(r["p_pos"] > 0 for r in rows)
    first = {(r["pred_id"], r["r_pos"], r["iou"]) for r in rows if r["p_pos"] == 0 and r["iou"]}
    assert first == {(r["pred_id"], r["pos"], r["iou"]) for r in QUERIES["iou_pairs"](spark, D).collect()}


def test_bleu_of_four_orders(spark):
    def score(texts):
        means = [0.0] * 4
        for p, r in texts:
            for n in range(4):
                count = lambda x: Counter(tuple(x[i : i + n + 1]) for i in range(len(x) - n))  # noqa: B023, E731
                a, b = count(p), count(r)
                means[n] += sum((a & b).values()) / max(1, sum(a.values())) / len(texts)
        lp, lr = sum(len(p) for p, _ in texts), sum(len(r) for _, r in texts)
        brevity = 1.0 if lp > lr else math.exp(1 - lr / lp) if lp else 0.0
        return brevity * math.exp(sum(map(math.log, means)) / 4) if all(means) else 0.0

    texts = defaultdict(list)
    for r in values(spark, D, "report_generation").collect():
        texts[r["model"]].append(tuple((r[c] or "").lower().split() for c in ("p_text", "r_text")))
    got = {r["model"]: r["bleu_score"] for r in QUERIES["bleu_4"](spark, D).collect()}
    assert got == pytest.approx({m: score(t) for m, t in texts.items()}, abs=2e-6)
    long = QUERIES["task_metrics"](spark, D).where("metric = 'bleu_score'").collect()
    assert got == pytest.approx({r["model"]: r["value"] for r in long}, abs=2e-6)


def test_every_image_of_a_list(spark, tmp_path):
    d = str(tmp_path)
    rows = [(1, "k", '["a/x_1.png", "b/y_1.png", "gone.png"]'), (2, "k", "z_1.png"), (3, "k", None)]
    spark.createDataFrame(rows, "rec_id long, dataset string, ImageName string").write.parquet(f"{d}/questions.parquet")
    files = [("k/b/y_1.png", "k"), ("k/c/x_1.png", "k"), ("k/a/y_1.png", "k"), ("k/c/z_1.png", "k"), ("other/gone.png", "other")]
    spark.createDataFrame(files, "path string, dataset string").write.parquet(f"{d}/image_files.parquet")
    got = {(r["rec_id"], r["place"]): r["image"] for r in QUERIES["path_resolve_each"](spark, d).collect()}
    assert got == {(1, 0): "k/c/x_1.png", (1, 1): "k/b/y_1.png", (1, 2): None, (2, 0): "k/c/z_1.png"}
    assert {r["rec_id"]: r["image"] for r in QUERIES["path_resolve"](spark, d).collect()} == {i: v for (i, k), v in got.items() if k == 0}
