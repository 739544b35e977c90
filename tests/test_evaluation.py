"""Matching, metrics, report scores and comparison against golden values and plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from mossgrid.functions import geometry, lexicon, reports
from mossgrid.operators import evaluation as E


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w < 0 or h < 0:
        return 0.0
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def greedy(pred, ref, t, inclusive):
    used = set()
    for p in pred:
        best, at = 0, -1
        for k, r in enumerate(ref):
            if k not in used and iou(p, r) > best:
                best, at = iou(p, r), k
        if at >= 0 and (best >= t if inclusive else best > t):
            used.add(at)
    return len(used)


@pytest.mark.parametrize("t,inclusive", [(0.3, False), (0.5, False), (0.3, True)])
def test_greedy_matching_equals_a_loop(spark, t, inclusive):
    random.seed(5)
    box = lambda: [x := random.randint(0, 8), y := random.randint(0, 8), x + random.randint(0, 8), y + random.randint(0, 8)]
    rows = [(i, [box() for _ in range(random.randint(0, 5))], [box() for _ in range(random.randint(0, 5))]) for i in range(200)]
    rows.append((200, [[2, 0, 12, 10], [3, 0, 13, 10]], [[3, 0, 13, 10], [0, 0, 9, 10]]))
    df = spark.createDataFrame(rows, "i int, p array<array<bigint>>, r array<array<bigint>>")
    got = {r["i"]: r["n"] for r in df.select("i", geometry.matched(F.col("p"), F.col("r"), F.lit(t), inclusive=inclusive).alias("n")).collect()}
    assert got == {i: greedy(p, r, t, inclusive) for i, p, r in rows}


def test_overlap(spark):
    cases = [([0, 0, 10, 10], [0, 0, 8, 8], 0.64), ([0, 0, 10, 10], [10, 0, 20, 10], 0.0), ([5, 5, 5, 5], [5, 5, 5, 5], 0.0)]
    df = spark.createDataFrame(cases, "a array<bigint>, b array<bigint>, e double")
    assert all(abs(r["v"] - r["e"]) < 1e-9 for r in df.select("e", geometry.overlap(F.col("a"), F.col("b")).alias("v")).collect())


def test_bleu(spark):
    cases = {
        "same": (["a b c d"], ["a b c d"], 1.0),
        "short": (["a b c"], ["a b c"], 0.0),
        "last": (["a b c d e"], ["a b c d f"], 0.66874),
        "two": (["a b c d", "x"], ["a b c d", "x"], 0.594604),
        "brief": (["a b c d"], ["a b c d e f g h"], 0.367879),
        "twice": (["a a a a a"], ["a a a a b"], None),
    }
    rows = [(k, i, p, r) for k, (ps, rs, _) in cases.items() for i, (p, r) in enumerate(zip(ps, rs, strict=True))]
    df = spark.createDataFrame(rows, "k string, pred_id int, p string, r string")
    got = {r["k"]: r["bleu_score"] for r in E.bleu(df, ["k"], "pred_id", "p", "r").collect()}
    for k, (_, _, e) in cases.items():
        if e is not None:
            assert got[k] == pytest.approx(e, abs=1e-5)
    assert got["twice"] == pytest.approx((4 / 5 * 3 / 4 * 2 / 3 * 1 / 2) ** 0.25)


def test_efficacy(spark):
    cases = {"Acute fracture": "critical", "No acute findings": "normal", "abnormal density": "abnormal", "possible mass": "uncertain",
             "No disease. Severe edema": "normal", "not severe. severe later": "normal", "": "normal"}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r["x"]: r["c"] for r in df.select("x", reports.efficacy_category("x").alias("c")).collect()} == cases


def test_report_scores(spark):
    rows = [("hello", "hello", 0.90), ("", "", 0.885), ("No acute findings", "No acute findings", 0.99), (None, None, 0.885)]
    df = spark.createDataFrame(rows, "g string, r string, e double")
    for r in reports.scored(df, "g", "r").collect():
        assert r["overall"] == pytest.approx(r["e"], abs=1e-9)


def test_mentions_equal_a_scan(spark):
    import re

    text = "Fluid, pulmonary edema and edema; no fluid. Likely 3 x 4 cm nodule, large mass without effusion " * 3
    df = spark.createDataFrame([(text.lower(),)], "x string")
    got = [(m["kind"], m["term"], m["start"], m["denied"], m["size"]) for m in df.select(reports.mentions("x").alias("m")).first()["m"]]
    low, want = text.lower(), []
    negated = re.compile(r"\b(" + "|".join(lexicon.NEGATIONS) + r")\b")
    for kind, terms, _, _ in lexicon.FINDINGS:
        for term in terms:
            for hit in re.finditer(rf"\b{re.escape(term)}\b", low):
                context = low[max(0, hit.start() - 50) : hit.end() + 50]
                sizes = [s for p in lexicon.SIZES if (s := re.search(p, context))]
                want.append((kind, term, hit.start(), bool(negated.search(low[max(0, hit.start() - 50) : hit.start()])), sizes[0][0] if sizes else None))
    assert got == want


def test_classification(spark):
    rows = [("m", "a", "A"), ("m", "A", "a"), ("m", "B ", "b"), ("m", "B", "c  d"), ("m", "C", "a"), ("m", None, None)]
    df = spark.createDataFrame(rows, "model string, r_label string, p_label string")
    got = {r["metric"]: r["value"] for r in E.classification(df, ["model"]).collect()}
    assert got["accuracy"] == pytest.approx(4 / 6) and got["valid_samples"] == 6
    assert got["balanced_accuracy"] == pytest.approx((1 + 0.5 + 0 + 1) / 4)
    assert got["f1_score"] == pytest.approx((2 * (4 / 5) + 2 * (2 / 3) + 0 + 1) / 6)


def test_multi_label(spark):
    rows = [("m", ["a", "b"], ["b", "c"]), ("m", ["x"], [""]), ("m", ["A"], ["a"])]
    df = spark.createDataFrame(rows, "model string, p_labels array<string>, r_labels array<string>")
    got = {r["metric"]: r["value"] for r in E.multi_label(df, ["model"]).collect()}
    assert got["f1_score"] == pytest.approx(0.25) and got["valid_samples"] == 2


def test_number_errors(spark):
    rows = [("m", 1.0, 3.0, True), ("m", 2.0, 2.0, True), ("m", None, 2.0, False), ("n", None, 1.0, False), ("z", float("nan"), 1.0, True)]
    df = spark.createDataFrame(rows, "model string, p_number double, r_number double, valid boolean")
    got = {(r["model"], r["metric"]): r["value"] for r in E.number_errors(df, ["model"]).collect()}
    assert got["m", "mean_absolute_error"] == 1.0 and got["m", "root_mean_squared_error"] == pytest.approx(math.sqrt(2))
    assert got["n", "mean_absolute_error"] == math.inf and ("n", "root_mean_squared_error") not in got
    assert got["z", "mean_absolute_error"] == math.inf and got["z", "valid_samples"] == 0


def test_instances(spark):
    a, b = [0, 0, 10, 10], [0, 0, 10, 3]
    rows = [(1, "m", {"1": [a], "2": [b]}, {"1": [b], "3": [a]})]
    df = spark.createDataFrame(rows, "pred_id int, model string, p_inst map<string,array<array<bigint>>>, r_inst map<string,array<array<bigint>>>")
    swept = {r["threshold"]: (r["tp"], r["fp"], r["fn"]) for r in E.instance_sweep(df, ["model"]).collect()}
    assert swept[0.3] == (0, 2, 2)  # exactly 0.3 is no match in the sweep
    names = {r["inst"]: (r["tp"], r["fp"], r["fn"]) for r in E.instance_names(df, ["model"]).collect()}
    assert names == {"1": (1, 0, 0), "2": (0, 1, 0), "3": (0, 0, 1)}


def test_comparison(spark):
    inf = float("inf")
    base = spark.createDataFrame([("detection", "f1_score", 0.0), ("classification", "accuracy", 0.5), ("counting", "mean_absolute_error", 4.0), ("regression", "mean_absolute_error", inf)], "task string, metric string, value double")
    tuned = spark.createDataFrame([("detection", "f1_score", 0.5399), ("classification", "accuracy", 0.75), ("counting", "mean_absolute_error", 2.0), ("regression", "mean_absolute_error", inf)], "task string, metric string, value double")
    got = {r["task"]: r for r in E.compare(base, tuned).collect()}
    assert got["detection"]["improvement"] and got["detection"]["improvement_magnitude_percent"] == pytest.approx(53.99)
    assert got["detection"]["relative_diff_percent"] is None
    assert got["classification"]["improvement_magnitude_percent"] == 50.0
    assert got["counting"]["improvement"] and got["counting"]["relative_diff_percent"] == -50.0
    assert not got["regression"]["improvement"] and got["regression"]["improvement_magnitude_percent"] == inf
    roll = E.comparison_rollup(E.compare(base, tuned)).first()
    assert (roll["improved_tasks"], roll["total_tasks"]) == (2, 3)
    same = E.compare(base, base).where("task <> 'regression'").collect()
    assert all(r["absolute_diff"] == 0 and not r["improvement"] for r in same)
    assert E.comparison_lines(E.compare(base, tuned)).count() == 4
    with pytest.raises(KeyError):
        E.compare(base, tuned.where("task <> 'counting'"))
