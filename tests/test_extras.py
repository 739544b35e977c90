"""Labels of boxes, versions of instance metrics, batch checks, metrics of two classes."""

from pyspark.sql import functions as F

from mossgrid.functions import prompts, submission
from mossgrid.operators import evaluation as E
from tests.test_answers import run


def test_labelled_boxes(spark):
    rows = ["A mass: [1, 2,3,4], small cyst [5,6,7,8] [1,1,2,2]", None, "none"]
    got = [[(b["label"], b["box"]) for b in r] for r in run(spark, submission.labelled_boxes, rows)]
    assert got == [[("A mass", [1, 2, 3, 4]), ("small cyst", [5, 6, 7, 8]), ("abnormality", [1, 1, 2, 2])], [], []]


def test_instance_versions(spark):
    good, odd = [[0, 0, 10, 10]], [[0, 0, 10, 10], [1, 2, 3]]
    rows = [(1, "a", {"1": good}, {"1": good, "2": odd}), (2, "b", {"1": odd}, {"1": good})]
    df = spark.createDataFrame(rows, "pred_id int, model string, p_inst map<string,array<array<bigint>>>, r_inst map<string,array<array<bigint>>>")
    assert {r["model"]: r["metrics_version"] for r in E.instance_versions(df, ["model"]).collect()} == {"a": "v2", "b": "v1_original_only"}
    names = lambda m, **k: {r["metric"] for r in E.instance_detection(df, ["model"], **k).where(F.col("model") == m).collect()}
    assert names("b", compat_versions=True) == {"f1_score", "precision", "recall", "valid_samples"}
    assert names("a", compat_versions=True) == names("a") == names("b") and "average_f1" in names("a")


def test_two_classes(spark):
    rows = [("m", "a", "a"), ("m", "b", "a"), ("n", "a", "a"), ("n", "b", "b"), ("n", "c", "a")]
    df = spark.createDataFrame(rows, "model string, r_label string, p_label string")
    got = {(r["model"], r["metric"]): r["value"] for r in E.classification(df, ["model"], compat_binary=True).collect()}
    assert {v for (m, _), v in got.items() if m == "m"} == {0.0} and got["n", "accuracy"] > 0.6


def test_batches(spark):
    df = spark.createDataFrame([([7, 1, 7], 2, 2, 1, 4), (None, 1, 2, 0, 0)], "ids array<int>, i int, t int, e int, n int")
    got = df.select(prompts.batch_check(F.col("ids"), F.col("i"), F.col("t"), 7).alias("c"), prompts.error_rate(F.col("e"), F.col("n")).alias("r")).collect()
    assert [(r["c"]["no_ids"], r["c"]["mismatch"], r["c"]["image_tokens"], r["r"]) for r in got] == [(False, False, 2, 25.0), (True, True, 0, None)]


def test_assistant_marks(spark):
    rows = ["<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\nyes", "<|im_start|>assistant yes", "user\nq\nassistant\nyes", "Q assistant: yes", "plain"]
    assert [r[n:] for r, n in zip(rows, run(spark, prompts.assistant_start, rows), strict=True)] == ["yes", " yes", "yes", " yes", ""]


def test_branches_that_tables_lack(spark):
    from mossgrid.functions import answers

    assert run(spark, answers.cleaned, ["system\nkind\nuser\nq\nassistant\nyes", "user\n Answer: 3 ", "SYSTEM\nx", "assistant:\n a Assistant: b"]) == ["yes", "3", "SYSTEM\nx", "b"]
    assert run(spark, answers.count, ["step 12 of 40", "procedure 30 then 25", "1. 15 cells", "Total of: 9", "2e1"]) == [40, 25, 5, 9, 20]
    assert run(spark, answers.boxes, ['{"a": [[1,2,3,4],[5,6,7]], "b": [9,9,9,9]}', "[ [1 ,2,3,4] ] and [[5,6,7,8]]", "1,2,3,4,5,6,7,8"]) == [
        [[1, 2, 3, 4]], [[1, 2, 3, 4], [5, 6, 7, 8]], [[1, 2, 3, 4], [5, 6, 7, 8]],
    ]
