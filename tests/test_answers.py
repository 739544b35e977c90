"""Golden cases of the parsers."""

import pytest
from pyspark.sql import functions as F

from mossgrid.functions import answers, prompts, submission, tasks


def run(spark, f, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r["v"] for r in df.select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


CASES = {
    answers.choice: [("B. Normal", "B"), ("The answer is C", "C"), ("A benign lesion", "A"), ("(D)", "D"), ("F: other", "other"), ("B:", "B"), ("melanoma.", "melanoma"), ("", "")],
    answers.labels: [("['a', \"b\"]", ["a", "b"]), ("[a; b, c]", ["a", "b, c"]), ("a; b.", ["a", "b"]), ("a, b", ["a", "b"]), ("", [""])],
    answers.boxes: [
        ("[[1,2,3,4],[5,6,7,8]]", [[1, 2, 3, 4], [5, 6, 7, 8]]),
        ('{"1":[[0,0,10,10]],"2":[0,0,5,5]}', [[0, 0, 10, 10]]),
        ("{'1': [[0, 0, 10, 10]]}", [[0, 0, 10, 10]]),
        ("1.5, 2, 3, 4", [[5, 2, 3, 4]]),
        ("{}", []),
        ("none", []),
    ],
    answers.instances: [
        ('{"1":[[0,0,10,10]],"2":[0,0,5,5]}', {"1": [[0, 0, 10, 10]], "2": [[0, 0, 5, 5]]}),
        ("{'1': [[0, 0, 10, 10]]}", {}),
        ("[[1,2,3,4]]", {}),
        ("{}", {}),
    ],
    answers.count: [("The count is 12", 12), ("about 7", 7), ("between 20 and 35 cells", 35), ("approximately 5 or 90", 5), ("3 or 4", None), ("1. look 2. see", None), ("We need to count 40 cells", None)],
    answers.measure: [("12.5 mg", 12.5), ("value 3-5", 3.0), ("10-20%", -20.0), ("score 7 (95%)", 95.0), ("abc", None)],
    answers.cleaned: [
        ("user\nq\nassistant\nfirst\nassistant\n last ", "last"),
        ("Q Assistant: yes", "yes"),
        ("system\n be kind", "be kind"),
        ("so Answer: A or Answer: B ", "B"),
        ("plain", "plain"),
        (None, ""),
    ],
    submission.letter: [("B. Normal", "B"), ("a benign lesion", "a benign lesion"), ("F: other", "F"), ("I think B", "I"), (None, "")],
    submission.findings: [("- mass\n2. cyst left\nno", "mass; cyst left"), ("no", "no"), (None, "")],
    submission.box_list: [("x [1, 2,3,4] y [5,6,7,8]", "[1,2,3,4]; [5,6,7,8]"), ("none", "none")],
    submission.first_count: [("about 12 of 30", "12"), ("none", "0"), (None, "0")],
    submission.confidence: [("90% sure", 0.9), ("confidence: 0.4", 0.4), ("sure", None)],
}


@pytest.mark.parametrize("f", list(CASES), ids=lambda f: f.__name__)
def test_parsers(spark, f):
    given, expected = zip(*CASES[f], strict=True)
    assert run(spark, f, given) == list(expected)


def test_report_sections(spark):
    text = "Intro\nFindings: clear lungs\nok\nImpression:\nnormal\nSuggest:\nfollow up"
    (got,) = run(spark, submission.sections, [text])
    assert got.asDict() == {"findings": "Intro ok", "impression": "normal", "recommendations": "follow up"}
    (got,) = run(spark, submission.sections, ["Findings:"])
    assert got["findings"] == "Findings:"


def test_task_names(spark):
    rows = ["Classification", "Multi-label Classification", "Instance Detection", "Cell Counting", "cell_counting", "Regression", "Report Generation", None]
    assert run(spark, lambda c: tasks.route(tasks.task_name(c)), rows) == [
        "classification", "multi-label", "instance_detection", "counting", "counting", "regression", "report_generation", "classification",
    ]
    assert run(spark, tasks.submission_key, rows) == [
        "classification", "multi_label", "detection", "counting", "classification", "vqa", "report_generation", "classification",
    ]
    default = run(spark, lambda c: tasks.instruction(tasks.task_name(c)), ["Cell Counting"])
    assert default == [tasks.DEFAULT_INSTRUCTION]


def test_prompts(spark):
    df = spark.createDataFrame([(["a.png", "b.png"], " why? ", "so", [5, 6, 7, 0])], "images array<string>, q string, a string, ids array<int>")
    row = df.select(
        prompts.full_question(F.lit("report generation"), F.col("q"), training=True, n_images=F.lit(2)).alias("full"),
        prompts.messages(F.col("images"), F.col("q"), F.col("a")).alias("m"),
        prompts.assistant_start(prompts.flat_chat(F.lit(0), F.col("q"), F.col("a"))).alias("at"),
        F.length(prompts.flat_chat(F.lit(0), F.col("q"), F.col("a"))).alias("n"),
        prompts.masked_labels(F.col("ids"), F.lit(1), 0).alias("labels"),
        prompts.masked_labels(F.col("ids"), F.lit(9), 0).alias("hidden"),
        prompts.assistant_start(F.lit("none")).alias("none"),
    ).first()
    assert row["full"].endswith("\n\nwhy?") and "comprehensive" in row["full"]
    assert [len(m["content"]) for m in row["m"]] == [3, 1]
    assert row["n"] - row["at"] == len("so<|im_end|>")
    assert row["labels"] == [-100, 6, 7, -100] and row["hidden"] == [-100] * 4 and row["none"] == 4
