"""Kinds of defects on made-up pairs."""

import pytest

from mossgrid.llm.pairs import DefectFinder, SuffixAutomaton, broken_pairs

TERMS = ["cyst", "cyst, complex", "ground-glass opacity", "pleural thickening"]
STEM = "Which finding is best supported by this image of the neck in the second pass?"
CHOICE = STEM + "\nA. left nodule\nB. cannot be assessed"
LIST = "List every finding visible on this image of the neck, second pass."
BOX = "Locate each nodule in the neck and give the boxes as corner coordinates."
REPORT = "Describe the neck on this image as a short report. Comment on the septa."

CASES = [
    ("classification", CHOICE, "A", None), ("classification", CHOICE, "(B)", None), ("classification", CHOICE, "cannot be assessed", None),
    ("classification", CHOICE, "B: cannot be assessed", None), ("classification", CHOICE, "The answer is A: left nodule.", None),
    ("classification", CHOICE, "The answer is A: left nod", "truncated"), ("classification", CHOICE, "Looking at the neck, the most likely option is", "truncated"),
    ("classification", CHOICE, STEM, "copied_question"), ("classification", CHOICE, CHOICE.upper(), "copied_question"),
    ("classification", CHOICE, STEM + " Answer: A", None), ("classification", CHOICE, STEM + "\n-> A", None), ("classification", CHOICE, STEM + " It is A.", None),
    ("classification", CHOICE, "I'm sorry, but I can't help with reading medical images.", "refusal"),
    ("classification", CHOICE, "Il s'agit probablement de kyste, visible dans le cou.", "other_language"),
    ("classification", CHOICE, "N/A", "empty"), ("classification", CHOICE, None, "empty"), ("detection", BOX, "​ \t", "empty"),
    ("detection", BOX, "[]", None), ("detection", BOX, "[[1, 2, 3, 4]]", None), ("detection", BOX, "[[1, 2, 3, 4], [5", "truncated"),
    ("instance detection", BOX, "{}", None), ("instance detection", BOX, '{"1": [[1, 2, 3, 4]]', "truncated"), ("detection", BOX, "> " + BOX, "copied_question"),
    ("multi label classification", LIST, "cyst, complex; cyst", None), ("multi label classification", LIST, "cyst; pleural thi", "truncated"),
    ("multi label classification", LIST, "cyst; ", "truncated"), ("multi label classification", LIST, "<empty>", "empty"),
    ("cell counting", "How many cells lie in the neck?", "0", None), ("cell counting", "How many cells lie in the neck?", "About 12.", None),
    ("cell counting", "How many cells lie in the neck?", "The count is", "truncated"), ("cell counting", "How many cells lie in the neck?", "Es sind ungefähr 12 Zellen im Bild zu sehen", "other_language"),
    ("cell counting", "Wie viele Zellen sind im Bild zu sehen?", "Es sind ungefähr 12 Zellen im Bild zu sehen", None),
    ("report generation", REPORT, "The neck is clear. A nodule cannot be excluded, sorry for the motion blur.", None),
    ("report generation", REPORT, "The neck is clear.\nEnd of report", None), ("report generation", REPORT, "The neck is clear. The septa are", "truncated"),
    ("report generation", REPORT, "Die Begrenzung ist unregelmäßig und die Tiefe beträgt 4 mm.", "other_language"),
    ("regression", "What value do you read?", "The reading comes to about", "truncated"), (None, None, "", "empty"), (None, None, "fine", None),
]


@pytest.mark.parametrize("task,question,answer,defect", CASES)
def test_defects(task, question, answer, defect):
    assert DefectFinder(TERMS).find(task, question, answer) == defect


def test_automaton_covers_runs():
    a = SuffixAutomaton("a b c a b d".split())
    assert a.covered("x a b d y b c a".split(), 3) == [False, True, True, True, False, True, True, True]
    assert a.covered("a b".split(), 3) == [False, False]


def test_operator(spark):
    rows = [(i, t, q, a, "clash") for i, (t, q, a, _) in enumerate(CASES)] + [(999, "detection", BOX, "x " * 100_000, "clash")]
    df = spark.createDataFrame(rows, "pred_id long, TaskType string, Question string, Answer string, defect string")
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    got = {r["pred_id"]: r["defect"] for r in broken_pairs(df, terms).where("pred_id <> 999").collect()}
    assert got == {i: d for i, (*_, d) in enumerate(CASES) if d}
    assert broken_pairs(df.limit(0), terms.limit(0)).count() == 0
