"""Defects that once were missed: lists after a lead, long refusals."""

import pytest

from mossgrid.llm.pairs import DefectFinder
from tests.llm.test_pairs import BOX, CHOICE, REPORT, TERMS


@pytest.mark.parametrize(
    "task,answer,defect",
    [
        ("detection", "Boxes: [[12, 30, 45", "truncated"), ("detection", "Boxes: [[12, 30, 45, 60], [1, 2", "truncated"), ("detection", "Boxes: [[1, 2, 3, 4]", "truncated"),
        ("instance detection", 'Found: {"1": [[1, 2, 3, 4]]', "truncated"), ("detection", "Boxes: [[12, 30, 45, 60]]", None), ("detection", "Both of the nodules lie here: [[1, 2, 3, 4], [5, 6, 7, 8]].", None),
        ("detection", "Boxes: [[1, 2, 3, 4]] and there", "truncated"), ("detection", "No nodule.", None),
    ],
)
def test_lists_after_a_lead(task, answer, defect):
    assert DefectFinder(TERMS).find(task, BOX, answer) == defect


WHY = (
    "I'm sorry, but I cannot help with reading medical images. Images like this one should be read by a qualified physician "
    "who knows the history of the patient, the earlier studies and the way in which they were taken. As an AI model I am bound by guidelines that "
    "keep me from doing so. Please consult a radiologist, who can look at all of it with the care that it deserves."
)
SEEN = "The neck is clear and its borders are smooth in all of the planes shown. " * 4


@pytest.mark.parametrize(
    "task,question,answer,defect",
    [
        ("classification", CHOICE, WHY, "refusal"), ("report generation", REPORT, WHY, "refusal"), ("detection", BOX, WHY, "refusal"), ("multi label classification", BOX, WHY, "refusal"),
        ("report generation", REPORT, SEEN + "I cannot provide a size.", None), ("classification", CHOICE, WHY + " The answer is A.", None),
        ("detection", BOX, WHY + " One nodule lies at 10, 20, 30, 40 as a radiologist may see.", None),
    ],
)
def test_long_refusals(task, question, answer, defect):
    assert len(answer.split()) > 45
    got = DefectFinder(TERMS).find(task, question, answer)
    assert got == defect if defect else got != "refusal"
