"""Refusals by clause and replies in languages beside the four of the tables."""

import pytest

from mossgrid.llm.pairs import DefectFinder
from tests.llm.test_pairs import CHOICE, REPORT, TERMS

GERMAN = "Frage: Welcher Befund passt am besten zu dieser Aufnahme des Knies in der axialen Schicht?"
FRENCH = "Quelle anomalie correspond le mieux à cette image du genou, prise sur la phase tardive ?"


@pytest.mark.parametrize(
    "task,question,answer,defect",
    [
        ("report generation", REPORT, "I will not see swelling increase, the neck is clear.", None),
        ("report generation", REPORT, "I cannot see a fracture. I do not see a nodule.", None),
        ("report generation", REPORT, "The neck is clear. I cannot provide a size.", None),
        ("report generation", REPORT, "I cannot provide a report of this neck.", "refusal"),
        ("regression", "What value do you read?", "Das kann ich leider nicht beurteilen.", "refusal"),
        ("regression", "Quelle valeur lisez-vous ?", "Je ne peux pas interpréter cette image.", "refusal"),
        ("regression", "¿Qué valor lee?", "Lo siento, no puedo ayudar con esta imagen.", "refusal"),
        ("report generation", REPORT, "Ich kann den Knoten im Hals sehen.", "other_language"),
        (None, GERMAN, "Si tratta probabilmente di una cisti della parte alta del collo.", "other_language"),
        (None, CHOICE, "Trata-se provavelmente de um quisto na parte superior do pescoço.", "other_language"),
        (None, CHOICE, "Het is waarschijnlijk een cyste in de hals.", "other_language"),
        (None, CHOICE, "これは首の嚢胞です。", "other_language"),
        (None, FRENCH, "Probablemente se trata de un quiste en la mácula.", "other_language"),
        (None, FRENCH, "Il s'agit probablement de kyste, visible dans le cou.", None),
        (None, GERMAN, "Am ehesten liegt eine Zyste an der Blasenwand vor.", None),
        ("classification", CHOICE, "La réponse est A: left nodule", "other_language"),
    ],
)
def test_defects(task, question, answer, defect):
    assert DefectFinder(TERMS).find(task, question, answer) == defect


@pytest.mark.parametrize(
    "question,answer,defect",
    [
        ("Options: A: mass B: air leak Dear reader: Which finding is best?", "B. air leak", None),
        ("Which finding is best?\nA. mass\nB. air leak Answer briefly.", "The answer is B: air leak", None),
        ("Which finding is best? A) mass, B) air leak (one answer)", "B", None),
        ("WHICH FINDING IS BEST? A) MASS, B) AIR LEAK ANSWER BRIEFLY.", "B. air leak", None),
        ("WHICH FINDING IS BEST? A) MASS, B) AIR LEAK ANSWER BRIEFLY.", "B. air le", "truncated"),
        ("Which finding is best?\nA. mass\nB. air leak Answer briefly.", "B. air", "truncated"),
        ("Which finding is best?\nA. air leak\nB. mass Answer briefly.", "A. air", "truncated"),
        ("Frage: Welcher Befund? A) Masse, B) linke Zyste Frage: Welcher?", "B. linke Zyste", None),
    ],
)
def test_text_behind_the_last_option(question, answer, defect):
    assert DefectFinder(TERMS).find("classification", question, answer) == defect
