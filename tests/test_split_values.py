"""Packed values against an exact round trip."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from mossgrid.operators.split_values import Segmenter, split_values

TERMS = ["effusion", "effusion, small", "nodule; calcified", "er+ margin", "kerr's line", '"ring" shadow', "blast cells", "blast cells > 5%", "milia/cyst", "cyst", "ground-glass/reticular"]


def packed(values, seed):
    r = random.Random(seed)
    quote = r.choice(["", '"', "'", '"'])
    shown = [quote + (v.replace('"', '""') if quote == '"' else v) + quote for v in (x.upper() if r.random() < 0.3 else x for x in values)]
    text = r.choice(["; ", "|", " / ", "\t", "\n", "；", " + ", ",", ", ,"]).join(shown)
    return r.choice(["{}", "[{}]", "({})", "  {} ", "{}."]).format(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(TERMS), min_size=1, max_size=7), st.integers(0, 10**6))
def test_round_trip(values, seed):
    assert [v for v, known in Segmenter(TERMS).split(packed(values, seed)) if known] == values


def test_cases(spark):
    df = spark.createDataFrame(
        [(1, "cyst, odd thing; Cyst", "x"), (2, None, "x"), (3, " ", "x"), (4, ";;,", "x"), (5, "cyst " * 5000, "x"), (6, "milia / cyst", "x"), (6, "cyst", "x")],
        "rec_id int, Answer string, val string",
    )
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    rows = split_values(df, terms, id_col="rec_id", value_col="Answer").collect()
    of = lambda i: sorted((r["pos"], r["val"], r["known"]) for r in rows if r["rec_id"] == i)
    assert of(1) == [(1, "cyst", True), (2, "odd thing", False), (3, "cyst", True)]
    assert not of(2) and not of(3) and not of(4) and len(of(5)) == 5000
    assert of(6) == [(1, "cyst", True), (1, "milia", False), (2, "cyst", True)]
    none = split_values(df, terms.limit(0), id_col="rec_id", value_col="Answer")
    assert none.where("known").count() == 0 and none.where("rec_id = 1").count() == 3
    assert split_values(df.limit(0), terms, id_col="rec_id", value_col="Answer").count() == 0
