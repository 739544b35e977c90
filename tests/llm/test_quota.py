"""Controlled rounding and proportional samples."""

from fractions import Fraction
from math import ceil, floor

from hypothesis import given, settings
from hypothesis import strategies as st

from mossgrid.llm.flow import controlled_rounding, fill
from mossgrid.llm.quota import proportional_sample

cells = st.dictionaries(st.tuples(st.integers(0, 4), st.integers(0, 4)), st.fractions(0, 9, max_denominator=40), max_size=16)


@settings(max_examples=150, deadline=None)
@given(cells)
def test_rounding_keeps_all_margins(table):
    out = controlled_rounding(table)
    near = lambda got, x: floor(x) <= got <= ceil(x)
    assert all(near(out[c], x) for c, x in table.items())
    for axis in (0, 1):
        for k in {c[axis] for c in table}:
            assert near(sum(out[c] for c in table if c[axis] == k), sum(x for c, x in table.items() if c[axis] == k))
    assert near(sum(out.values()), sum(table.values(), Fraction(0)))


def test_fill():
    out = fill({"a": 1, "b": 1, "c": 2}, {"a": 0, "b": 3, "c": 0}, {"a": 10, "b": 10, "c": 1}, 8)
    assert out == {"a": Fraction(7, 2), "b": Fraction(7, 2), "c": 1}
    assert sum(fill({"a": 1}, {"a": 0}, {"a": 3}, 8).values()) == 3
    assert fill({}, {}, {}, 8) == {}


def test_sample(spark):
    rows = [(i, "X-Ray" if i % 2 else " x ray", "Detection", "q") for i in range(900)] + [(1000 + i, "CT", "detection", "q") for i in range(60)]
    rows += [(2000 + i, None, "Detection", "q") for i in range(30)] + [(3000 + i, "Other", " ", "q") for i in range(10)]
    df = spark.createDataFrame(rows, "rec_id long, Modality string, TaskType string, cell string")
    targets = spark.createDataFrame(
        [("X_ray", "detection", 500, 5), ("CT", "Detection", 400, 5), ("MR", "Detection", 100, 3)],
        "Modality string, TaskType string, target_permille int, min_rows int",
    )
    sample, report = proportional_sample(df, targets)
    got = {r["Modality"]: (r["available"], r["wanted"], r["quota"], r["drawn"], r["short"]) for r in report.collect()}
    assert got["MR"] == (0, 10, 0, 0, 10) and got["X_ray"][0] == 900
    assert got["CT"][2] == got["CT"][3] and got["X_ray"][3] + got["CT"][3] == 100
    assert sample.select("rec_id").distinct().count() == sample.count() == 100
    again, _ = proportional_sample(df, targets)
    assert {r[0] for r in again.collect()} == {r[0] for r in sample.collect()}
    empty, report = proportional_sample(df.limit(0), targets)
    assert empty.count() == 0 and report.where("short > 0").count() == 3
    none, report = proportional_sample(df, targets.limit(0))
    assert none.count() == 0 and report.count() == 0
