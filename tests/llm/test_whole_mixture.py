"""Exponents of the mixing weights and the limits that they keep."""

from math import exp, isclose

from hypothesis import given, settings
from hypothesis import strategies as st

from mossgrid.llm.mixture import budgets, entropy, exponent_within, mix_sources, tempered, with_entropy

source = st.fixed_dictionaries({"permille": st.integers(0, 500), "tokens": st.integers(0, 400), "max_repeats": st.integers(0, 4)})


@settings(max_examples=200, deadline=None)
@given(st.lists(source, max_size=8), st.integers(0, 600))
def test_budgets_keep_limits(targets, size):
    rows = budgets(targets, size)
    assert all(0 <= r["budget"] <= r["capacity"] for r in rows)
    assert all(r["short"] == (r["capacity"] < r["wanted"]) == (r["exponent"] > 0) for r in rows)
    assert all(r["budget"] == r["capacity"] for r in rows if r["short"])
    whole = min(max(size, sum(min(r["wanted"], r["capacity"]) for r in rows)), sum(r["capacity"] for r in rows))
    assert abs(sum(r["budget"] for r in rows) - whole) <= 1 + len(rows) / 2


def test_exponent_meets_the_limit():
    rows = [{"permille": 500, "tokens": 10, "capacity": 20}, {"permille": 500, "tokens": 90, "capacity": 900}]
    e = exponent_within(rows, 100, [0])
    weights = tempered([10, 90], [500, 500], e)
    assert 0 < e < 1 and isclose(100 * weights[0], 20, rel_tol=1e-9)
    assert exponent_within(rows, 100, [1]) == 0.0 and isclose(sum(weights), 1)


def test_entropy():
    targets = [{"permille": 500, "tokens": 10, "max_repeats": 9}, {"permille": 500, "tokens": 90, "max_repeats": 9}]
    wanted = entropy([0.3, 0.7])
    got = [t["permille"] / 1000 for t in with_entropy(targets, wanted)]
    assert isclose(entropy(got), wanted, rel_tol=1e-9) and isclose(got[0], 0.3, rel_tol=1e-6)
    assert isclose(exp(entropy([t["permille"] / 1000 for t in with_entropy(targets, 5.0)])), 2)


def test_report_has_exponents(spark):
    rows = [(i, "big", "word " * 20) for i in range(100)] + [(1000, "tiny", "word " * 20)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("big", 500, 2), ("tiny", 500, 3)], "source string, target_permille int, max_repeats int")
    got = {r["source"]: r for r in mix_sources(df, targets)[1].collect()}
    assert got["tiny"]["short"] and 0 < got["tiny"]["exponent"] < 1 and got["big"]["exponent"] == 0 and not got["big"]["short"]
    even = {r["source"]: r["wanted"] for r in mix_sources(df, targets, target_entropy=0.0)[1].collect()}
    assert isclose(even["big"] / even["tiny"], 100, rel_tol=1e-6)
