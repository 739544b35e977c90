"""Target splits above the bound are refused, none keep all rows; hubs and many task names."""

import pytest

from mossgrid.llm import related
from mossgrid.llm.related import MAX_SPLITS, components, grouped_splits


def test_too_many_splits(spark):
    df = spark.createDataFrame([(1, "s1_1.png", "Detection")], "rec_id long, ImageName string, TaskType string")
    targets = spark.range(MAX_SPLITS + 1).selectExpr("concat('s', id) AS split_name", "1 AS target_permille")
    with pytest.raises(ValueError, match="more than 1000"):
        grouped_splits(df, targets)
    assert grouped_splits(df, targets.limit(MAX_SPLITS)).count() == 1


def test_no_target_splits(spark):
    df = spark.createDataFrame([(1, "s1_1.png", "Detection"), (2, None, None)], "rec_id long, ImageName string, TaskType string")
    for rows in ([], [("train", 0)], [("train", None)]):
        targets = spark.createDataFrame(rows, "split_name string, target_permille int")
        assert sorted(tuple(r) for r in grouped_splits(df, targets).collect()) == [(1, "s1", None), (2, None, None)]


def test_hub(spark, monkeypatch):
    monkeypatch.setattr(related, "HUB_LINKS", 20)
    monkeypatch.setattr(related, "HUB_ONE_IN", 10)
    links = [("hub", f"s{i}") for i in range(200)] + [(f"s{i}", f"t{i}") for i in range(0, 200, 3)] + [("t0", "u"), ("v", "w")]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert set(got) == {x for pair in links for x in pair}
    assert len({label for node, label in got.items() if node not in "vw"}) == 1 and got["v"] == got["w"] != got["hub"]


def test_many_task_names(spark):
    """Names that nearly every row has alone are strata too, and a hot component keeps its split."""
    rows = [(i, f"s{i % 700 if i % 3 else 'hot'}_1.png", f"name {i}" if i % 2 else "Detection") for i in range(4000)]
    df = spark.createDataFrame(rows, "rec_id long, ImageName string, TaskType string")
    targets = spark.createDataFrame([("train", 800), ("validation", 100), ("test", 100)], "split_name string, target_permille int")
    out = grouped_splits(df, targets).collect()
    assert len(out) == 4000 and all(r["split_name"] for r in out)
    assert len({(r["group_key"], r["split_name"]) for r in out}) == len({r["group_key"] for r in out})
    assert abs(sum(r["split_name"] == "train" for r in out) / 4000 - 0.8) < 0.05


@pytest.mark.parametrize("small", [0, 200_000])
def test_graphs_of_seeds(spark, monkeypatch, small):
    """Seeds merged in one task or level by level give the same components."""
    monkeypatch.setattr(related, "SMALL_LINKS", small)
    links = [(f"p{i}", f"p{i + 1}") for i in range(60)] + [(f"q{i}", f"q{i + 7}") for i in range(40)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert len(got) == 61 + 47 and len({v for n, v in got.items() if n[0] == "p"}) == 1 and len({v for n, v in got.items() if n[0] == "q"}) == 7
