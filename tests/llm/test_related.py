"""Groups of related records and their splits."""

import random

from mossgrid.llm.related import components, grouped_splits, related_records


def test_components_of_chains_stars_and_cycles(spark):
    r = random.Random(1)
    links = [(f"c{i}", f"c{i + 1}") for i in range(120)] + [("hub", f"s{i}") for i in range(60)] + [("x", "y"), ("y", "z"), ("z", "x"), ("q", "q")]
    links += [(f"r{r.randint(0, 80)}", f"r{r.randint(0, 80)}") for _ in range(60)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        parent[find(a)] = find(b)
    got = {row["node"]: row["label"] for row in components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert set(got) == {x for a, b in links if a != b for x in (a, b)}
    pairs = [(a, b) for a in got for b in got if a < b]
    assert all((got[a] == got[b]) == (find(a) == find(b)) for a, b in pairs)


def test_related(spark):
    rows = [
        (1, "a/S1_01.png", "Detection"), (2, "s1_02.png", "detection"), (3, '["s2_1.png", "s3_1.png"]', "Regression"), (4, "x\\S3_9.PNG", None),
        (5, "lone_1.png", "Detection"), (6, None, "Detection"), (7, " ", None), (8, "['s2_1.png', 's1_1.png']", "Detection"), (9, "a_b_1.png", ""), (9, "a_b_1.png", ""),
    ]
    df = spark.createDataFrame([(*r, "k", "k", 0) for r in rows], "rec_id long, ImageName string, TaskType string, study string, group_key string, n int")
    got = sorted((r["rec_id"], r["group_key"]) for r in related_records(df).collect())
    assert got == [(1, "s1"), (2, "s1"), (3, "s1"), (4, "s1"), (8, "s1"), (9, "a_b"), (9, "a_b")]
    assert related_records(df.limit(0)).count() == 0


def test_splits(spark):
    r = random.Random(2)
    rows = [(i, f"s{r.randint(0, 400) if i % 10 else 'hot'}_1.png", r.choice(["Detection", "Regression"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "rec_id long, ImageName string, TaskType string")
    targets = spark.createDataFrame([("train", 800), ("validation", 100), ("test", 100)], "split_name string, target_permille int")
    out = grouped_splits(df, targets).collect()
    assert len(out) == 3000 and len({(x["group_key"], x["split_name"]) for x in out}) == len({x["group_key"] for x in out})
    share = {n: sum(x["split_name"] == n for x in out) / 3000 for n in ("train", "validation", "test")}
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["test"] - 0.1) < 0.02
    assert grouped_splits(df.limit(0), targets).count() == 0
