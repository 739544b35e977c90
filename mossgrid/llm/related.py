"""Splits that keep related records together.

Records are related if their images name a common study, also through other records. The
graph's nodes are study keys; a record that names several studies links them. Components
are found by frontier breadth-first search from many seeds at once: the seeds are the
nodes whose random rank is below that of all their neighbours, so every node has a short
falling path to one. Where two seeds' regions meet, an edge between the seeds enters a
smaller graph. Once that is small enough for one task its seeds are merged there; till then
its components are found in the same way.

Splits are then given to whole components: large ones first, the rest in hash order within
the TaskType that most of their records have.

Cases: a record without image is in no group and gets a split by its own hash; those without
id too get one split. A study in a
single record forms a group of one. Repeated rows count. Empty tables give empty results;
without target splits, or with shares of zero only, every record's split is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mossgrid.functions.fields import category, with_study_keys
from mossgrid.plans.runtime import cut_lineage


#: A hub is a node with at least so many links and at least this share (one in so many) of
#: all links; there are at most as many of them. Its links are spread over all tasks.
HUB_LINKS, HUB_ONE_IN = 10_000, 1_000


def _rank(node: str):
    return F.struct(F.xxhash64(node), F.col(node))


class Adjacency:
    """Links in both directions, hash-partitioned by their first node; those of hubs apart."""

    def __init__(self, pairs: DataFrame) -> None:
        self.links = cut_lineage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        least = max(HUB_LINKS, -(-self.links.count() // HUB_ONE_IN))
        hubs = self.links.groupBy("a").count().where(F.col("count") >= least).select("a").collect()  # at most HUB_ONE_IN
        self.hubs = [r["a"] for r in hubs]
        self.plain = cut_lineage(self.links.where(~F.col("a").isin(self.hubs)).repartition("a"))

    def of(self, frontier: DataFrame) -> DataFrame:
        """(node, seed) of the neighbours of the frontier's nodes (a, seed)."""
        met = self.plain.join(frontier, "a")
        if self.hubs:
            few = F.broadcast(frontier.where(F.col("a").isin(self.hubs)))  # a row for each hub at most
            met = met.unionByName(self.links.where(F.col("a").isin(self.hubs)).join(few, "a"))
        return met.groupBy(F.col("b").alias("node")).agg(F.min("seed").alias("seed"))


#: Most links of a graph of seeds that one task merges.
SMALL_LINKS = 200_000


def merged_seeds(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of at most SMALL_LINKS links (a, b): trees of labels, in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[str, str] = {}

        def root(node: str) -> str:
            parent.setdefault(node, node)
            while parent[node] != node:
                parent[node] = node = parent[parent[node]]
            return node

        for batch in batches:
            for a, b in zip(batch["a"], batch["b"], strict=True):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
        yield pd.DataFrame({"node": list(parent), "label": [root(n) for n in list(parent)]}, dtype="object")

    return links.coalesce(1).mapInPandas(run, "node string, label string")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of the links (a, b); label is one node of the component.

    Rounds of a level: the longest falling path, O(log n) expected. Levels: each keeps at
    most half of the nodes as seeds. Nothing but emptiness is read to the driver.
    """
    adjacency = Adjacency(links.where("a <> b").select("a", "b"))
    if adjacency.links.isEmpty():
        return adjacency.links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    lowest = adjacency.links.groupBy("a").agg(F.min(_rank("b")).alias("low"))
    reached = cut_lineage(
        lowest.where(_rank("a") < F.col("low")).select(F.col("a").alias("node"), F.col("a").alias("seed"))
    )
    frontier = reached
    while not frontier.isEmpty():
        met = adjacency.of(frontier.withColumnRenamed("node", "a"))
        frontier = cut_lineage(met.join(reached, "node", "left_anti"))
        reached = reached.unionByName(frontier)
    reached = cut_lineage(reached)
    left, right = (
        reached.select(F.col("node").alias(n), F.col("seed").alias(s)) for n, s in (("a", "sa"), ("b", "sb"))
    )
    collisions = cut_lineage(
        adjacency.links.where("a < b")
        .join(left, "a")
        .join(right, "b")
        .where("sa <> sb")
        .select(F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b"))
        .distinct()
    )
    small = collisions.count() <= SMALL_LINKS
    merged = (merged_seeds if small else components)(collisions).select(F.col("node").alias("seed"), F.col("label").alias("merged"))
    return reached.join(merged, "seed", "left").select("node", F.coalesce("merged", "seed").alias("label"))


def study_groups(df: DataFrame, id_col: str = "rec_id") -> tuple[DataFrame, DataFrame]:
    """(records, groups). Records: id, study (first key), TaskType, for records with an
    image. Groups: study, group_key, n_rows of the whole group, for every first key."""
    fields = df.select(F.col(id_col).alias("id"), category(F.col("TaskType")).alias("task"), F.col("ImageName").alias("field"))
    parsed = cut_lineage(
        with_study_keys(fields, "field", "keys").select(
            "id",
            "task",
            F.get("keys", F.lit(0)).alias("study"),
            F.when(F.size("keys") > 1, F.slice("keys", 2, F.greatest(F.size("keys") - 1, F.lit(0)))).alias("others"),
        )
    )
    records = parsed.where("study IS NOT NULL")
    links = records.where("others IS NOT NULL").select(F.col("study").alias("a"), F.explode("others").alias("b")).distinct()
    labels = cut_lineage(components(links))
    smallest = labels.groupBy("label").agg(F.min("node").alias("group_key"))
    named = labels.join(smallest, "label").select(F.col("node").alias("study"), "group_key")
    per_study = records.groupBy("study").agg(F.count("*").alias("n"))
    placed = per_study.join(named, "study", "left").select(
        "study", F.coalesce("group_key", "study").alias("group_key"), "n"
    )
    sizes = placed.groupBy("group_key").agg(F.sum("n").alias("n_rows"))
    groups = cut_lineage(placed.join(sizes, "group_key").select("study", "group_key", "n_rows"))
    return parsed.drop("others"), groups


def related_records(df: DataFrame, id_col: str = "rec_id") -> DataFrame:
    """(id, group_key) of every record whose group has at least two records.

    The records are the probed side of an inner join on the study key: a hot study is one
    row of the other side, and AQE splits its partition.
    """
    parsed, groups = study_groups(df, id_col)
    return (
        parsed.where("study IS NOT NULL")
        .join(groups.where("n_rows >= 2"), "study")
        .select(F.col("id").alias(id_col), "group_key")
    )


#: A component with at least this share (one in so many) of all rows is placed by itself;
#: there are at most as many of them.
LARGE_ONE_IN = 2000
BUCKETS = 1 << 12
#: Most target splits that may be read to the driver.
MAX_SPLITS = 1_000


def grouped_splits(df: DataFrame, targets: DataFrame, id_col: str = "rec_id") -> DataFrame:
    """(id, group_key, split_name): whole groups, in shares as near to the targets as the
    groups allow, over all and within each TaskType."""
    spark = df.sparkSession
    listed = targets.select("split_name", "target_permille").orderBy(F.desc("target_permille"), "split_name").limit(MAX_SPLITS + 1).collect()
    if len(listed) > MAX_SPLITS:
        raise ValueError(f"more than {MAX_SPLITS} target splits")
    shares = [(r["split_name"], int(r["target_permille"] or 0)) for r in listed]
    whole = sum(p for _, p in shares)
    parsed, groups = study_groups(df, id_col)
    if not whole:
        named = parsed.join(groups.select("study", "group_key"), "study", "left")
        return named.select(F.col("id").alias(id_col), "group_key", F.lit(None).cast("string").alias("split_name"))
    keyed = cut_lineage(
        parsed.join(groups.select("study", "group_key"), "study", "left").select(
            "id", "group_key", F.coalesce("group_key", F.concat(F.lit("\u0001"), F.coalesce(F.col("id").cast("string"), F.lit("")))).alias("unit"),
            F.coalesce("task", F.lit("")).alias("task"),
        )
    )
    per_task = cut_lineage(keyed.groupBy("unit", "task").agg(F.count("*").alias("n")))
    units = cut_lineage(
        per_task.groupBy("unit")
        .agg(F.sum("n").alias("n"), F.max(F.struct("n", "task")).alias("most"))
        .select("unit", "n", F.col("most.task").alias("stratum"), F.xxhash64("unit").alias("h"))
    )
    total = units.agg(F.sum("n")).first()[0] or 0
    split_large = spark.createDataFrame(_place_large(per_task, units, shares, total), "unit string, split_name string")
    # The rest by hash order: running sums over buckets of the hash, at most BUCKETS a
    # stratum, and ranked rows only within a bucket.
    small = units.join(split_large, "unit", "left_anti").withColumn("bucket", F.shiftrightunsigned("h", 52))
    per_bucket = small.groupBy("stratum", "bucket").agg(F.sum("n").alias("bn"))
    before = Window.partitionBy("stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.withColumn("start", F.coalesce(F.sum("bn").over(before), F.lit(0)))
    inside = Window.partitionBy("stratum", "bucket").orderBy("h", "unit").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("n") / 2
    ordered = small.join(starts.drop("bn"), ["stratum", "bucket"]).withColumn("mid", middle)
    # Each stratum has one row with the upper bounds of all splits.
    ranges = _ranges(per_task, per_bucket, split_large, shares)
    split_small = ordered.join(ranges, "stratum").select(
        "unit",
        F.element_at(F.filter("ranges", lambda r: F.col("mid") < r["high"]), 1)["split_name"].alias("split_name"),
    )
    return keyed.join(split_small.unionByName(split_large), "unit").select(F.col("id").alias(id_col), "group_key", "split_name")


def _place_large(per_task: DataFrame, units: DataFrame, shares: list[tuple[str, int]], total: int) -> list[tuple[str, str]]:
    """Splits of the components that hold a LARGE_ONE_IN-th of all rows or more: each goes,
    the largest first, where most room for its tasks is left. Tasks with less than a
    thousandth of all rows count as one here, so the tables on the driver are bounded."""
    tasks = per_task.groupBy("task").agg(F.sum("n").alias("n"))
    pooled = tasks.select("task", "n", F.when(F.col("n") * 1000 >= total, F.col("task")).otherwise("").alias("pool"))
    heavy = units.where(F.col("n") >= max(2, -(-total // LARGE_ONE_IN))).select("unit")
    large: dict[str, dict[str, int]] = {}
    for r in per_task.join(heavy, "unit").join(pooled.select("task", "pool"), "task").groupBy("unit", "pool").agg(F.sum("n").alias("n")).collect():
        large.setdefault(r["unit"], {})[r["pool"]] = r["n"]
    whole, room = sum(p for _, p in shares), {}
    for r in pooled.groupBy("pool").agg(F.sum("n").alias("n")).collect():
        room |= {(r["pool"], name): r["n"] * permille / whole for name, permille in shares}
    placed = []
    for unit, rows in sorted(large.items(), key=lambda u: (-sum(u[1].values()), u[0])):
        name = max(shares, key=lambda s: (sum(n * room[task, s[0]] for task, n in rows.items()), s[1]))[0]
        for task, n in rows.items():
            room[task, name] -= n
        placed.append((unit, name))
    return placed


def _ranges(per_task: DataFrame, per_bucket: DataFrame, split_large: DataFrame, shares: list[tuple[str, int]]) -> DataFrame:
    """(stratum, ranges): where in the order of a stratum's small components each split ends,
    in the order of ``shares``; what large components took of a task is left out."""
    whole = sum(p for _, p in shares)
    tasks = per_task.groupBy(F.col("task").alias("stratum")).agg(F.sum("n").alias("n"))
    taken = per_task.join(split_large, "unit").groupBy(F.col("task").alias("stratum"), "split_name").agg(F.sum("n").alias("taken"))
    taken = taken.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("split_name", "taken"))).alias("taken"))
    left = lambda name, permille: F.greatest(F.lit(0.0), F.col("n") * (permille / whole) - F.coalesce(F.try_element_at("taken", F.lit(name)), F.lit(0)))
    room = tasks.join(taken, "stratum", "left").select("stratum", F.array(*[left(*s) for s in shares]).alias("room"))
    sizes = per_bucket.groupBy("stratum").agg(F.sum("bn").alias("small"))
    names = F.array(*[F.lit(name) for name, _ in shares])
    have = F.aggregate("room", F.lit(0.0), lambda a, x: a + x)

    def upto(i: Column) -> Column:
        held = F.aggregate(F.slice("room", 1, i + 1), F.lit(0.0), lambda a, x: a + x)
        return F.when(i == len(shares) - 1, float("inf")).otherwise(F.coalesce(F.try_divide(held, have) * F.col("small"), F.lit(0.0)))

    return room.join(sizes, "stratum").select(
        "stratum", F.transform(names, lambda name, i: F.struct(name.alias("split_name"), upto(i).alias("high"))).alias("ranges")
    )
