"""A sample whose categories follow target shares, with a report of what can't be met.

The bounded table of targets is set on the driver: shares are scaled between each
category's minimum and what there is of it, the fractional two-way table is made integer
by maximum flow with both margins kept, and each cell's rows are then drawn as exactly so
many smallest random keys, found by bucket counts without sorting any category.

Cases: rows with a null, blank or unlisted category count in the sample size only. Target
rows whose names are equal are added up. A category without rows, and an empty table, give
a quota of zero. Names are the same up to letter case, outer blanks, and blank, hyphen or
underscore standing for each other.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mossgrid.functions.fields import category
from mossgrid.llm.flow import controlled_rounding, fill
from mossgrid.plans.runtime import budget_cut, written

#: Most target rows that may be read to the driver.
MAX_TARGETS = 100_000


def _targets(targets: DataFrame) -> dict[tuple, dict]:
    rows = (
        targets.select(
            "Modality",
            "TaskType",
            category(F.col("Modality")).alias("m"),
            category(F.col("TaskType")).alias("t"),
            F.col("target_permille").cast("long").alias("permille"),
            F.col("min_rows").cast("long").alias("least"),
        )
        .groupBy("m", "t")
        .agg(
            F.min("Modality").alias("Modality"),
            F.min("TaskType").alias("TaskType"),
            F.coalesce(F.sum("permille"), F.lit(0)).alias("permille"),
            F.coalesce(F.max("least"), F.lit(0)).alias("least"),
        )
        .where("m IS NOT NULL AND t IS NOT NULL")
        .limit(MAX_TARGETS + 1)
        .collect()
    )
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target categories")
    return {(r["m"], r["t"]): r.asDict() for r in rows}


def quota_table(counts: dict[tuple, int], targets: dict[tuple, dict], size: int) -> dict[tuple, dict]:
    """Per category: available, wanted (the greater of minimum and share, rounded up),
    quota (rows to draw) and short (wanted rows that there aren't)."""
    have = {c: counts.get(c, 0) for c in targets}
    low = {c: min(t["least"], have[c]) for c, t in targets.items()}
    quotas = controlled_rounding(fill({c: t["permille"] for c, t in targets.items()}, low, have, size))
    table = {}
    for c, t in targets.items():
        wanted = max(t["least"], -(-t["permille"] * size // 1000))
        table[c] = t | {"available": have[c], "wanted": wanted, "quota": quotas[c], "short": max(0, wanted - have[c])}
    return table


def proportional_sample(
    df: DataFrame, targets: DataFrame, *, id_col: str = "rec_id", fraction: Fraction = Fraction(1, 10), seed: int = 17
) -> tuple[DataFrame, DataFrame]:
    """(sample, report). Sample: id, Modality, TaskType as in the targets. Report: a row
    for each target category with available, wanted, quota, drawn and short."""
    spark = df.sparkSession
    wanted = _targets(targets)
    placed = df.select(
        F.col(id_col).alias("id"), category(F.col("Modality")).alias("m"), category(F.col("TaskType")).alias("t")
    )
    # Counted by the writings first (few), so names are brought to normal form once each.
    per_writing = df.groupBy("Modality", "TaskType").count()
    listed = spark.createDataFrame([(m, t) for m, t in wanted] or [("", "")], "m string, t string")
    per_cell = per_writing.select(
        category(F.col("Modality")).alias("m"), category(F.col("TaskType")).alias("t"), "count"
    )
    total, counts = 0, {}
    # All categories that aren't listed come back as one row: at most MAX_TARGETS + 1 rows.
    for row in (
        per_cell.join(F.broadcast(listed.withColumn("known", F.lit(True))), ["m", "t"], "left")
        .groupBy(F.when(F.col("known"), F.col("m")).alias("m"), F.when(F.col("known"), F.col("t")).alias("t"))
        .agg(F.sum("count").alias("n"))
        .collect()
    ):
        total += row["n"]
        if row["m"] is not None:
            counts[row["m"], row["t"]] = row["n"]
    table = quota_table(counts, wanted, int(total * fraction))
    budgets = spark.createDataFrame(
        [
            (i, m, t, r["Modality"], r["TaskType"], r["quota"], r["available"], r["wanted"], r["short"])
            for i, ((m, t), r) in enumerate(sorted(table.items()))
        ],
        "cell int, m string, t string, Modality string, TaskType string, budget long, available long, wanted long, short long",
    )
    # Names are brought to normal form once; the cut reads the rows three times.
    cells = written(placed.join(F.broadcast(budgets.select("cell", "m", "t")), ["m", "t"]).select("id", "cell"))
    drawn = budget_cut(
        cells, budgets, "cell", F.xxhash64(F.lit(seed), "id"), F.lit(1), tie="id"
    ).select("id", "cell")
    named = F.broadcast(budgets.select("cell", "Modality", "TaskType"))
    sample = drawn.join(named, "cell").select(F.col("id").alias(id_col), "Modality", "TaskType")
    report = (
        budgets.join(drawn.groupBy("cell").agg(F.count("*").alias("drawn")), "cell", "left")
        .select(
            "Modality",
            "TaskType",
            "available",
            "wanted",
            F.col("budget").alias("quota"),
            F.coalesce("drawn", F.lit(0)).alias("drawn"),
            # The report holds only if every cell drew its quota.
            F.when(F.coalesce("drawn", F.lit(0)) == F.col("budget"), F.col("short"))
            .otherwise(F.raise_error(F.lit("a category drew another number of rows than its quota")).cast("long"))
            .alias("short"),
        )
    )
    return sample, report
