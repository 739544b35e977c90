"""Sources mixed to target shares of the total size in tokens.

Sizes are counted by the public tokenizer. Temperature mixing: a source's weight is its token
share to the power e, times its target share to the power 1 - e. At e = 0 the weights are the
targets, at e = 1 each source comes as often as any other. A source is short if its weight at
e = 0 asks for more repeats than it may have; its exponent is then the least one, found by
bisection, at which the normalised weights respect its limit, and it gives all it may.
What short sources leave is shared among the others in the same way, by the least exponent at
which nobody's repeats are exceeded, until no source is short. An entropy of the weights may
be asked for instead: then one exponent for all sources is bisected to reach it first.

Weights become budgets, and budgets are realised as whole passes over a source and one
partial pass, a block permutation: the blocks of a random order are summed up, and the block
in which the budget ends is ranked, so that no source is sorted as a whole.

Cases: null sources and sources without target count in the total size only. A target
source without documents has size zero. Texts without tokens, null ones too, take part with
size zero. If all capacity is less than the size, all of it is used.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mossgrid.llm.tokens import TOKENIZER, count_tokens
from mossgrid.plans.runtime import budget_cut, cut_lineage

#: Most target sources that may be read to the driver.
MAX_SOURCES = 100_000
#: Exponent of a source that is short by less than bisection can tell.
TINY = 2.0**-60


def powered(shares: list[float], exponent: float) -> list[float]:
    """Shares to a power, summing to one; empty shares stay empty."""
    raised = [s**exponent if s > 0 else 0.0 for s in shares]
    whole = sum(raised)
    return [r / whole for r in raised] if whole else raised


def bisect(good, low: float, high: float, steps: int = 60) -> float:
    """The least value at which ``good`` holds; it must hold at ``high`` and onwards."""
    if good(low):
        return low
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if good(middle) else (middle, high)
    return high


def entropy(weights: list[float]) -> float:
    """In nats, of weights that sum to one."""
    return -sum(p * log(p) for p in weights if p > 0)


def exponent_for_entropy(shares: list[float], wanted: float) -> float:
    """Exponent in [0, 1] at which the powered shares have the entropy (in nats) or less:
    0 levels the sources, 1 keeps their natural shares."""

    def within(exponent: float) -> bool:
        return entropy(powered(shares, exponent)) <= wanted + 1e-12

    return bisect(within, 0.0, 1.0) if within(1.0) else 1.0


def tempered(shares: list[float], targets: list[float], exponent: float) -> list[float]:
    """Weights share**e * target**(1 - e), summing to one; a source without target has none."""
    raised = [s**exponent * t ** (1 - exponent) if t > 0 and (s > 0 or not exponent) else 0.0 for s, t in zip(shares, targets, strict=True)]
    whole = sum(raised)
    return [r / whole for r in raised] if whole else raised


def exponent_within(rows: list[dict], size: float, own: list[int]) -> float:
    """Least exponent in [0, 1] at which the weights ask none of the sources ``own`` for more
    than its capacity; 1 if none does."""
    shares, targets = [r["tokens"] for r in rows], [r["permille"] for r in rows]

    def within(exponent: float) -> bool:
        weights = tempered(shares, targets, exponent)
        return all(size * weights[i] <= rows[i]["capacity"] * (1 + 1e-12) for i in own)

    return bisect(within, 0.0, 1.0) if within(1.0) else 1.0


def with_entropy(targets: list[dict], wanted: float) -> list[dict]:
    """Targets replaced by the weights of the exponent that brings their entropy to ``wanted``
    or as near to it as the path from targets to natural shares allows."""
    shares, old = [t["tokens"] for t in targets], [t["permille"] for t in targets]
    of = lambda e: entropy(tempered(shares, old, e))
    falls = of(1.0) <= of(0.0)
    reached = lambda e: of(e) <= wanted + 1e-12 if falls else of(e) >= wanted - 1e-12
    exponent = bisect(reached, 0.0, 1.0) if reached(1.0) else 1.0
    return [t | {"permille": w * sum(old)} for t, w in zip(targets, tempered(shares, old, exponent), strict=True)]


def budgets(targets: list[dict], size: float) -> list[dict]:
    """Adds wanted, capacity, exponent, short and budget (tokens) to each target source.

    ``over_limit``, if given, tells in integers whether the limit fails at exponent 0, which
    is where a source is short; else it is told by ``wanted``.
    """
    rows = [
        t | {"capacity": t["tokens"] * max(0, t["max_repeats"]), "wanted": t["permille"] * size / 1000, "exponent": 0.0}
        for t in targets
    ]
    over = lambda r: r["over_limit"] if "over_limit" in r else r["capacity"] < r["wanted"]
    for i, r in enumerate(rows):
        if over(r):
            r["exponent"] = max(exponent_within(rows, size, [i]), TINY)
        r["short"] = r["exponent"] > 0
        r["budget"] = min(r["capacity"], r["wanted"])
    # What short sources leave, by the weights of the others, until nobody is over the limit.
    missing = min(size, sum(r["capacity"] for r in rows)) - sum(r["budget"] for r in rows)
    while missing > 0.5:
        room = [r | {"capacity": r["capacity"] - r["budget"], "tokens": r["capacity"] - r["budget"]} for r in rows]
        open_ = [i for i, r in enumerate(room) if r["capacity"] > 0 and r["permille"] > 0]
        if not open_:  # sources without a target of their own give what is still missing
            open_ = [i for i, r in enumerate(room) if r["capacity"] > 0]
            for i in open_:
                room[i]["permille"] = 1
        chosen = [room[i] for i in open_]
        e = exponent_within(chosen, missing, list(range(len(chosen))))
        weights = tempered([r["tokens"] for r in chosen], [r["permille"] for r in chosen], e)
        for i, w in zip(open_, weights, strict=True):
            rows[i]["budget"] += min(missing * w, room[i]["capacity"])
        left = min(size, sum(r["capacity"] for r in rows)) - sum(r["budget"] for r in rows)
        if left >= missing:
            break
        missing = left
    for r in rows:
        r["budget"] = int(round(min(r["budget"], r["capacity"])))
    return rows


def mix_sources(
    df: DataFrame,
    targets: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    share: tuple[int, int] = (1, 2),
    target_entropy: float | None = None,
    seed: int = 29,
    tokenizer: str = TOKENIZER,
) -> tuple[DataFrame, DataFrame]:
    """(mixture, report). Mixture: id, source, pass (from 1), n_tokens, place (random order
    key). Report: per target source tokens, wanted, capacity, exponent, short, drawn, actual
    share. ``target_entropy`` (in nats) tempers the targets first."""
    spark = df.sparkSession
    sized = cut_lineage(
        count_tokens(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")), ["id", "source"], tokenizer=tokenizer)
    )
    listed = (
        targets.where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.sum("target_permille").cast("long").alias("permille"), F.max("max_repeats").cast("long").alias("max_repeats"))
    )
    per_source = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    total = per_source.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    rows = listed.join(per_source, "source", "left").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    over, under = share
    wanted = []
    for r in rows:
        t = {"source": r["source"], "permille": r["permille"] or 0, "max_repeats": r["max_repeats"] or 0, "tokens": r["tokens"] or 0}
        # In integers: capacity < permille / 1000 * share * total.
        t["over_limit"] = t["tokens"] * max(0, t["max_repeats"]) * 1000 * under < t["permille"] * over * total
        wanted.append(t)
    if target_entropy is not None:
        wanted = [{k: v for k, v in t.items() if k != "over_limit"} for t in with_entropy(wanted, target_entropy)]
    table = [
        (i, r["source"], float(r["permille"]), r["tokens"], r["wanted"], r["capacity"], r["exponent"], r["budget"] // r["tokens"] if r["tokens"] else 0,
         r["budget"] % r["tokens"] if r["tokens"] else 0)
        for i, r in enumerate(sorted(budgets(wanted, total * over / under), key=lambda r: r["source"]))
    ]
    plan = spark.createDataFrame(
        table,
        "cell int, source string, permille double, tokens long, wanted double, capacity long, exponent double, whole long, budget long",
    )
    placed = sized.join(F.broadcast(plan.select("cell", "source", "whole")), "source")
    passes = placed.where("whole > 0").select("id", "cell", F.explode(F.expr("sequence(1L, whole)")).alias("pass"), "n_tokens")
    partial = budget_cut(
        placed.select("id", "cell", (F.col("whole") + 1).alias("pass"), "n_tokens"),
        plan.where("budget > 0"),
        "cell",
        F.xxhash64(F.lit(seed), "pass", "id"),
        F.col("n_tokens"),
        tie="id",
    ).drop("__before")
    drawn = passes.unionByName(partial)
    mixture = drawn.join(F.broadcast(plan.select("cell", "source")), "cell").select(
        F.col("id").alias(id_col), "source", "pass", "n_tokens", F.xxhash64(F.lit(seed), "pass", "id").alias("place")
    )
    per_cell = drawn.groupBy("cell").agg(F.sum("n_tokens").alias("drawn"), F.max("pass").alias("passes"))
    report = (
        plan.join(per_cell, "cell", "left")
        .withColumn("drawn", F.coalesce("drawn", F.lit(0)))
        # The report holds only if every source gave its budget and no more than it may.
        .withColumn(
            "short",
            F.when(
                (F.col("drawn") >= F.col("whole") * F.col("tokens") + F.col("budget")) & (F.col("drawn") <= F.col("capacity")),
                F.col("exponent") > 0,
            ).otherwise(F.raise_error(F.lit("a source gave another amount than its budget")).cast("boolean")),
        )
        .withColumn("actual_permille", F.try_divide(F.col("drawn") * 1000.0, F.sum("drawn").over(_everything())))
        .select("source", "permille", "tokens", "wanted", "capacity", "exponent", "short", "drawn", "actual_permille", F.coalesce("passes", F.lit(0)).alias("passes"))
    )
    return mixture, report


def _everything():
    """A window over the whole report: as many rows as there are target sources."""
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))
