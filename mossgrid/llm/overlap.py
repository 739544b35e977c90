"""Records of evaluation splits that occur, exactly or almost, in the training split.

Exact bipartite prefix-filter join. Two records overlap if they name the same set of image
files, have the same answer words, and their questions share at least ``num/den`` of the
distinct words of the larger question. Image set and answer form a composite key; within
it, a question's words are sorted rare-first and only as long a prefix is indexed that two
overlapping questions must have a prefix word in common.

Cases: a record without image file or without answer word overlaps nothing; neither does a
question without a word. Null splits belong to no side, rows without id to no pair. Empty tables give empty results.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mossgrid.functions.fields import with_file_names, word_text, words
from mossgrid.plans.runtime import fingerprint, written

#: Slots of the word counter. Words of one slot share a count: that only changes their
#: order, which must be the same on both sides but may be any.
WORD_SLOTS = 1 << 14


def _records(df: DataFrame, id_col: str, split_col: str, train: str) -> DataFrame:
    """The two sides with their composite key, and ``ok`` where the key is complete.

    Key columns are never null and nothing filters on them: a filter on a computed column
    would be pushed below the projection and compute it a second time.
    """
    fields = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(split_col) == train, F.lit(False)).alias("train"),
        F.col(split_col).isNotNull().alias("placed"),
        F.col("ImageName").alias("field"),
        F.coalesce(word_text(F.col("Answer")), F.lit("")).alias("answer"),
        "Question",
    )
    base = with_file_names(fields, "field", "files").withColumn("names", F.array_join("files", "\u0001"))
    k1, k2 = fingerprint(F.col("names"), F.col("answer"))
    ok = F.col("placed") & F.col("id").isNotNull() & (F.col("names") != "") & (F.col("answer") != "")
    return base.select("id", "train", ok.alias("ok"), k1.alias("k1"), k2.alias("k2"), "Question")


def _word_counts(classes: DataFrame) -> Column:
    """Counts of all words of the join, by slot, as an array literal of fixed size."""
    slot = F.pmod(F.xxhash64("word"), F.lit(WORD_SLOTS))
    counted = classes.select(F.explode(F.split("q", " ")).alias("word")).groupBy(slot.alias("slot")).count()
    table = [0] * WORD_SLOTS
    for row in counted.collect():  # at most WORD_SLOTS rows, whatever the data
        table[row["slot"]] = row["count"]
    return F.from_json(F.lit(json.dumps(table)), "array<bigint>")


def _needed(n: Column, num: int, den: int) -> Column:
    """Least overlap that reaches num/den of n words, in integers."""
    return F.floor((n * num + (den - 1)) / den).cast("int")


def overlapping_classes(classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of question classes (k1, k2, c_train, c_eval) that reach the threshold.

    ``classes``: k1, k2, c (class hash), q (distinct sorted words), has_train, has_eval.
    """
    counts = _word_counts(classes)
    rare_first = F.transform(
        F.sort_array(
            F.transform(
                F.split("q", " "),
                lambda w: F.struct(
                    F.element_at(counts, (F.pmod(F.xxhash64(w), F.lit(WORD_SLOTS)) + 1).cast("int")).alias("n"),
                    w.alias("w"),
                ),
            )
        ),
        lambda s: s["w"],
    )
    # Written once: the sort would otherwise be evaluated again in every later expression.
    sorted_ = written(classes.withColumn("ws", rare_first).drop("q")).withColumn("n", F.size("ws"))
    prefixed = sorted_.withColumn("prefix", F.slice("ws", 1, F.col("n") - _needed(F.col("n"), num, den) + 1))

    def side(flag: str, tag: str) -> DataFrame:
        return prefixed.where(flag).select(
            "k1",
            "k2",
            *[F.col(c).alias(f"{c}_{tag}") for c in ("c", "ws", "n", "prefix")],
            F.posexplode("prefix").alias(f"pos_{tag}", "word"),
        )

    index, probe = side("has_eval", "e"), side("has_train", "t")
    larger, smaller = F.greatest("n_t", "n_e"), F.least("n_t", "n_e")
    rest = F.least(F.col("n_t") - F.col("pos_t"), F.col("n_e") - F.col("pos_e"))
    return (
        probe.join(index, ["k1", "k2", "word"])
        .where(smaller * den >= larger * num)  # length filter
        .where(rest * den >= larger * num)  # position filter
        # Each pair is kept at its first common prefix word only: no distinct needed.
        .where(F.element_at(F.array_intersect("prefix_t", "prefix_e"), 1) == F.col("word"))
        .where(F.size(F.array_intersect("ws_t", "ws_e")) * den >= larger * num)  # verification
        .select("k1", "k2", "c_t", "c_e")
    )


def cross_split_overlaps(
    df: DataFrame,
    *,
    id_col: str = "rec_id",
    split_col: str = "split_dir",
    train: str = "training",
    num: int = 4,
    den: int = 5,
) -> DataFrame:
    """All pairs (train_id, eval_id) of overlapping records.

    Keys that occur on one side only are dropped after a pre-aggregation of 16-byte
    fingerprints, so questions are split into words and shuffled only where a partner is
    possible. Equal questions of one key form a class; candidates and verification run
    once per pair of classes, members are expanded at the end.
    """
    records = _records(df, id_col, split_col, train)
    train_side, eval_side = F.col("train"), ~F.col("train")
    both = (
        records.groupBy("k1", "k2")
        .agg(F.max(train_side & F.col("ok")).alias("t"), F.max(eval_side & F.col("ok")).alias("e"))
        .where("t AND e")
        .select("k1", "k2")
    )
    question = F.array_join(F.sort_array(F.array_distinct(words(F.col("Question")))), " ")
    kept = written(
        records.join(both, ["k1", "k2"], "left_semi")
        .where("ok")
        .select("id", "train", "k1", "k2", question.alias("q"))
        .select("id", "train", "k1", "k2", F.xxhash64("q").alias("c"), "q")
    ).where("q <> ''")
    classes = kept.groupBy("k1", "k2", "c", "q").agg(
        F.max("train").alias("has_train"), F.max(~F.col("train")).alias("has_eval")
    )
    pairs = overlapping_classes(classes, num, den)
    train_side = kept.where("train").select("k1", "k2", F.col("c").alias("c_t"), F.col("id").alias("train_id"))
    eval_side = kept.where("NOT train").select("k1", "k2", F.col("c").alias("c_e"), F.col("id").alias("eval_id"))
    return (
        pairs.join(train_side, ["k1", "k2", "c_t"]).join(eval_side, ["k1", "k2", "c_e"]).select("train_id", "eval_id")
    )


def overlap_report(
    df: DataFrame, pairs: DataFrame, *, id_col: str = "rec_id", split_col: str = "split_dir", train: str = "training"
) -> DataFrame:
    """Per evaluation split and dataset: rows, rows with a training partner, pairs."""
    hits = pairs.groupBy("eval_id").agg(F.count("*").alias("n_pairs"))
    rows = df.select(F.col(id_col).cast("long").alias("eval_id"), F.col(split_col).alias("split_dir"), "dataset")
    return (
        rows.where(F.col("split_dir") != train)
        .join(hits, "eval_id", "left")
        .groupBy("split_dir", "dataset")
        .agg(
            F.count("*").alias("n_records"),
            F.count("n_pairs").alias("n_overlapping"),
            F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_pairs"),
        )
    )
