"""Records that are equal but for formatting, collapsed with the number of their copies.

Two stages: byte-identical lines collapse first, and only the distinct survivors are
parsed and put into canonical form; groups of equal canonical text then sum the counts.

The canonical text of a JSON object lists its keys in order with their values. Letter case,
white space and punctuation do not count; a number keeps its sign and decimal point, and
two numbers stay two numbers. In ``ImageName`` only letter case, outer blanks, a leading
``./`` and kind and number of slashes do not count, and one name equals a list of it.

Cases: a null line, a line that is no JSON and a JSON value that is no object belong to no
group. A null value differs from an absent key and from an empty text. A key that an object
repeats has its last value. A minus sign is a sign directly before its number only. Repeated
rows of one raw_id count as copies but are reported once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mossgrid.functions.fields import strip
from mossgrid.plans.runtime import fingerprint, written

# Fixed marks inside canonical texts: key, end of entry, next image, sign, decimal point,
# number border, null.
KEY, ENTRY, NEXT, SIGN, POINT, BORDER, NULL = "\u0001", "\u0002", "\u0003", "\u0004", "\u0005", "\u0006", "\u0007"
WORDLIKE = r"\p{L}\p{M}\p{N}"


def fuse(text: Column) -> Column:
    """Text without what doesn't count; the marks above stay."""
    signed = F.regexp_replace(text, rf"(?<![{WORDLIKE}])[-−](?=\.?\p{{N}})", SIGN)
    pointed = F.regexp_replace(signed, r"(?<=\p{N})\.(?=\p{N})", POINT)
    bordered = F.regexp_replace(pointed, rf"(?<=\p{{N}})[^{WORDLIKE}{KEY}-{NULL}]+(?=\p{{N}})", BORDER)
    return F.regexp_replace(bordered, rf"[^{WORDLIKE}{KEY}-{NULL}]+", "")


def _images(value: Column) -> Column:
    one = lambda p: F.regexp_replace(
        F.regexp_replace(strip(F.lower(p)), r"[/\\\\]+", "/"), r"^(\./)+", ""
    )
    several = F.array_join(F.transform(F.from_json(value, "array<string>"), one), NEXT, NULL)
    return F.when(strip(value).startswith("["), F.coalesce(several, one(value))).otherwise(one(value))


def with_canonical_text(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds ``canonical``; keeps the JSON objects only.

    One projection a step, each column used more than once being computed in a step of its
    own, so that every line is parsed once and scanned once by each pattern.
    """
    parsed = lines.withColumn(
        "__parsed", F.map_entries(F.from_json(F.col(line), "map<string,string>", {"allowSingleQuotes": "false"}))
    ).where("__parsed IS NOT NULL")
    names = F.transform("__parsed", lambda e: e["key"])
    last = F.filter("__parsed", lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size("__parsed")), e["key"]))
    objects = parsed.withColumn("__objects", F.when(F.size(F.array_distinct(names)) < F.size(names), last).otherwise(F.col("__parsed")))
    marks = f"{KEY}{ENTRY}{NEXT}{SIGN}{POINT}{BORDER}{NULL}"
    bare = lambda text: F.translate(F.lower(text), marks, " " * len(marks))
    kept = lines.columns
    keyed = objects.select(
        *kept,
        F.sort_array(
            F.transform(
                "__objects",
                lambda e: F.struct(
                    F.regexp_replace(bare(e["key"]), rf"[^{WORDLIKE}]+", "").alias("k"), e["value"].alias("v")
                ),
            )
        ).alias("__entries"),
    )
    parted = keyed.select(
        *kept,
        F.array_join(
            F.transform(
                F.filter("__entries", lambda e: e["k"] != "imagename"),
                lambda e: F.concat(e["k"], F.lit(KEY), F.coalesce(bare(e["v"]), F.lit(NULL))),
            ),
            ENTRY,
        ).alias("__others"),
        F.array_join(
            F.transform(
                F.filter("__entries", lambda e: e["k"] == "imagename"),
                lambda e: F.concat(F.lit(KEY), F.coalesce(_images(e["v"]), F.lit(NULL))),
            ),
            "",
        ).alias("__images"),
    )
    return parted.select(*kept, F.concat(fuse(F.col("__others")), F.lit(ENTRY), F.col("__images")).alias("canonical"))


def survivors(df: DataFrame, id_col: str = "raw_id", text_col: str = "record") -> DataFrame:
    """Distinct lines with first id, count, fingerprint and canonical text."""
    lines = df.select(F.col(id_col).cast("long").alias("raw_id"), F.col(text_col).alias("line")).where("line IS NOT NULL")
    distinct = lines.groupBy("line").agg(F.min("raw_id").alias("raw_id"), F.count("*").alias("n"))
    l1, l2 = fingerprint(F.col("line"))
    return with_canonical_text(distinct).select(
        "raw_id", "n", l1.alias("l1"), l2.alias("l2"), "canonical"
    )


def collapse(survived: DataFrame) -> DataFrame:
    """One row for each record: canonical, first_id, n_copies, n_writings."""
    return survived.groupBy("canonical").agg(
        F.min("raw_id").alias("first_id"), F.sum("n").alias("n_copies"), F.count("*").alias("n_writings")
    )


def formatting_duplicates(df: DataFrame, id_col: str = "raw_id", text_col: str = "record") -> DataFrame:
    """(first_id, raw_id): every further member of each group of equal records.

    A line that occurs once is itself the member; only lines delivered more than once are
    looked up in the input again, by fingerprint. Hot lines and hot records sit on the
    probed side of plain inner joins, where AQE splits skewed partitions.
    """
    survived = written(survivors(df, id_col, text_col))
    groups = collapse(survived).where("n_copies > 1").select("canonical", "first_id")
    placed = survived.join(groups, "canonical")
    once = placed.where("n = 1").select("first_id", "raw_id")
    often = placed.where("n > 1").select("l1", "l2", "first_id")
    l1, l2 = fingerprint(F.col(text_col))
    again = (
        df.where(F.col(text_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("raw_id"), l1.alias("l1"), l2.alias("l2"))
        .join(often, ["l1", "l2"])
        .select("first_id", "raw_id")
    )
    return once.unionByName(again).where("raw_id <> first_id")


def collapsed_records(df: DataFrame, id_col: str = "raw_id", text_col: str = "record") -> DataFrame:
    """One row for each record with the number of its copies and of its writings."""
    return collapse(survivors(df, id_col, text_col)).select("first_id", "n_copies", "n_writings")
