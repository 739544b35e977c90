"""Normal forms of the record fields: words, category names, image paths, study keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a maximal run of letters and digits.
NOT_WORD = r"[^\p{L}\p{N}]+"
#: White space of all kinds, as text for trimming.
BLANKS = (
    " \t\n\r\f\v\u0085             "
    "    　"
)


def words(text: Column) -> Column:
    """Words of a text in order, in lower case; null stays null."""
    return F.array_remove(F.split(F.lower(text), NOT_WORD), "")


def word_text(text: Column) -> Column:
    """The words of a text joined by single spaces; null stays null."""
    return F.btrim(F.regexp_replace(F.lower(text), NOT_WORD, " "))


def strip(text: Column) -> Column:
    """Without outer white space of any kind."""
    return F.btrim(text, F.lit(BLANKS))


def category(name: Column) -> Column:
    """Category name in the form in which equal names are equal; blank names are null."""
    bare = F.translate(strip(F.lower(name)), "-_", "  ")
    return F.when(F.trim(bare) != "", bare)


def _listed(raw: Column) -> Column:
    return F.from_json(raw, "array<string>")


def image_paths(field: Column) -> Column:
    """Paths named by an image field: a single path or a list of paths written as text.

    Lists may use either quote. A text that only looks like a list counts as one path;
    null, blank and empty entries are left out, so the result is never null.
    """
    raw = strip(field)
    single = F.when(raw != "", F.array(raw)).otherwise(F.array().cast("array<string>"))
    several = F.filter(F.transform(_listed(raw), strip), lambda p: p.isNotNull() & (p != ""))
    return F.when(raw.startswith("["), F.coalesce(several, single)).otherwise(single)


def file_name(path: Column) -> Column:
    """Lower-case file name of a path with either kind of slash."""
    return strip(F.substring_index(F.translate(F.lower(path), "\\", "/"), "/", -1))


def file_names(field: Column) -> Column:
    """Lower-case file names of an image field, folders left out, distinct and sorted.

    A single path, the usual case, takes no higher-order function.
    """
    raw = strip(field)
    name = file_name(raw)
    single = F.when(name != "", F.array(name)).otherwise(F.array().cast("array<string>"))
    several = F.filter(F.transform(_listed(raw), file_name), lambda n: n.isNotNull() & (n != ""))
    return F.when(raw.startswith("["), F.coalesce(F.sort_array(F.array_distinct(several)), single)).otherwise(single)


def with_file_names(df: DataFrame, field: str, out: str) -> DataFrame:
    """Adds :func:`file_names` of a field, one projection a step: a nested expression would
    evaluate the steps it uses more than once again each time."""
    named = df.withColumn("__raw", strip(F.col(field))).withColumn("__name", file_name(F.col("__raw")))
    none = F.array().cast("array<string>")
    single = F.when(F.col("__name") != "", F.array("__name")).otherwise(none)
    several = F.filter(F.transform(_listed(F.col("__raw")), file_name), lambda n: n.isNotNull() & (n != ""))
    names = F.when(F.col("__raw").startswith("["), F.coalesce(F.sort_array(F.array_distinct(several)), single)).otherwise(single)
    return named.withColumn(out, names).drop("__raw", "__name")


def with_study_keys(df: DataFrame, field: str, out: str) -> DataFrame:
    """Adds :func:`study_keys` of a field, one projection a step."""
    named = with_file_names(df, field, "__names").withColumn("__first", F.get("__names", F.lit(0)))
    keyed = named.withColumn("__key", study_key(F.col("__first")))
    none = F.array().cast("array<string>")
    one = F.when(F.col("__key") != "", F.array("__key")).otherwise(none)
    many = F.sort_array(F.array_distinct(F.filter(F.transform("__names", study_key), lambda k: k != "")))
    keys = F.when(F.size("__names") == 1, one).when(F.size("__names") > 1, many).otherwise(none)
    return keyed.withColumn(out, keys).drop("__names", "__first", "__key")


def study_key(name: Column) -> Column:
    """A file's name up to its last underscore; without one, its name without extension."""
    return F.when(
        F.instr(name, "_") > 0,
        F.substring(name, F.lit(1), F.length(name) - F.length(F.substring_index(name, "_", -1)) - 1),
    ).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


def study_keys(field: Column) -> Column:
    """Distinct study keys of an image field in alphabetical order."""
    names = file_names(field)
    key = study_key(F.element_at(names, 1))
    one = F.when(key != "", F.array(key)).otherwise(F.array().cast("array<string>"))
    many = F.sort_array(F.array_distinct(F.filter(F.transform(names, study_key), lambda k: k != "")))
    return F.when(F.size(names) == 1, one).when(F.size(names) > 1, many).otherwise(F.array().cast("array<string>"))
