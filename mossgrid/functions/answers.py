"""Parsers of model output for evaluation: text in, typed value out, as pure expressions.

All parsers but the report's work on :func:`cleaned` text. A null output is read as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mossgrid.functions.fields import strip

BOXES = "array<array<bigint>>"
INSTANCES = f"map<string,{BOXES}>"

# Phrases of an answer that only talks about counting.
NO_COUNT_YET = [
    "to accurately count", "to provide an accurate count", "to count the cells", "we need to", "i would need to",
    "to determine", "to estimate", "follow these steps", "carefully examine", "inspect each",
]
# Patterns that state a count, in order.
STATED_COUNT = [
    r"count.*?(?:is|are|equals?|totals?)\s*:?\s*(\d+)",
    r"(?:total|number|count)\s*(?:is|are|equals?|of)?\s*:?\s*(\d+)",
    r"(\d+)\s*cells?\s*(?:visible|present|identified|counted)",
    r"approximately\s*(\d+)",
    r"estimated?\s*(\d+)",
]
# Patterns of bare counts, of boxes and of numbers.
BARE_COUNT = r"(?i)(?<!step\s)(?<!\d\.\s)(?<!procedure\s)(\d+)(?!\.\s)"
BOX = r"\[?\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\]?"
SINGLE_BOX = r"\[\s*\[\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\]\s*\]"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def cleaned(output: Column) -> Column:
    """What follows the last assistant mark and the last ``Answer:``."""
    raw = F.coalesce(output, F.lit(""))
    spoken = (
        F.when(raw.contains("assistant\n"), strip(F.substring_index(raw, "assistant\n", -1)))
        .when(F.lower(raw).contains("assistant:"), strip(F.regexp_replace(raw, r"(?is)^.*assistant:", "")))
        .otherwise(raw)
    )
    # Each step holds the one before it once: nested cases would repeat it many times over.
    for mark in ("system\n", "user\n"):
        spoken = F.regexp_replace(spoken, rf"(?sU)^{mark}\s*(.*?)\s*$", "$1")
    return F.regexp_replace(spoken, r"(?sU)^.*Answer:\s*(.*?)\s*$", "$1")



# The patterns of letters, lists and numbers in the parsers below.
def choice(text: Column) -> Column:
    """Classification: the first letter A to E that stands alone, else the last word."""
    letter = F.regexp_extract(F.upper(text), r"\b([A-E])(?:[.)\s]|$)", 1)
    last = F.regexp_extract(text, r"(?U)(\S+)\s*$", 1)
    return F.regexp_replace(F.when(letter != "", letter).otherwise(last), "(?U)^[\\s.,:'\"]+|[\\s.,:'\"]+$", "")


def _pieces(text: Column, mark: str) -> Column:
    return F.filter(F.transform(F.split(text, mark), strip), lambda x: x != "")


def labels(text: Column) -> Column:
    """Multi-label: a bracketed list, else pieces between semicolons, else between commas."""
    inside = F.regexp_extract(text, r"\[([^\]]+)\]", 1)
    listed = F.transform(
        F.when(inside.contains(";"), _pieces(inside, ";")).otherwise(_pieces(inside, ",")),
        lambda x: F.btrim(x, F.lit("'\"")),
    )
    plain = F.when(text.contains(";"), _pieces(text, ";")).otherwise(_pieces(text, ","))
    bare = F.filter(F.transform(plain, lambda x: F.btrim(x, F.lit("'\".,;"))), lambda x: x != "")
    return F.when(inside != "", listed).when(F.size(bare) > 0, bare).otherwise(F.array(strip(text)))


def _fields(text: Column) -> Column:
    """Entries of a JSON object, null for any other text. Of a key that is repeated the last
    value counts, at the place of the first."""
    whole = F.when(text.startswith("{") & text.endswith("}"), text)
    entries = F.map_entries(F.from_json(whole, "map<string,string>", {"allowSingleQuotes": "false"}))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = F.transform(names, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1))
    return F.when(F.size(names) < F.size(entries), last).otherwise(entries)


def _whole(boxes: Column) -> Column:
    """Boxes in whole numbers; a box with a number that is none of 64 bits is left out."""
    cut = F.transform(boxes, lambda box: F.transform(box, lambda x: x.try_cast("bigint")))
    return F.filter(cut, lambda box: ~F.exists(box, lambda x: x.isNull()))


def instances(text: Column) -> Column:
    """Instance detection: a JSON object of box lists by name; anything else is empty."""
    def boxes(value: Column) -> Column:
        several = F.from_json(value, "array<array<double>>")
        flat = F.from_json(value, "array<double>")
        fits = (F.size(several) > 0) & (F.size(F.get(several, F.lit(0))) == 4)
        return F.when(fits, _whole(several)).when(F.size(flat) == 4, _whole(F.array(flat)))

    kept = F.filter(F.transform(_fields(text), lambda e: F.struct(e["key"], boxes(e["value"]))), lambda e: e["col2"].isNotNull())
    return F.coalesce(F.map_from_entries(kept), F.create_map().cast(INSTANCES))


def boxes(text: Column) -> Column:
    """Detection: boxes of a JSON object, else doubly bracketed single boxes, else any four
    whole numbers between commas."""
    none = F.array().cast("array<array<double>>")
    four = lambda v: F.filter(F.coalesce(F.from_json(v, "array<array<double>>"), none), lambda b: F.size(b) == 4)
    of_object = F.flatten(F.transform(_fields(text), lambda e: _whole(four(e["value"]))))

    def found(pattern: str) -> Column:
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.transform(hits, lambda h: F.transform(F.regexp_extract_all(h, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("bigint")))

    single = found(SINGLE_BOX)
    return F.when(of_object.isNotNull(), of_object).when(F.size(single) > 0, single).otherwise(found(BOX))


def _most(text: Column, pattern: str) -> Column:
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.array_max(F.transform(hits, lambda x: x.try_cast("decimal(38,0)")))


def count(text: Column) -> Column:
    """Counting: the largest count of the first pattern that states one, else the largest
    bare number; small numbers only where they are the only one. Null where none."""
    lower = F.lower(text)
    undecided = F.lit(False)
    for phrase in NO_COUNT_YET:
        undecided = undecided | lower.contains(phrase)
    hits = F.transform(F.regexp_extract_all(text, F.lit(BARE_COUNT), F.lit(1)), lambda x: x.try_cast("decimal(38,0)"))
    bare = F.array_max(F.filter(hits, lambda n: (n > 10) | (F.size(hits) == 1)))
    whole = F.when(text.rlike(NUMBER), text.try_cast("double").try_cast("decimal(38,0)"))
    return F.when(~undecided, F.coalesce(*[_most(lower, p) for p in STATED_COUNT], bare, whole))


def measure(text: Column) -> Column:
    """Regression: the first percentage, else the first number; null where none."""
    percent = F.nullif(F.regexp_extract(text, r"(-?\d+\.?\d*)\s*%", 1), F.lit(""))
    number = F.nullif(F.regexp_extract(text, r"(-?\d+\.?\d*)", 1), F.lit(""))
    return F.coalesce(percent, number).try_cast("double")


def report(text: Column) -> Column:
    return strip(text)


def reference_number(reference: Column) -> Column:
    """A reference of counting or regression as a number; null where it is none."""
    return F.when(reference.rlike(NUMBER), reference.try_cast("double"))
