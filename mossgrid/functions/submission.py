"""Parsers of model output for submission files; a family of their own.

A null output is read as empty, and a submission never lacks an answer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mossgrid.functions.fields import strip

# Patterns of boxes, confidences, list marks and labels.
BOX = r"\[(\d+),\s*(\d+),\s*(\d+),\s*(\d+)\]"
# Words that open a report section, by section.
HEADERS = {
    "findings": ["findings:", "finding:"],
    "impression": ["impression:", "impressions:", "conclusion:"],
    "recommendations": ["recommendation:", "recommendations:", "suggest:"],
}


def confidence(output: Column) -> Column:
    """First percentage or ``confidence:`` value, as a share; null where none."""
    lower = F.lower(output)
    hit = r"(\d+)%|confidence:?\s*(\d*\.?\d+)"
    value = F.coalesce(
        F.nullif(F.regexp_extract(lower, hit, 1), F.lit("")), F.nullif(F.regexp_extract(lower, hit, 2), F.lit(""))
    ).try_cast("double")
    return F.when(value > 1, value / 100).otherwise(value)


def letter(output: Column) -> Column:
    """First capital A to K that stands alone, else the trimmed output."""
    raw = strip(F.coalesce(output, F.lit("")))
    hit = F.regexp_extract(raw, r"\b([A-K])\b", 1)
    return F.when(hit != "", hit).otherwise(raw)


def findings(output: Column) -> Column:
    """Lines without list marks that are longer than three characters, joined by ``; ``."""
    raw = F.coalesce(output, F.lit(""))
    lines = F.transform(F.split(strip(raw), "\n"), lambda x: F.regexp_replace(strip(x), r"^[-•*\d.]+\s*", ""))
    kept = F.filter(lines, lambda x: F.length(x) > 3)
    return F.when(F.size(kept) > 0, F.array_join(kept, "; ")).otherwise(strip(raw))


def box_list(output: Column) -> Column:
    """Boxes as ``[a,b,c,d]`` joined by ``; ``, else the trimmed output."""
    raw = F.coalesce(output, F.lit(""))
    hits = F.transform(F.regexp_extract_all(raw, F.lit(BOX), F.lit(0)), lambda x: F.regexp_replace(x, r"\s+", ""))
    return F.when(F.size(hits) > 0, F.array_join(hits, "; ")).otherwise(strip(raw))


def box_label(before: Column) -> Column:
    """Label of a box from the text before it."""
    hit = F.regexp_extract(before, r"(\w+[\w\s]*)\s*:?\s*$", 1)
    return F.when(hit != "", strip(hit)).otherwise("abnormality")


def labelled_boxes(output: Column) -> Column:
    """Boxes of an output in order with the label that stands before each."""
    raw = F.coalesce(output, F.lit(""))
    hits = F.regexp_extract_all(raw, F.lit(BOX), F.lit(0))
    before = F.split(raw, BOX)
    numbers = lambda hit: F.transform(F.regexp_extract_all(hit, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("bigint"))
    return F.transform(hits, lambda hit, i: F.struct(box_label(F.get(before, i)).alias("label"), numbers(hit).alias("box")))


def first_count(output: Column) -> Column:
    """First run of digits, else zero, as text."""
    hit = F.regexp_extract(F.coalesce(output, F.lit("")), r"(\d+)", 1)
    return F.when(hit != "", hit.try_cast("decimal(38,0)").cast("string")).otherwise("0")


def sections(output: Column) -> Column:
    """Findings, impression and recommendations of a report.

    A line that holds a header opens its section and is dropped whole; other lines are
    trimmed and joined to the open section. The first section is open at the start; if all
    stay empty, the whole text is the findings.
    """
    raw = F.coalesce(output, F.lit(""))
    start = F.struct(
        F.lit("findings").alias("open"), *[F.lit("").alias(name) for name in HEADERS]
    )

    def step(state: Column, line: Column) -> Column:
        opened = F.lit(None).cast("string")
        for name, words in reversed(HEADERS.items()):
            hit = F.lit(False)
            for word in words:
                hit = hit | F.lower(line).contains(word)
            opened = F.when(hit, name).otherwise(opened)
        text = strip(line)
        joined = [
            F.when(opened.isNull() & (state["open"] == name) & (text != ""), F.btrim(F.concat(state[name], F.lit(" "), text)))
            .otherwise(state[name])
            .alias(name)
            for name in HEADERS
        ]
        return F.struct(F.coalesce(opened, state["open"]).alias("open"), *joined)

    def finish(state: Column) -> Column:
        empty = (state["findings"] == "") & (state["impression"] == "") & (state["recommendations"] == "")
        return F.struct(
            F.when(empty, strip(raw)).otherwise(state["findings"]).alias("findings"),
            state["impression"].alias("impression"),
            state["recommendations"].alias("recommendations"),
        )

    return F.aggregate(F.split(raw, "\n"), start, step, finish)


def answer(key: Column, output: Column) -> Column:
    """The submitted answer for a submission key; never null."""
    raw = F.coalesce(output, F.lit(""))
    return (
        F.when(key == "classification", letter(raw))
        .when(key == "multi_label", findings(raw))
        .when(key == "detection", box_list(raw))
        .when(key == "counting", first_count(raw))
        .otherwise(strip(raw))
    )
