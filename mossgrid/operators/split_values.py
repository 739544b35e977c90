"""Several values packed in one field, split into one row each with their place.

Delimiters and quoting are not uniform and legitimate values may contain both, so fields
are not cut at delimiters. A multi-pattern automaton finds every occurrence of a known
value, dynamic programming picks the occurrences that cover most of the field with the
fewest values, and only what lies between them is cut at delimiters.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most known values a dictionary may hold; it is sent to every task.
MAX_TERMS = 1_000_000
#: Distinct fields whose result a task keeps.
REMEMBERED = 50_000

APOSTROPHE = re.compile(r"(?<=[^\W_])(?:\\?['’]|'')(?=[^\W_])")
QUOTES = re.compile(r"[\"'`“”„‘’«»\\]+")
DELIMITERS = re.compile(r"[,;|/+&\n；，、·•()\[\]{}<>]+|\s[-–—]\s")
EDGE = " .:\t-–—*"


def _plain(text: str) -> str:
    """Lower case, quotes gone, blanks single; tabs and line ends become line ends."""
    text = QUOTES.sub(" ", APOSTROPHE.sub("", text.lower()))
    return re.sub(r" *\n[ \n]*", "\n", re.sub(r"[^\S\n]+", " ", re.sub(r"[\t\r\v\f]", "\n", text))).strip()


class Segmenter:
    """Splits fields by a dictionary of known whole values."""

    def __init__(self, terms: list[str]) -> None:
        self.automaton = ahocorasick.Automaton()
        for term in sorted(terms, reverse=True):  # of equal plain forms the first in order wins
            plain = _plain(term)
            if plain:
                self.automaton.add_word(plain, (plain, term))
        self.empty = len(self.automaton) == 0
        if not self.empty:
            self.automaton.make_automaton()

    def _cover(self, text: str) -> list[tuple[int, int, str]]:
        """Occurrences of the best cover, in order: most characters, then fewest values."""
        found = []
        for last, (plain, term) in self.automaton.iter(text):
            begin, end = last + 1 - len(plain), last + 1
            if begin and plain[0].isalnum() and text[begin - 1].isalnum():
                continue
            if end < len(text) and plain[-1].isalnum() and text[end].isalnum():
                continue
            found.append((begin, end, term))
        if len(found) < 2:
            return found
        # The automaton reports by end, so the best cover up to each end is final when read.
        ends, best = [0], [(0, 0)]  # (characters, -values) of the best cover up to that end
        chosen: list[tuple | None] = [None]
        for begin, end, term in found:
            i = bisect_right(ends, begin) - 1
            score = (best[i][0] + end - begin, best[i][1] - 1)
            if score > best[-1]:
                ends.append(end)
                best.append(score)
                chosen.append((i, begin, end, term))
        cover, i = [], len(ends) - 1
        while chosen[i] is not None:
            i, *occurrence = chosen[i]
            cover.append(tuple(occurrence))
        return cover[::-1]

    def split(self, text: str | None) -> list[tuple[str, bool]]:
        """(value, known) in order; known values as the dictionary writes them."""
        if text is None:
            return []
        text = _plain(text)
        values: list[tuple[str, bool]] = []
        at = 0
        for begin, end, term in [*(() if self.empty else self._cover(text)), (len(text), len(text), None)]:
            for rest in DELIMITERS.split(text[at:begin]):
                rest = rest.strip(EDGE)
                if any(c.isalnum() for c in rest):
                    values.append((rest, False))
            if term is not None:
                values.append((term, True))
            at = end
        return values


def split_values(df: DataFrame, terms: DataFrame, *, id_col: str, value_col: str, term_col: str = "term") -> DataFrame:
    """(id, pos, val, known): one row for each value of ``value_col``, pos from 1.

    Values of the dictionary come as it writes them. Text that belongs to no known value is
    cut at delimiters and given in lower case with ``known`` false; a value of which only a
    part is known is given as that part and the rest. Repeats stay, empty places count
    nothing. A null or blank field, and a field of marks only, have no row; an empty
    dictionary makes every value unknown. Fields of any length are read whole.
    """
    rows = terms.select(F.col(term_col).alias("t")).where("t IS NOT NULL").distinct().limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} known values")
    known = df.sparkSession.sparkContext.broadcast([r["t"] for r in rows])  # at most MAX_TERMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter, seen = Segmenter(known.value), {}
        for batch in batches:
            ids, places, values, flags = [], [], [], []
            for key, text in zip(batch.column("id").to_pylist(), batch.column("field").to_pylist(), strict=True):
                found = seen.get(text)
                if found is None:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    found = seen[text] = segmenter.split(text)
                for place, (value, is_known) in enumerate(found, 1):
                    ids.append(key)
                    places.append(place)
                    values.append(value)
                    flags.append(is_known)
            columns = [pa.array(ids, batch.column("id").type), pa.array(places, pa.int64()), pa.array(values, pa.string()), pa.array(flags, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "pos", "val", "known"])

    fields = df.select(F.col(id_col).alias("id"), F.col(value_col).cast("string").alias("field")).where("field IS NOT NULL")
    kind = fields.schema["id"].dataType.simpleString()
    return fields.mapInArrow(run, f"id {kind}, pos long, val string, known boolean").withColumnRenamed("id", id_col)
