"""Long exact spans shared between records, and how much of each record is shared.

A character is shared if it lies in a span of at least ``length`` characters that occurs
verbatim in another record; that is, in a window of exactly ``length`` characters that
does. Windows are the suffixes of all texts, cut at that depth of the suffix tree: two
suffixes meet in a node as deep as ``length`` if their windows are equal.

1. Suffixes are partitioned by a prefix of the tree's path. As a plain first prefix would
   ship every suffix of the corpus, each window is filed under the run of ``length/2``
   characters that is least by hash within it. Equal windows file under equal prefixes.
   Neighbouring windows of one prefix form a stretch, which is named by its place: about two
   for each hundred characters of common text, one for a whole periodic text.
2. Prefixes that occur in one record only are dropped after counting; of the rest the text
   of each stretch is cut out once, of equal texts for one of them only.
3. Groups of one prefix are packed into tasks. In a group, windows are named by hash, a name
   of two records is a deep node, and its windows are compared character by character.
4. A group too large for memory is split by longer prefixes, level by level up to the full
   depth. At each level equal texts collapse into one, in Spark and by their characters; what
   no other record has is cut into shorter stretches, and goes on only where the characters
   that all its windows have in common occur elsewhere.

Cases: null, empty and short texts share nothing, neither do rows without id. Repeated rows of one id are one record; if
its texts differ, the one with most shared characters counts. White space counts; characters
are code points. Texts of any length are read whole. Equal texts are told by length and
SHA-256; all other equality is that of characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mossgrid.plans.runtime import spread, written

LENGTH = 200
#: Stretches of one prefix that are handled in memory, counted at one and a half lengths each.
GROUP_ROWS = 8_000
#: Characters that a task handles at a time: texts when they are cut, groups when compared.
CUT_CHARS, GROUP_CHARS = 150_000, 600_000
#: Characters that are compared or given out at a time.
CHUNK = 4_000_000
#: Windows of a stretch at each level of a large group.
LEVELS = (128, 16, 4, 1)

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@cache
def _code_words() -> np.ndarray:
    """A random word for each code point."""
    return _mix(np.arange(0x110000, dtype=np.uint64) + BASE)


class _Powers:
    """Powers of the base and of its inverse, as many as were asked for."""

    size = 0

    @classmethod
    def up_to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > cls.size:
            cls.size = max(n, 2 * cls.size, CUT_CHARS)
            with np.errstate(over="ignore"):
                cls.both = [
                    np.cumprod(np.concatenate([[np.uint64(1)], np.full(cls.size - 1, b, np.uint64)]), dtype=np.uint64)
                    for b in (BASE, np.uint64(pow(int(BASE), -1, 1 << 64)))
                ]
        return cls.both[0][:n], cls.both[1][:n]


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k codes, in linear time: differences of prefix sums, brought to a
    common power. Arithmetic is modulo 2**64."""
    n = len(codes)
    if n < k:
        return np.zeros(0, np.uint64)
    powers, inverse = _Powers.up_to(n)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_code_words()[codes] * powers, dtype=np.uint64, out=sums[1:])
        return _mix((sums[k:] - sums[:-k]) * inverse[: n - k + 1])


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each run of w values, by running values over blocks of w."""
    n = len(x) - w + 1
    blocks = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def stretches(texts: list[str], length: int) -> tuple[np.ndarray, ...]:
    """(text, begin, n, prefix) of the stretches of texts that are long enough: n
    neighbouring windows from ``begin`` on have the same least prefix."""
    k = length // 2
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    hashes = rolling(codes_of("".join(texts)), k)
    least = _least(hashes, length - k + 1)
    # Windows that begin in one text and end in the next are no windows.
    counts = sizes - length + 1
    at = np.arange(counts.sum()) + np.repeat(first - (np.cumsum(counts) - counts), counts)
    text = np.repeat(np.arange(len(texts)), counts)
    prefix = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (prefix[1:] != prefix[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(at)))
    return text[begin], at[begin] - first[text[begin]], n, prefix[begin].view(np.int64)


def simple_stretches(piece: str, begin: int, prefix: int, length: int) -> list[tuple[list[int], int, int, str]]:
    """(begins, n, lead, text) of the parts of a stretch in which the first occurrence of the
    prefix stays the same; ``lead`` is its distance from the first window. Equal parts, of
    which periodic texts have many, are given once."""
    hashes = rolling(codes_of(piece), length // 2).view(np.int64)
    windows = np.arange(len(piece) - length + 1)
    at = np.flatnonzero(hashes == prefix)
    at = at[np.searchsorted(at, windows)]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    parts: dict[tuple[int, str], list[int]] = {}
    for i, n in zip(first.tolist(), np.diff(np.append(first, len(at))).tolist(), strict=True):
        parts.setdefault((int(at[i]) - i, piece[i : i + n + length - 1]), []).append(begin + i)
    return [(begins, len(text) - length + 1, lead, text) for (lead, text), begins in parts.items()]


def _portions(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose sizes sum up to about ``most``."""
    begin = held = 0
    for i, size in enumerate(sizes):
        held += size
        if held >= most:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


def _stretch_rows(length: int, names: list[str]):
    """Stretches of texts, with those of their columns that are named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions = batch.column("id").to_numpy(), batch.column("v").to_numpy()
            texts = batch.column("text").to_pylist()
            for begin, end in _portions([len(t) for t in texts], CUT_CHARS):
                of, at, n, prefix = stretches(texts[begin:end], length)
                columns = {
                    "id": ids[begin + of], "v": versions[begin + of], "begin": at.astype(np.int32), "n": n.astype(np.int32), "prefix": prefix,
                }
                yield pa.RecordBatch.from_arrays([pa.array(columns[c]) for c in names], names)

    return run


PIECES = {"id": pa.int64(), "v": pa.int64(), "begin": pa.int32(), "n": pa.int32(), "prefix": pa.int64(), "piece": pa.string()}
PARTS = {"id": pa.int64(), "v": pa.int64(), "begins": pa.list_(pa.int32()), "n": pa.int32(), "lead": pa.int32(), "piece": pa.string()}


def _piece_rows(length: int, parts: bool):
    """The text of each stretch, all its windows; or of its simple parts."""
    schema = pa.schema(PARTS if parts else PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0

            def out() -> pa.RecordBatch:
                arrays = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
                return pa.RecordBatch.from_arrays(arrays, schema=schema)

            for key, v, text, places in zip(*(batch.column(c) for c in ("id", "v", "text", "places")), strict=True):
                key, v, text = key.as_py(), v.as_py(), text.as_py()
                for p in places.as_py():
                    begin, n = p["begin"], p["n"]
                    piece = text[begin : begin + n + length - 1]
                    if parts:
                        rows.extend((key, v, *part) for part in simple_stretches(piece, begin, p["prefix"], length))
                    else:
                        rows.append((key, v, begin, n, p["prefix"], piece))
                    size += len(piece)
                    if size > CHUNK:
                        yield out()
                        rows, size = [], 0
            if rows:
                yield out()

    return run


def _equal(codes: np.ndarray, at: np.ndarray, partner: np.ndarray, length: int) -> np.ndarray:
    """Whether each window equals its partner, by all characters.

    Neighbouring windows with neighbouring partners are compared as one span.
    """
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (partner[1:] != partner[:-1] + 1)
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(at))) + length - 1
    good = np.empty(len(first), bool)
    for begin, end in _portions(sizes.tolist(), CHUNK):
        part, ends = sizes[begin:end], np.cumsum(sizes[begin:end])
        step = np.arange(ends[-1]) - np.repeat(ends - part, part)
        same = codes[np.repeat(at[first[begin:end]], part) + step] == codes[np.repeat(partner[first[begin:end]], part) + step]
        good[begin:end] = np.logical_and.reduceat(same, ends - part)
    return good[np.cumsum(new) - 1]


def _merge(ids: np.ndarray, versions: np.ndarray, starts: np.ndarray, length: int) -> pd.DataFrame:
    """Window starts of texts as intervals: neighbouring windows are joined."""
    order = np.lexsort((starts, versions, ids))
    ids, versions, starts = ids[order], versions[order], starts[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (versions[1:] != versions[:-1]) | (starts[1:] > starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first, len(ids))[1:] - 1
    return pd.DataFrame({"id": ids[first], "v": versions[first], "begin": starts[first], "end": starts[last] + length})


def shared_in_groups(frame: pd.DataFrame, length: int) -> pd.DataFrame:
    """Intervals (id, v, begin, end) of the windows that occur in another record.

    ``frame``: id, v, begin, n, prefix, piece; whole groups of prefixes.
    """
    n = frame["n"].to_numpy().astype(np.int64)
    ids, sizes = frame["id"].to_numpy(), n + length - 1
    codes = codes_of("".join(frame["piece"]))
    row = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(row)) - (np.cumsum(n) - n)[row]
    at = (np.cumsum(sizes) - sizes)[row] + offset
    with np.errstate(over="ignore"):
        name = rolling(codes, length)[at] + _mix(frame["prefix"].to_numpy().view(np.uint64))[row]
    # One sort brings the windows of a node together.
    order = np.argsort(name, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = name[order[1:]] != name[order[:-1]]
    first, owner = np.flatnonzero(new), ids[row[order]]
    low, high = np.minimum.reduceat(owner, first), np.maximum.reduceat(owner, first)
    node = np.cumsum(new) - 1
    # Each window of a deep node is compared with one of another record.
    one_low, one_high = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
    is_low, is_high = (owner == low[node])[::-1], (owner == high[node])[::-1]
    one_low[node[::-1][is_low]] = order[::-1][is_low]
    one_high[node[::-1][is_high]] = order[::-1][is_high]
    other = np.where(owner == low[node], one_high[node], one_low[node])
    deep = (low != high)[node]
    window, partner, of = order[deep], other[deep], node[deep]
    back = np.argsort(window)
    window, partner, of = window[back], partner[back], of[back]
    good = _equal(codes, at[window], at[partner], length)
    if not good.all():  # unequal windows of one name: their nodes are told apart by the characters
        texts: dict[bytes, set] = {}
        doubtful = np.flatnonzero(np.isin(of, of[~good]))
        keys = [codes[a : a + length].tobytes() for a in at[window[doubtful]].tolist()]
        for key, i in zip(keys, ids[row[window[doubtful]]].tolist(), strict=True):
            texts.setdefault(key, set()).add(i)
        good[doubtful] = [len(texts[key]) > 1 for key in keys]
    window = window[good]
    starts = frame["begin"].to_numpy().astype(np.int64)[row[window]] + offset[window]
    return _merge(ids[row[window]], frame["v"].to_numpy()[row[window]], starts, length)


def _group_rows(length: int):
    """Takes rows sorted by prefix; handles whole groups, many at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            if sum(map(len, held)) < 1000 and batch["prefix"].iloc[0] == batch["prefix"].iloc[-1]:
                continue
            frame = pd.concat(held, ignore_index=True)
            prefix = frame["prefix"].to_numpy()
            borders = np.flatnonzero(prefix[1:] != prefix[:-1]) + 1
            sizes = np.cumsum(frame["n"].to_numpy().astype(np.int64) + length)
            begin = 0
            for i, border in enumerate(borders.tolist()):
                if sizes[border - 1] - (sizes[begin - 1] if begin else 0) >= GROUP_CHARS or i == len(borders) - 1:
                    yield shared_in_groups(frame.iloc[begin:border].reset_index(drop=True), length)
                    begin = border
            held = [frame.iloc[begin:]]
        if held:
            yield shared_in_groups(pd.concat(held, ignore_index=True), length)

    return run


def _blocks(rows: DataFrame, size: int, length: int) -> DataFrame:
    """Stretches cut into such of at most ``size`` windows, where the distance from the prefix
    passes a multiple of it, and ``core``: what all windows between two multiples have in
    common, at the same place of all texts."""
    low, high = F.floor((F.col("lead") - F.col("n") + 1) / size), F.floor(F.col("lead") / size)
    cut = rows.withColumn("b", F.explode(F.sequence(low, high)))
    k = F.greatest(F.lit(0), F.col("lead") - (F.col("b") + 1) * size + 1)
    end = F.least(F.col("n") - 1, F.col("lead") - F.col("b") * size)
    placed = cut.withColumns({"k": k.cast("int"), "m": (end - k + 1).cast("int")})
    core = F.substring(F.col("piece"), (F.col("lead") - F.col("b") * size + 1).cast("int"), F.lit(max(1, length - size + 1)))
    return placed.select(
        "id", "v", F.transform("begins", lambda x: x + F.col("k")).alias("begins"), F.col("m").alias("n"), (F.col("lead") - F.col("k")).alias("lead"),
        F.substring(F.col("piece"), F.col("k") + 1, F.col("m") + length - 1).alias("piece"), "done", core.alias("core"),
    )


def _by_text(rows: DataFrame, text: str) -> DataFrame:
    """One row for each text: least and greatest id, and whether any or all rows are done."""
    return rows.groupBy(F.xxhash64(text).alias("h"), text).agg(
        F.min("id").alias("a"), F.max("id").alias("z"), F.max("done").alias("some"), F.min("done").alias("all"),
        F.min("lead").alias("lead"), F.min("n").alias("n"),
    )


def shared_in_large_groups(pieces: DataFrame, length: int) -> DataFrame:
    """Intervals of the windows that occur in another record, for groups of any size.

    ``pieces``: id, v, begins, n, lead, piece. A text found in two records is done: all its
    windows are shared. It goes on once, for texts that have some of its windows only.
    """
    found: list[DataFrame] = []
    columns = ["id", "v", "begins", "n", "lead", "piece", "done"]
    rows = written(_blocks(pieces.withColumn("done", F.lit(False)), LEVELS[0], length).select(*columns))
    for size in (*LEVELS[1:], 0):
        texts = _by_text(rows, "piece").withColumn("shared", (F.col("a") != F.col("z")) | F.col("some"))
        placed = rows.withColumn("h", F.xxhash64("piece")).join(texts.select("h", "piece", "shared"), ["h", "piece"]).where("NOT done")
        begins = placed.where("shared").select("id", "v", F.explode(F.col("begins").cast("array<bigint>")).alias("begin"), "n")
        found.append(begins.select("id", "v", "begin", (F.col("begin") + F.col("n") + (length - 1)).alias("end")))
        if not size:
            break
        stand_ins = texts.where("shared").select(
            F.col("a").alias("id"), F.lit(0).cast("long").alias("v"), F.array(F.lit(0)).alias("begins"), "n", "lead", "piece", F.lit(True).alias("done")
        )
        longer = placed.where("NOT shared").select(*columns).unionByName(stand_ins)
        cores = _blocks(longer, size, length)
        # Only what occurs elsewhere too, and isn't all done, goes on.
        kept = _by_text(cores, "core").where("(a <> z OR some) AND NOT all").select("h", "core")
        rows = written(cores.withColumn("h", F.xxhash64("core")).join(kept, ["h", "core"], "left_semi").select(*columns))
        if rows.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


INTERVALS = "id long, v long, begin long, end long"


def shared_spans(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, shared_chars) of the texts with at least one shared span."""
    if length < 4:
        raise ValueError("spans are at least 4 characters long")
    texts = (
        df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        .where(F.col("id").isNotNull() & (F.length("text") >= length))
        .select("id", F.xxhash64("text").alias("v"), "text")
    )
    marks = texts.select("id", "v", F.unhex(F.sha2("text", 256)).alias("digest"), F.length("text").cast("long").alias("size"))
    classes = written(
        marks.groupBy("digest", "size").agg(F.min(F.struct("id", "v")).alias("first"), F.max("id").alias("last"))
    )
    # Equal texts: all of each is shared. The first of them stands for it below.
    equal = classes.where(F.col("first.id") != F.col("last")).select("digest", "size")
    copies = marks.join(equal, ["digest", "size"]).select("id", F.col("size").alias("shared_chars"))

    def runs(*names: str) -> DataFrame:
        kinds = {"id": "long", "v": "long", "begin": "int", "n": "int", "prefix": "long"}
        return texts.mapInArrow(_stretch_rows(length, list(names)), ", ".join(f"{c} {kinds[c]}" for c in names))

    shared = (
        runs("id", "n", "prefix")
        .groupBy("prefix")
        .agg(F.min("id").alias("a"), F.max("id").alias("z"), F.sum(F.col("n") + (length - 1)).alias("chars"))
        .where("a <> z")
    )
    groups = written(shared.select("prefix", (F.col("chars") > GROUP_ROWS * length * 3 // 2).alias("large")))

    def pieces(large: bool) -> DataFrame:
        """The texts of the stretches of the groups of one kind, as PIECES or as PARTS."""
        wanted = groups.where(F.col("large") == large).select("prefix")
        per_text = (
            runs("id", "v", "begin", "n", "prefix")
            .join(wanted, "prefix")
            .distinct()
            .groupBy("id", "v")
            .agg(F.collect_list(F.struct("begin", "n", "prefix")).alias("places"))  # as many as the text has
            .join(classes.select("first.id", "first.v"), ["id", "v"], "left_semi")
        )
        once = texts.groupBy("id", "v").agg(F.first("text").alias("text"))  # repeated rows
        kinds = "begins array<int>, n int, lead int" if large else "begin int, n int, prefix long"
        return once.join(per_text, ["id", "v"]).mapInArrow(_piece_rows(length, large), f"id long, v long, {kinds}, piece string")

    packed = spread(pieces(False), "prefix").sortWithinPartitions("prefix")
    intervals = packed.mapInPandas(_group_rows(length), INTERVALS)
    if not groups.where("large").isEmpty():
        intervals = intervals.unionByName(shared_in_large_groups(pieces(True), length))
    before = Window.partitionBy("id", "v").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached: Column = F.greatest("begin", F.coalesce(F.max("end").over(before), F.col("begin")))
    spans = (
        intervals.withColumn("gain", F.greatest(F.col("end") - reached, F.lit(0)))
        .groupBy("id", "v")
        .agg(F.sum("gain").alias("shared_chars"))
        .select("id", "shared_chars")
    )
    return spans.unionByName(copies).groupBy("id").agg(F.max("shared_chars").alias("shared_chars")).withColumnRenamed("id", id_col)
