"""Encoding of whole corpora with a public byte-level tokenizer.

Forced boundaries: a pair of bytes that occurs inside no token of the vocabulary can be
bridged by no merge, so a text may be cut there and its fragments encoded on their own. The
tokenizer also splits texts by a pattern before it merges, so a cut must leave that alone.
Two kinds do. Before white space: where a character that is no white space precedes, the
pattern ends a piece as well; within a run of white space it takes all but the last
character as one piece wherever the run is cut. And between letters, digits and symbols of
one byte, where the pattern ends a piece unless an apostrophe stands there. Fragments are
words, numbers and symbols with the white space before them. Corpora repeat them, so each
task encodes a fragment once.

Cases: a null and an empty text have no ids. The strings of special tokens are ordinary
text. Texts and fragments of any length are encoded whole. Repeated rows are kept.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = os.environ.get("MOSSGRID_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
#: Fragments a task remembers, and the longest that it does.
REMEMBERED, REMEMBERED_CHARS = 200_000, 64
WHITE = " \t\n\r"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable bytes for
    themselves, the others from code point 256 on in their order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def inner_pairs(vocabulary: list[str]) -> set[tuple[int, int]]:
    """Pairs of bytes that occur next to each other inside some token."""
    alphabet, pairs = byte_alphabet(), set()
    for token in vocabulary:
        codes = [alphabet.get(c) for c in token]
        pairs.update(zip(codes, codes[1:], strict=False))
    return pairs


def cuttable(pairs: set[tuple[int, int]]) -> list[str]:
    """Letters, digits and symbols of one byte that no token joins with one of another of
    these kinds or with white space behind it. An apostrophe is left out: the pattern takes
    it together with some letters."""
    kinds = [string.ascii_letters, string.digits, string.punctuation.replace("'", "")]

    def free(c: str, kind: str) -> bool:
        others = [ord(o) for k in kinds if k != kind for o in k]
        return not any((ord(c), o) in pairs or (o, ord(c)) in pairs for o in others) and not any((ord(c), ord(w)) in pairs for w in WHITE)

    return ["".join(c for c in kind if free(c, kind)) for kind in kinds]


def cut_pattern(vocabulary: list[str]) -> re.Pattern:
    """A pattern whose matches are the fragments between forced boundaries.

    A fragment is a run of white space and what follows it up to the next boundary. No cut is
    made after a character whose last byte some token joins with white space.
    """
    pairs, white = inner_pairs(vocabulary), [ord(c) for c in WHITE]
    joined = sorted({b for b in range(256) if b not in white and any((b, w) in pairs for w in white)})
    inside = re.escape(WHITE)
    kinds = [re.escape(k) for k in cuttable(pairs) if k]
    short = "".join(
        rf"[{inside}]*[{kind}]+(?=[{inside}{''.join(k for k in kinds if k != kind)}]|\Z)|" for kind in kinds
    )
    if not joined:
        return re.compile(rf"{short}[{inside}]*[^{inside}]+|[{inside}]+")
    # Last bytes of two-byte characters are 0x80 and their code point's low six bits;
    # characters of three and four bytes are all taken as joined.
    never = "".join(
        [re.escape(chr(b)) for b in joined if b < 0x80]
        + [chr(c) for c in range(0x80, 0x800) if 0x80 | (c & 0x3F) in joined]
        + ["\u0800-\U0010ffff"]
    )
    return re.compile(rf"{short}[{inside}]*(?:[^{inside}]+|(?<=[{never}])[{inside}]+)+|[{inside}]+")


class Encoder:
    """Encodes texts by fragments; built once a task from the tokenizer's JSON."""

    def __init__(self, source: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.encode_special_tokens = True
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.pattern = cut_pattern([t for t in self.tokenizer.get_vocab() if t not in special])
        self.known: dict[str, list[int]] = {}

    def batch(self, texts: list[str | None]) -> list[list[list[int]]]:
        """For each text the ids of its fragments in order."""
        parts = [self.pattern.findall(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        new = list(dict.fromkeys(f for f in chain.from_iterable(parts) if f not in known))
        found = dict(zip(new, (e.ids for e in self.tokenizer.encode_batch(new, add_special_tokens=False)), strict=True))
        long = {f for f in new if len(f) > REMEMBERED_CHARS}
        known.update(found)
        result = [[known[f] for f in p] for p in parts]
        for f in long:
            del known[f]
        return result


#: Characters of text that are encoded at a time: bounds a task's memory.
CHUNK_CHARS = 4_000_000


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= CHUNK_CHARS:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _source(df: DataFrame, path: str):
    """The tokenizer's file as a broadcast: a few MB, whatever the data."""
    with open(path, encoding="utf-8") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, ids): one row for each row of ``df``; null and empty texts have no ids."""
    source = _source(df, tokenizer)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(source.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for begin, end in _chunks(texts):
                ids, ends = [], [0]
                for fragments in encoder.batch(texts[begin:end]):
                    ids.extend(chain.from_iterable(fragments))
                    ends.append(len(ids))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(begin, end - begin), lists], ["id", "ids"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def count_tokens(df: DataFrame, keep: list[str], *, text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of each row."""
    source = _source(df, tokenizer)
    rows = df.select(*keep, F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(source.value)
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            counts = [
                sum(map(len, fragments)) for begin, end in _chunks(texts) for fragments in encoder.batch(texts[begin:end])
            ]
            columns = [batch.column(k) for k in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], [*keep, "n_tokens"])

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(run, f"{kinds}, n_tokens long")
