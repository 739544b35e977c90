"""Cuts inside words keep the ids of whole texts."""

import random

import pytest

from mossgrid.llm.tokens import TOKENIZER, Encoder, cuttable, inner_pairs

tokenizers = pytest.importorskip("tokenizers")
BITS = ["'", "'s", "'re", "'ll", "a", "S", "don", "x", "7", "42", ".", "...", "-", '"', "(", " ", "\n", "é", "—", "日", "½", "_", "\x00", "\x7f", "ſ", "'ſ"]


def test_random_mixtures():
    source = open(TOKENIZER, encoding="utf-8").read()
    whole = tokenizers.Tokenizer.from_str(source)
    whole.encode_special_tokens = True
    r = random.Random(11)
    texts = ["".join(r.choice(BITS) for _ in range(r.randint(0, 25))) for _ in range(20_000)]
    parts = Encoder(source).batch(texts)
    assert [[i for f in p for i in f] for p in parts] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_words_are_cut():
    encoder = Encoder(open(TOKENIZER, encoding="utf-8").read())
    assert encoder.pattern.findall("a (3.5mm), don't—x") == ["a", " (", "3", ".", "5", "mm", "),", " don't—x"]


def test_joined_bytes_are_no_cuts():
    assert cuttable(inner_pairs(["a.", "1", "bĠ"]))[0] == "cdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
