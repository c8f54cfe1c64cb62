"""The word-wise encoder against the tokenizers library itself."""

import random

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from costlake.llm import tokens

FILES = {"byte_bpe_50k.json": "leading", "word_bpe_49k.json": "dropped"}
ALPHABET = ["a", "B", "\u00e9", "e\u0301", "\u0301", "\u00df", "\u0130", "\u03a3", "1", "\u00b2", "'s", "'", "#", "$", " ", "  ", "\n", "\t", "\r",
            "\x0b", "\x1c", "\x85", "\xa0", "\u180e", "\u200b", "\u2028", "\ufeff", "\u6f22", "\U0001f600", "<|endoftext|>", "the",
            "<|startoftext|>", " the", "\x00", "x" * 70]


@pytest.fixture(scope="module", params=[("byte_bpe_50k.json", None), ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"),
                                        ("word_bpe_49k.json", None)])
def pair(request):
    name, ranks = request.param
    return tokens.Encoder(P.path(name), FILES[name], ranks and P.path(ranks)), Tokenizer.from_file(P.path(name))


def check(pair, texts):
    own, library = pair
    got = [np.frombuffer(b, own.dtype).tolist() for b in own.encode(texts)]
    for text, ids in zip(texts, got):
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_random_mixtures(pair):
    rng = random.Random(11)
    check(pair, ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(14))) for _ in range(6000)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=8))
def test_any_text(pair, texts):
    check(pair, [t.encode("utf-8", "replace").decode() for t in texts])


def test_every_plain_character_beside_others(pair):
    plain = [chr(c) for c in range(33, 256) if tokens._PLAIN.fullmatch(chr(c).encode())]
    rng = random.Random(4)
    check(pair, [f"q {a}{b} {a}x{b}\n{b} {a}{a}'s{b}" for a in plain for b in rng.sample(plain, 12)])


def test_tables(pair):
    own, library = pair
    rows = __import__("pyarrow.parquet").parquet.read_table("/root/testdata/sf0.001/documents.parquet")
    check(pair, [t or "" for t in rows.column("text").to_pylist()])
    own.most = 10
    check(pair, ["", " ", "one two", "one  two three", "one two " * 3000])
