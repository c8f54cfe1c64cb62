"""Alignment of two tokenizers against a plain walk over both token lists."""

from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from costlake.llm import alignment
from costlake.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
RANKS = tokenizer_path("byte_bpe_50k.tiktoken")

TEXTS = [
    "The quick brown fox jumps over the lazy dog. " * 3, "", None, "x", " ", "  two  blanks ", "a\nb\tc\r\n\n d",
    "Grüße aus Köln, naïve café — déjà vu", "<|endoftext|> is plain <s> text </s>", "▁ is no blank", "日本語の文 と emoji 🙂🙂",
    "The quick brown fox", "The quick brown fox", "zero​width ﻿mark", "\x00 nul", "aaaaaaaaaaaaaaaaaaaaaaaa", "1234567 89.0",
    "word " * 400, "".join(chr(33 + i % 90) for i in range(500)),
]


def brute(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = True
    m = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = alignment._byte_alphabet()
    rows, links = [], []
    for text in texts:
        a = b = []
        if text:
            a = t.encode(" " + text, add_special_tokens=False).ids
            b = m.encode(text)
        bytes_a = [bytes(shown[c] for c in t.id_to_token(i)) if i < 50256 else b"?" for i in a]
        bytes_b = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()
                   for i in b]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            rows.append([0, 0, 0, 0, ""])
            links.append(Counter())
            continue
        spans_a = [(sum(map(len, bytes_a[:i])), sum(map(len, bytes_a[:i + 1]))) for i in range(len(a))]
        spans_b = [(sum(map(len, bytes_b[:i])), sum(map(len, bytes_b[:i + 1]))) for i in range(len(b))]
        found = Counter((a[i], b[j]) for i, x in enumerate(spans_a) for j, y in enumerate(spans_b)
                        if max(x[0], y[0]) < min(x[1], y[1]))
        groups, i, j = [], 0, 0
        for end in sorted({e for _, e in spans_a} & {e for _, e in spans_b}):
            k = next(n for n, s in enumerate(spans_a) if s[1] == end) + 1
            n = next(n for n, s in enumerate(spans_b) if s[1] == end) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:n])))
            i, j = k, n
        rows.append([len(a), len(b), len(groups), sum(found.values()), sha256(";".join(groups).encode()).hexdigest()])
        links.append(found)
    count = Counter(p for found in links for p in found)
    top = {}
    for (a, _), n in count.items():
        top[a] = max(n, top.get(a, 0))
    for row, found in zip(rows, links):
        row += [sum(n for p, n in found.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in found.items())]
    return rows, count, sum(links, Counter())


def test_every_count_equals_a_plain_walk(spark):
    expected, count, links = brute(TEXTS)
    df = spark.createDataFrame(
        [(i if i != 3 else None, t, "z", 7) for i, t in enumerate(TEXTS)],
        "doc_id long, text string, block string, n_links int").repartition(3)
    docs, pairs = alignment.align(df, A, B, RANKS)
    key = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    got = {r.doc_id: [r[k] for k in key] for r in docs.collect()}
    assert got == {i if i != 3 else None: row for i, row in enumerate(expected)}
    assert {(r.a, r.b): (r.n_docs, r.n_links) for r in pairs.collect()} == {
        p: (n, links[p]) for p, n in count.items()}


def test_repeated_rows_are_documents_of_their_own(spark):
    texts = ["same text here"] * 5
    expected, _, _ = brute(texts)
    docs, _ = alignment.align(spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string"), A, B)
    assert [[r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum] for r in docs.collect()] == expected


def test_empty_table(spark):
    docs, pairs = alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert docs.count() == 0 and pairs.count() == 0


def test_long_texts_are_cut_without_a_trace():
    rng = np.random.default_rng(1)
    words = ["alpha", "Straße", "x1", "(note)", "  ", "\n", "hyper-word", "日本"]
    text = " ".join(words[i] for i in rng.integers(0, len(words), 4000))
    assert "".join(alignment.pieces_of(text, 300)) == " " + text and len(list(alignment.pieces_of(text, 300))) > 30
    outcomes = []
    for most in (1 << 20, 300):
        pair = alignment.tokenizers_of(A, B, RANKS)
        work = alignment._Indexer(pair, 0, 3_000_000, 1000 if most == 300 else 2 << 20)
        original = alignment.pieces_of
        alignment.pieces_of = lambda t, m=most: original(t, m)
        try:
            rows = [*work.put(1, text), *work.put(2, "tail"), *work.put(3, text + " ▁"), *work.close()]
        finally:
            alignment.pieces_of = original
        outcomes.append(pa.Table.from_batches(rows).to_pylist())
    assert outcomes[0] == outcomes[1]
    assert outcomes[0][0]["n_a"] > 8000 and outcomes[0][2]["n_a"] == 0


@pytest.mark.parametrize("size", [0, 1, 4095, 4096, 65536])
def test_bitmaps_return_their_members(size):
    slots = np.sort(np.random.default_rng(size).choice(65536, size, replace=False)).astype("<u2")
    groups = np.concatenate([np.zeros(2, np.int64), np.full(size, 1), np.full(1, 3)])
    every = np.concatenate([np.array([5, 9], "<u2"), slots, np.array([65535], "<u2")])
    offsets, data = alignment.containers(groups, every, 4)
    back = alignment.members(alignment._binary(offsets, data))
    order = np.lexsort((back[1], back[0]))
    assert (back[0][order] == groups).all() and (back[1][order] == every).all()
