"""Removal of repeated byte strings against brute force."""

import random

import numpy as np
import pytest

from costlake.llm import substrings, suffixes

WIDTH = 50


def brute(rows, width=WIDTH):
    late = 2**63 - 1
    rows = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in rows:
        for i in range(len(b) - width + 1):
            k = b[i:i + width]
            first[k] = min(first.get(k, late), late if d is None else d)
    out = []
    for d, b in rows:
        keep = bytearray(b"\1" * len(b))
        for i in range(len(b) - width + 1):
            if first[b[i:i + width]] < (late if d is None else d):
                keep[i:i + width] = bytes(width)
        out.append((d, b, bytes(keep)))
    return sorted(out, key=str)


def removed(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "'k' as skey", "2 as ids")
    got = substrings.remove_repeats(
        docs, lambda i, raw, keep: (i, raw, keep.astype(np.uint8).tobytes()), "doc_id long, raw binary, keep binary", **how)
    return sorted(((r.doc_id, bytes(r.raw), bytes(r.keep)) for r in got.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    words = ["alpha", "beta", "gämma", "δelta", "e", "zeta", "漢字", "theta", "1234", "\n"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    base, line = text(150), text(14)
    rows = []
    for i in range(70):
        kind = i % 7
        if kind == 0:
            t = base
        elif kind == 1:
            cut = rng.randrange(len(base))
            t = base[:cut] + "#" + base[cut + 3:]
        elif kind == 2:
            t = text(30) + line + text(20)
        elif kind == 3:
            t = "ab" * rng.randrange(20, 300)
        elif kind == 4:
            t = "x" * rng.randrange(45, 200) + line[:60]
        elif kind == 5:
            t = line[rng.randrange(10):][:rng.randrange(45, 55)]
        else:
            t = text(rng.randrange(60))
        rows.append((rng.randrange(10**6) + 2**60 * (i % 2), t))
    return rows + [(3, None), (4, ""), (None, base), (None, line + "?"), rows[7], (rows[8][0], base), (2**62, text(20000))]


@pytest.mark.parametrize("how", [{}, {"block_bytes": 3000, "bucket_bytes": 4000}, {"hot": 1}, {"width": 20}])
def test_against_brute_force(spark, rows, how):
    assert removed(spark, rows, **how) == brute(rows, how.get("width", WIDTH))


def test_empty(spark):
    assert removed(spark, []) == []
    assert removed(spark, [(1, ""), (2, None)]) == brute([(1, ""), (2, None)])


def test_merged_transforms_equal_sorted_suffixes():
    rng = random.Random(2)
    for _ in range(30):
        strings = [bytes(rng.choice(b"ab\x00z") for _ in range(rng.randrange(0, 40))) for _ in range(rng.randrange(1, 12))]
        owners = np.array([rng.randrange(50) for _ in strings])
        got = suffixes.smallest_owner(strings, owners, 5, shard_bytes=rng.choice([1, 30, 1000]))
        for s, least in zip(strings, got):
            want = [min(int(o) for t, o in zip(strings, owners) if s[i:i + 5] in t) for i in range(len(s) - 4)]
            assert least.tolist() == want


@pytest.mark.parametrize("width", [16, 20, 50, 64, 90])
def test_equal_windows_have_equal_minimizers(width):
    rng = random.Random(width)
    shared = bytes(rng.randrange(97, 101) for _ in range(3 * width))
    least = [substrings.minimizers(np.frombuffer(bytes(rng.randrange(256) for _ in range(n)) + shared, np.uint8), width)[n:]
             for n in (0, 7, 500)]
    assert len(least[0]) == 2 * width + 1
    assert all((x == least[0]).all() for x in least)


def test_owner_runs():
    least = np.array([4, 4, 4, 9, 2, 2, 9, 7])
    lowest, runs = substrings._owner_runs(least, np.array([3, 4, 1]))
    assert lowest.tolist() == [4, 2, 7]
    assert [None if r is None else np.frombuffer(r, np.int64).reshape(-1, 2).tolist() for r in runs] == [
        None, [[0, 9], [1, 2], [3, 9]], None]
