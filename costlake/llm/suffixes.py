"""Burrows-Wheeler transforms of many strings, and their merge by interleave refinement.

A shard's transform lists, in the order of its suffixes, the character before each suffix.  Shards are
merged without sorting suffixes again: an interleave says which rows of which shards follow each other in the
merged order, and one refinement, a stable distribution of the rows by their characters, makes an
interleave that is right for k symbols right for k + 1.  Rows that agree in k symbols form a block; where a
block splits at round k + 1 the common prefix of its parts is k long.  After ``depth`` rounds the blocks are
the repeated intervals: the classes of equal ``depth``-byte strings.
"""

from __future__ import annotations

import numpy as np

END = 0xFF  # no byte of UTF-8
_UPTO = np.array([2**64 - 2**(56 - 8 * i) for i in range(8)], np.uint64)  # the first i + 1 bytes; those after an end do not count


def transform(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(characters before the sorted suffixes, suffix starts in the joined text) of one shard.

    Each string has an end mark of its own; end marks sort after all bytes and among themselves by string.
    Sorting is by eight bytes first, then by doubling the compared length until every rank is its own.
    """
    joined = np.frombuffer(b"".join(s + b"\xff" for s in strings), np.uint8)
    n = len(joined)
    lengths = np.array([len(s) + 1 for s in strings])
    to_mark = np.repeat(np.cumsum(lengths) - 1, lengths) - np.arange(n)
    key = np.concatenate([joined, np.zeros(8, np.uint8)]).astype(np.uint64)
    for k in (1, 2, 4):
        key = key[:-k] << np.uint64(8 * k) | key[k:]
    key = key[:n] & _UPTO[np.minimum(to_mark, 7)]
    order = np.argsort(key)
    same = np.append(False, key[order[1:]] == key[order[:-1]])
    ended = to_mark[order] < 8
    tied = same & ended
    tied[:-1] |= tied[1:]
    at = np.nonzero(tied)[0]  # equal ends go in the order of their strings
    order[at] = np.sort(np.cumsum(~same)[at] * n + order[at]) % n
    first = ~same | ended
    rank = np.empty(n, np.int64)  # the place at which a suffix's group of equals begins
    rank[order] = np.nonzero(first)[0][np.cumsum(first) - 1]
    at, width = np.nonzero(~first | np.append(~first[1:], False))[0], 8
    while len(at):  # the groups of equal ranks only
        some = order[at]
        pair = rank[some] * n + rank[some + width]
        inner = np.argsort(pair)
        some, pair = some[inner], pair[inner]
        order[at] = some
        first = np.append(True, pair[1:] != pair[:-1])
        rank[some] = at[first][np.cumsum(first) - 1]
        at = at[~first | np.append(~first[1:], False)]
        width *= 2
    return np.roll(joined, 1)[order], order


def repeated(shards: list[tuple[np.ndarray, np.ndarray]], depth: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, block) of the rows, numbered over all shards in turn, whose first ``depth`` symbols come twice.

    ``rows`` are the suffixes that ``depth`` symbols of their string stand before: what the rounds make of any other
    would reach over the start of its string.  The interleave holds those of them that lie in intervals that are not
    settled.  An interval of one row is: whatever stands before it stays alone.  A row of a shard leads to the row of the
    suffix one symbol longer by the shard's own transform, so no suffix is compared with another.  A block that splits
    at round k has a common prefix of k - 1 symbols in its parts.
    """
    chars = np.concatenate([b for b, _ in shards])
    longer, base = [], 0
    for before, _ in shards:
        step = np.empty(len(before), np.int64)
        step[np.argsort(before, kind="stable")] = np.arange(len(before))
        longer.append(step + base)
        base += len(before)
    longer = np.concatenate(longer).astype(np.int32 if base < 2**31 else np.int64)
    rows = rows.astype(longer.dtype)
    block = np.zeros(len(rows), np.int32)
    # two symbols a round, as the distribution of 16-bit keys costs as much as that of 8-bit ones
    twice, pairs = longer[longer], chars.astype(np.uint16) << 8 | chars[longer]
    for k in [1] * (depth % 2) + [2] * (depth // 2):
        if not len(rows):
            break
        read, step = (pairs, twice) if k == 2 else (chars, longer)
        read = read[rows]
        order = np.argsort(read, kind="stable")
        read, block, rows = read[order], block[order], step[rows[order]]
        edge = np.ones(len(rows), bool)
        edge[1:] = (read[1:] != read[:-1]) | (block[1:] != block[:-1])
        twin = ~edge
        twin[:-1] |= ~edge[1:]
        block = np.cumsum(edge, dtype=np.int32)[twin]
        rows = rows[twin]
    return rows, block


def smallest_owner(strings: list[bytes], owners: np.ndarray, depth: int, shard_bytes: int = 1 << 16
                   ) -> list[np.ndarray]:
    """For each string and each of its ``depth``-byte windows, the smallest owner of a string that has the window."""
    shards, spans, at, held = [], [], 0, 0
    total = sum(map(len, strings)) + len(strings)
    shard_bytes = max(shard_bytes, -(-total // 200))
    for i, s in enumerate(strings):
        held += len(s) + 1
        if held >= shard_bytes or i == len(strings) - 1:
            shards.append(transform(strings[at:i + 1]))
            spans.append((at, i + 1))
            at, held = i + 1, 0
    lengths = np.array([len(s) for s in strings])
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    shift = np.repeat([begins[a] for a, _ in spans], [len(b) for b, _ in shards])
    least = np.repeat(owners, lengths + 1).astype(np.int64)
    starts = np.concatenate([o for _, o in shards]) + shift
    within = np.arange(total) - np.repeat(begins[:-1], lengths + 1)
    rows, block = repeated(shards, depth, np.nonzero(within[starts] >= depth)[0])
    if len(rows):
        start = starts[rows]
        cuts = np.nonzero(np.concatenate([[True], block[1:] != block[:-1]]))[0]
        lowest = np.minimum.reduceat(least[start], cuts)
        least[start] = np.repeat(lowest, np.diff(np.append(cuts, len(block))))
    return [least[b:b + max(n - depth + 1, 0)] for b, n in zip(begins[:-1].tolist(), lengths.tolist())]
