"""Packing token sequences into windows by non-negative least squares.

Every document is a run of token ids.  Its full windows are sequences as they are.  What is left over,
the tail, is shorter than a window; shallow combinations of tail lengths that fill a window (or a power of
two, which is not padded) are enumerated, the repeat counts that best use up the histogram of
tail lengths are solved for by non-negative least squares, and rounded to whole counts that the
histogram allows.  The residual tails are cut into power-of-two parts, which pack greedily, largest first,
into windows without a gap.

Only the histogram (window - 1 counts) reaches the driver.  Tails meet their places by rank: the rank of a
tail among those of its length is the count in earlier input splits plus its number in its own, so no
length is gathered anywhere, however common it is.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from costlake.llm import tokens
from costlake.llm.common import slices, text_of, written

_TAIL_BASE, _PART_BASE = 1 << 60, 1 << 61


def cuts(n: int, window: int) -> list[tuple[int, int, int]]:
    """(kind, start, length) of all pieces that a run of ``n`` ids may be cut into: 0 full windows, 1 the
    tail, 2 the tail's power-of-two parts, largest first."""
    full = n - n % window
    pieces = [(0, at, window) for at in range(0, full, window)]
    at, left = full, n - full
    if left:
        pieces.append((1, full, left))
        while left:
            size = 1 << (left.bit_length() - 1)
            pieces.append((2, at, size))
            at, left = at + size, left - size
    return pieces


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def ids_of(ids: np.ndarray) -> np.ndarray:
    return ids.astype(np.int32)


def _lists(values: pa.Array, lengths: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), values)


def cut_documents(docs: DataFrame, path: str, window: int, value: Callable[[np.ndarray], object],
                  value_type: str, end_id: int = 0, ranks: str | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(``doc_id``, ``doc_tokens``, ``fulls``, ``pieces``): the ids of each whole text and ``end_id``, cut every way that
    packing may ask for, each piece with ``value`` of its ids; ``fulls`` are the full windows of earlier rows of the task.

    Where values are arrays, parts of a tail have none: they are cut from the tail's when it is known which are used.
    ``path`` names a byte-level tokenizer, ``ranks`` may name the same vocabulary as ranks.  A null text is empty.
    """
    piece = f"struct<kind:tinyint,start:bigint,length:bigint,value:{value_type}>"

    def run(batches):
        own = tokens.encoder(path, "leading", ranks)
        end, fulls = np.array([end_id], own.dtype), 0
        sliced = value_type.startswith("array")
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                counts, per_row, pieces, values, before = [], [], [], [], []
                for raw in own.encode(part.column("text").to_pylist()):
                    ids = np.concatenate([np.frombuffer(raw, own.dtype), end])
                    own_pieces = cuts(len(ids), window)
                    counts.append(len(ids))
                    per_row.append(len(own_pieces))
                    pieces += own_pieces
                    values += [value(ids[s:s if sliced and kind == 2 else s + n]) for kind, s, n in own_pieces]
                    before.append(fulls)
                    fulls += len(ids) // window
                kinds, starts, lengths = np.array(pieces, np.int64).T
                if sliced:
                    held = _lists(pa.array(np.concatenate(values), pa.int32()), [len(v) for v in values])
                else:
                    held = pa.array(values, pa.int64())
                rows = pa.StructArray.from_arrays(
                    [pa.array(kinds, pa.int8()), pa.array(starts), pa.array(lengths), held],
                    names=["kind", "start", "length", "value"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(before, pa.int64()), _lists(rows, per_row)],
                    names=["doc_id", "doc_tokens", "fulls", "pieces"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, doc_tokens long, fulls long, pieces array<{piece}>")


def combinations(counts: np.ndarray, window: int, common: int = 64) -> np.ndarray:
    """Rows of one to three lengths (0: none) that fill a window or a smaller power of two.

    Single powers of two, all pairs for each target, and triples with two of the ``common`` most frequent
    lengths; every length has ``counts[length]`` tails, and lengths without any are left out.
    """
    have = np.nonzero(counts)[0]
    have = have[have > 0]
    there = np.zeros(window + 1, bool)
    there[have] = True
    rows = [(p, 0, 0) for p in (1 << i for i in range(window.bit_length() - 1)) if p < window and there[p]]
    targets = [window] + [t for t in (1 << i for i in range(3, window.bit_length())) if t < window]
    for target in targets:
        a = have[have <= target // 2]
        a = a[there[target - a]]
        rows += [(int(x), target - int(x), 0) for x in a]
    top = have[np.argsort(-counts[have], kind="stable")][:common]
    for i, x in enumerate(top):
        for y in top[i:]:
            z = window - int(x) - int(y)
            if z > 0 and there[z]:
                rows.append(tuple(sorted((int(x), int(y), z))))
    return np.array(sorted(set(rows)), np.int64).reshape(-1, 3)


def solve(combos: np.ndarray, counts: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """Repeat counts x >= 0 that minimise ``|A x - counts|``; column j of A counts the lengths of combination j.

    Accelerated projected gradient; A has three entries a column, so a round is two gathers.
    """
    size = len(counts)
    weight = (combos > 0).astype(float)

    def use(x: np.ndarray) -> np.ndarray:
        return np.bincount(combos.ravel(), (weight * x[:, None]).ravel(), size)

    def back(r: np.ndarray) -> np.ndarray:
        return (r[combos] * weight).sum(axis=1)

    step = 1.0 / max(back(use(np.ones(len(combos)))).max(), 1.0)  # rows of A'A sum to at least its norm
    x = np.zeros(len(combos))
    y, pace = x, 1.0
    for _ in range(rounds):
        fresh = np.maximum(0, y - step * back(use(y) - counts))
        quick = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        y = fresh + (pace - 1) / quick * (fresh - x)
        if np.abs(fresh - x).max(initial=0) < 1e-3:
            x = fresh
            break
        x, pace = fresh, quick
    return x


def rounded(combos: np.ndarray, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whole repeat counts within ``counts``: rounded in the order of their size, then as often as possible."""
    left = counts.astype(np.int64).copy()
    times = np.zeros(len(combos), np.int64)
    order = np.argsort(-x, kind="stable")
    for wanted in (np.rint(x).astype(np.int64), np.full(len(x), np.iinfo(np.int64).max)):
        for j in order:
            need: dict[int, int] = {}
            for length in combos[j]:
                if length:
                    need[int(length)] = need.get(int(length), 0) + 1
            k = min(int(wanted[j]), *(int(left[n]) // m for n, m in need.items()))
            if k > 0:
                times[j] += k
                for n, m in need.items():
                    left[n] -= k * m
    return times


def places(combos: np.ndarray, times: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (ranks at which each run of places ends, first sequence of the run, offset in it)."""
    first = np.cumsum(times) - times
    runs: dict[int, list[tuple[int, int, int]]] = {}
    for combo, k, base in zip(combos.tolist(), times.tolist(), first.tolist()):
        if not k:
            continue
        at = 0
        for length in combo:
            if length:
                runs.setdefault(length, []).append((k, base, at))
                at += length
    return {n: (np.cumsum([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
            for n, rows in runs.items()}


def _ranked(rows: DataFrame, by: str) -> DataFrame:
    """``rank`` (from 0) of each row among all of its ``by``: the rows of earlier splits, then its own split's."""
    per = rows.groupBy(by, "split").count()
    before = per.withColumn("before", F.sum("count").over(
        Window.partitionBy(by).orderBy("split").rowsBetween(Window.unboundedPreceding, -1))).drop("count")
    inside = Window.partitionBy(by, "split").orderBy("row", "piece.start")
    return (rows.withColumn("inside", F.row_number().over(inside) - 1).join(before, [by, "split"])
            .withColumn("rank", F.col("inside") + F.coalesce("before", F.lit(0))).drop("inside", "before"))


def pack(cut: DataFrame, window: int = 1024) -> DataFrame:
    """The pieces of ``cut_documents`` rows with their places.

    (``doc_id``, ``start``, ``length``, ``value``, ``doc_tokens``, ``sequence_id``, ``offset``): every id of a
    document lies in exactly one piece, pieces of a sequence follow each other from offset 0 without a
    gap, and a sequence is full or a power of two long.  ``window`` must be a power of two.  Repeated rows
    are packed as often as they come, a null id is kept; an empty table packs into nothing.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    rows = written(cut.withColumn("row", F.monotonically_increasing_id()), "cut")
    rows = rows.withColumn("split", F.shiftright("row", 33).cast("int"))

    def of(kind: int) -> DataFrame:
        """Places and sizes of pieces, without what is in them."""
        wanted = F.transform(F.filter("pieces", lambda p: p.kind == kind), lambda p: F.struct(
            p["start"].alias("start"), p["length"].alias("length")))
        return rows.select("row", "split", F.explode(wanted).alias("piece"))

    full = F.posexplode(F.filter("pieces", lambda p: p.kind == 0)).alias("no", "piece")
    whole = rows.select("doc_id", "doc_tokens", "split", "fulls", full).select(
        "doc_id", F.col("piece.start").alias("start"), F.col("piece.length").alias("length"),
        F.col("piece.value").alias("value"), "doc_tokens",
        (F.shiftleft(F.col("split").cast("long"), 34) + F.col("fulls") + F.col("no") + 1).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))

    tails = of(1).withColumn("size", F.col("piece.length"))
    counts = np.zeros(window + 1, np.int64)
    for size, n in tails.groupBy("size").count().collect():  # window - 1 rows
        counts[size] = n
    combos = combinations(counts, window)
    times = rounded(combos, solve(combos, counts), counts) if len(combos) else np.zeros(0, np.int64)
    taken = np.bincount(combos.ravel(), np.repeat(times, 3), len(counts)).astype(np.int64)
    residual = np.maximum(counts - np.where(np.arange(len(counts)) > 0, taken, 0), 0)
    at = cut.sparkSession.sparkContext.broadcast((places(combos, times), taken))  # at most 3 runs a combination

    def place(batches):
        where, used = at.value
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, ranks = (np.asarray(batch.column(c)) for c in ("size", "rank"))
            sequence, offset = np.full(len(sizes), -1, np.int64), np.zeros(len(sizes), np.int64)
            for size in np.unique(sizes):
                mine = np.nonzero((sizes == size) & (ranks < used[size]))[0]
                if len(mine):
                    ends, base, shift = where[int(size)]
                    run = np.searchsorted(ends, ranks[mine], side="right")
                    begun = np.where(run > 0, ends[np.maximum(run - 1, 0)], 0)
                    sequence[mine] = _TAIL_BASE + base[run] + ranks[mine] - begun
                    offset[mine] = shift[run]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("size"), pa.array(sequence), pa.array(offset)],
                names=["row", "size", "sequence_id", "offset"])

    ranked = _ranked(tails.select("row", "split", "size", "piece"), "size").select("row", "size", "rank")
    placed = written(ranked.mapInArrow(place, "row long, size long, sequence_id long, offset long"), "placed")
    fitted = of(1).join(placed.where("sequence_id >= 0"), "row").select("row", F.struct(
        F.lit(1).alias("kind"), "piece.start", "piece.length", "sequence_id", "offset").alias("place"))

    # the residual tails' parts: an order by size leaves every part on a multiple of its own size
    parts = of(2).join(placed.where("sequence_id < 0").select("row"), "row").withColumn(
        "size", F.col("piece.length"))
    powers = [1 << i for i in reversed(range(window.bit_length() - 1))]
    lengths = np.arange(len(residual))
    have = {p: int(residual[(lengths & p) > 0].sum()) for p in powers}
    total = sum(p * n for p, n in have.items())
    begins, sofar = [], 0
    for p in powers:
        begins.append((p, sofar))
        sofar += p * have[p]
    begin = F.coalesce(*[F.when(F.col("size") == p, F.lit(b).cast("long")) for p, b in begins])
    place_at = begin + F.col("rank") * F.col("size")
    last = total - total % window
    ends, left = [], total - last  # the last window ends short: it becomes one sequence per power of two
    edge = last
    while left:
        p = 1 << (left.bit_length() - 1)
        ends.append(edge)
        edge, left = edge + p, left - p
    base: Column = F.col("at") - F.col("at") % window
    for e in ends:
        base = F.when(F.col("at") >= e, F.lit(e).cast("long")).otherwise(base)
    loose = _ranked(parts, "size").withColumn("at", place_at).withColumn("base", base).select("row", F.struct(
        F.lit(2).alias("kind"), "piece.start", "piece.length",
        (F.lit(_PART_BASE).cast("long") + F.col("base")).alias("sequence_id"),
        (F.col("at") - F.col("base")).alias("offset")).alias("place"))
    # a tail's places, at most one a power of two, meet its contents once
    found = fitted.unionByName(loose).groupBy("row").agg(F.collect_list("place").alias("places"))
    whats = rows.select("row", "doc_id", "doc_tokens", F.get(F.filter("pieces", lambda p: p.kind == 1), 0).alias("tail"),
                        F.filter("pieces", lambda p: p.kind == 2).alias("parts")).where("tail is not null")
    here, start, length = F.col("tail"), F.col("place.start"), F.col("place.length")
    if isinstance(cut.schema["pieces"].dataType.elementType["value"].dataType, T.ArrayType):
        part = F.slice(here["value"], (start - here["start"] + 1).cast("int"), length.cast("int"))
    else:
        part = F.get(F.filter("parts", lambda p: p.start == start), 0)["value"]
    held = whats.join(found, "row").withColumn("place", F.explode("places")).select(
        "doc_id", start.alias("start"), length.alias("length"),
        F.when(F.col("place.kind") == 1, here["value"]).otherwise(part).alias("value"), "doc_tokens",
        "place.sequence_id", "place.offset")
    return whole.unionByName(held)
