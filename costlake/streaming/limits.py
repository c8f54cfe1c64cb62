"""Request bursts: which hits a limiter would have let through.

Whether a hit is accepted depends on which earlier hits were, so a limiter is a small state machine
per key.  In batch a key's hits are first cut wherever it stayed silent for longer than the window:
the state is empty there, so the pieces are independent and run in parallel.  Spark sorts the pieces
and streams them through the state machine in Arrow batches; pieces with no more hits than the limit
are accepted a batch at a time.  Memory per piece is at most ``limit`` time stamps.  What stays
serial is one key that never pauses for a whole window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from costlake.streaming.ordered import limited

#: Fixed values: (hits, seconds) of the default and the sign-in policy.
DEFAULT_POLICY, AUTH_POLICY = (100, 60), (10, 300)

_SLICE_MICROS = 600_000_000


class SlidingLog:
    """A ring of the last ``limit`` accepted hits; rejected hits are not recorded.

    Only the oldest of them matters: a hit passes if that one is older than the window, and takes its
    place.  A hit exactly one window old still counts.
    """

    def __init__(self, limit: int, micros: int, saved: tuple = ()) -> None:
        self.micros = micros
        self.ring = [None] * (limit - len(saved)) + list(saved)
        self.oldest = 0

    def hit(self, at: int) -> bool:
        if not self.ring:
            return False
        last = self.ring[self.oldest]
        if last is not None and last >= at - self.micros:
            return False
        self.ring[self.oldest] = at
        self.oldest = (self.oldest + 1) % len(self.ring)
        return True

    def state(self) -> list[int]:
        return [at for at in self.ring[self.oldest:] + self.ring[:self.oldest] if at is not None]


class FixedCounter:
    """A window opens with the first hit after the last one ended; rejected hits count too."""

    def __init__(self, limit: int, micros: int, saved: tuple = ()) -> None:
        self.limit, self.micros = limit, micros
        self.opened, self.hits = saved or (None, 0)

    def hit(self, at: int) -> bool:
        if self.opened is None or at >= self.opened + self.micros:
            self.opened, self.hits = at, 0
        self.hits += 1
        return self.hits <= self.limit

    def state(self) -> list[int]:
        return [] if self.opened is None else [self.opened, self.hits]


def quiet_pieces(hits: DataFrame, key: str, gap_micros: int) -> DataFrame:
    """Add ``_piece``: the start of the stretch of hits without a pause above ``gap_micros``.

    Works on slices of ten minutes per key, stitched through one row per key and slice, so that no task
    has to order the whole history of a hot key.
    """
    rows = hits.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    rows = rows.withColumn("_slice", F.floor(F.col("_us") / _SLICE_MICROS))
    inside = Window.partitionBy(key, "_slice").orderBy("_us")
    starts = F.when(F.col("_us") - F.col("_before") > gap_micros, F.col("_us"))
    marked = rows.withColumn("_before", F.lag("_us").over(inside)).withColumn("_start", starts)
    marked = marked.withColumn(
        "_start", F.max("_start").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    slices = marked.groupBy(key, "_slice").agg(
        F.min("_us").alias("_first"), F.max("_us").alias("_last"), F.max("_start").alias("_inner")
    )
    across = Window.partitionBy(key).orderBy("_slice")
    gap = F.col("_first") - F.lag("_last").over(across)
    opened = slices.withColumn(
        "_open", F.when(gap.isNull() | (gap > gap_micros), F.col("_first"))
    )
    carried = F.last(F.coalesce("_inner", "_open"), ignorenulls=True).over(
        across.rowsBetween(Window.unboundedPreceding, -1)
    )
    entry = opened.select(key, "_slice", F.coalesce("_open", carried).alias("_entry"))
    return marked.join(entry, [key, "_slice"]).withColumn(
        "_piece", F.coalesce("_start", "_entry")
    ).drop("_before", "_start", "_entry", "_slice")


def _run(hits: DataFrame, key: str, limit: int, seconds: int, machine) -> DataFrame:
    """``hits`` with ``accepted``; equal time stamps are served in the order of their other columns."""
    columns = hits.columns
    micros = seconds * 1_000_000
    # a sliding log keeps a hit that is exactly one window old, a counter does not
    gap = micros if machine is SlidingLog else micros - 1
    order = ["_us", *[c for c in columns if c not in (key, "ts")]]
    piece = Window.partitionBy(key, "_piece").orderBy(*order)
    whole = piece.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sized = (
        quiet_pieces(hits, key, gap).withColumn("_size", F.count("*").over(whole))
        .select(*columns, "_piece", "_us", "_size")
        .sortWithinPartitions(key, "_piece", *order)  # already so after the window: no second sort
    )
    schema = T.StructType(hits.schema.fields + [T.StructField("accepted", T.BooleanType())])

    def serve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            accepted = np.ones(len(batch), dtype=bool)
            # only pieces with more hits than the limit need the state machine
            busy = np.flatnonzero(batch["_size"].to_numpy() > limit)
            rows = batch.iloc[busy]
            for i, who, piece, at in zip(busy, rows[key], rows["_piece"], rows["_us"]):
                if (who, piece) != current:
                    current, state = (who, piece), machine(limit, micros)
                accepted[i] = state.hit(at)
            batch["accepted"] = accepted
            yield batch[[*columns, "accepted"]]

    return sized.mapInPandas(serve, schema)


def burst_windows(
    hits: DataFrame, key: str = "key", limit: int = DEFAULT_POLICY[0],
    seconds: int = DEFAULT_POLICY[1],
) -> DataFrame:
    """Sliding-log limiter over a batch of hits ``(key, ts, …)``: adds ``accepted``."""
    return _run(hits, key, limit, seconds, SlidingLog)


def burst_counter(
    hits: DataFrame, key: str = "key", limit: int = DEFAULT_POLICY[0],
    seconds: int = DEFAULT_POLICY[1],
) -> DataFrame:
    """Counter limiter over a batch of hits: adds ``accepted``."""
    return _run(hits, key, limit, seconds, FixedCounter)


def stream_burst_windows(
    hits: DataFrame, key: str = "key", limit: int = DEFAULT_POLICY[0],
    seconds: int = DEFAULT_POLICY[1], lateness: str = "1 minute", slice_seconds: int = 600,
) -> DataFrame:
    """:func:`burst_windows` on a stream: (key, ``ts``, ``accepted``) once the watermark has passed a hit's slice."""
    return limited(hits, key, SlidingLog, limit, seconds, lateness, slice_seconds)


def stream_burst_counter(
    hits: DataFrame, key: str = "key", limit: int = DEFAULT_POLICY[0],
    seconds: int = DEFAULT_POLICY[1], lateness: str = "1 minute", slice_seconds: int = 600,
) -> DataFrame:
    """:func:`burst_counter` on a stream, in the same way."""
    return limited(hits, key, FixedCounter, limit, seconds, lateness, slice_seconds)
