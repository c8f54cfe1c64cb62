"""Error ratios, latency percentiles and conditions that must hold for a while.

Each function takes a batch frame or a stream of requests ``(ts, key…, status, seconds)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from costlake.operators.quantiles import windowed_quantile
from costlake.streaming import ordered

#: Alert limits and floors.
ERROR_LIMIT, RATE_FLOOR = 0.05, 0.001
SYNC_LATENCY_LIMIT, PREDICTION_LATENCY_LIMIT = 60.0, 10.0


def _sliding(rows: DataFrame, ts: Column, minutes: int, slide: int) -> Column:
    return F.window(ts, f"{minutes} minutes", f"{slide} minutes")


def error_ratio(
    requests: DataFrame, by: Sequence[str] = (), minutes: int = 5, slide: int = 1,
    lateness: str = "10 minutes",
) -> DataFrame:
    """Share of 5xx answers in a sliding window, and whether it is above the limit.

    In batch, requests are first counted per minute, and only those counts are spread over the
    windows they belong to.  A stream keeps one state row per window.
    """
    seconds = minutes * 60.0
    failed = F.col("status").between(500, 599)
    if requests.isStreaming:
        rows = requests.withWatermark("ts", lateness)
        grouped = rows.groupBy(*by, _sliding(rows, F.col("ts"), minutes, slide).alias("w")).agg(
            F.count_if(failed).alias("_bad"), F.count("*").alias("_all")
        )
    else:
        panes = requests.groupBy(*by, F.window("ts", f"{slide} minutes").start.alias("_pane")).agg(
            F.count_if(failed).alias("_bad"), F.count("*").alias("_all")
        )
        grouped = panes.groupBy(
            *by, _sliding(panes, F.col("_pane"), minutes, slide).alias("w")
        ).agg(F.sum("_bad").alias("_bad"), F.sum("_all").alias("_all"))
    ratio = (F.col("_bad") / seconds) / F.greatest(F.col("_all") / seconds, F.lit(RATE_FLOOR))
    return grouped.select(
        *by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        ratio.alias("error_ratio"), (ratio > ERROR_LIMIT).alias("firing"),
    )


def latency_p95(
    requests: DataFrame, by: Sequence[str], limit: float = SYNC_LATENCY_LIMIT, minutes: int = 10,
    slide: int = 1, lateness: str = "10 minutes", q: float = 0.95,
) -> DataFrame:
    """95th percentile of the duration per key in a sliding window.

    Exact in batch: durations are counted per minute and bin, only those counts are spread over the
    windows, and no window's values are gathered in one place.  A stream keeps a sketch.
    """
    if requests.isStreaming:
        rows = requests.withWatermark("ts", lateness)
        grouped = rows.groupBy(*by, _sliding(rows, F.col("ts"), minutes, slide).alias("w")).agg(
            F.percentile_approx("seconds", q, 10_000).cast("double").alias("p95")
        )
    else:
        panes = requests.groupBy(
            *by, F.window("ts", f"{slide} minutes").start.alias("_pane"),
            F.col("seconds").cast("double").alias("value"),
        ).agg(F.count("*").alias("n"))
        grouped = windowed_quantile(panes, by, q, minutes, slide, out="p95")
    return grouped.select(
        *by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "p95",
        (F.col("p95") > limit).alias("firing"),
    )


def sustained(
    windows: DataFrame, by: Sequence[str] = (), minutes: int = 5, slide: int = 1
) -> DataFrame:
    """Periods in which every evaluation over at least ``minutes`` was firing.

    Runs of firing windows are found by the distance of their end from their rank.  A window
    partition holds the evaluations of one key, one per slide.
    """
    at = F.unix_seconds("window_end")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("window_end"))
    runs = windows.filter("firing").withColumn("_run", at - rank * F.lit(slide * 60))
    return runs.groupBy(*by, "_run").agg(
        F.min("window_end").alias("firing_from"), F.max("window_end").alias("firing_to"),
        F.count("*").alias("evaluations"),
    ).filter(
        F.unix_seconds("firing_to") - F.unix_seconds("firing_from") >= minutes * 60
    ).drop("_run")


def stream_sustained(
    windows: DataFrame, by: Sequence[str] = (), minutes: int = 5, slide: int = 1
) -> DataFrame:
    """:func:`sustained` over a stream of :func:`error_ratio` or :func:`latency_p95`, in append mode.

    Evaluations become final when the watermark passes their window; a state machine per key then follows its
    run, and a timer closes the run of a key that falls silent.
    """
    return ordered.sustained(windows, by, minutes, slide)
