"""Counter rates and gauge averages over metric samples.

A series is a metric with one full label set.  Counter steps need the sample before, so series are
ordered; the order is cut into slices of time first.  Each (series, slice) is one window group, and
the slices are stitched through a table with one row per series and slice.  A series that owns a
third of all samples is thus spread over many tasks, and the result is that of ordering it whole.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SLICE_SECONDS = 600


def series_id(labels: Column | str = "labels") -> Column:
    """Canonical text of a label set, the same for any order of its keys."""
    return F.to_json(F.array_sort(F.map_entries(labels)))


def label(name: str) -> Column:
    return F.element_at("labels", name)


def lookback(samples: DataFrame, as_of: dt.datetime, hours: float) -> DataFrame:
    """Samples of the last ``hours``, the far edge excluded."""
    kind = samples.schema["ts"].dataType
    far = as_of - dt.timedelta(hours=hours)
    ts = F.col("ts")
    return samples.filter((ts > F.lit(far).cast(kind)) & (ts <= F.lit(as_of).cast(kind)))


def _step(previous: Column, value: Column) -> Column:
    """Increase between two samples; a drop means the counter restarted from 0."""
    return F.when(previous.isNull(), F.lit(0.0)).when(value < previous, value).otherwise(
        value - previous
    )


def series_totals(samples: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Per series (metric, label set and ``extra``): counter increase, gauge average, carried keys.

    ``keys`` are columns of ``samples`` that depend on the series alone; samples of one metric may come
    without its name.  A floating-point key is grouped by its 64-bit hash, which is one to one for a single
    number, and carried beside it: grouped by itself, Spark would normalize it anew in each step, and
    shuffle and sort all rows once more.  A hash of the label set leads, as texts that begin alike are
    slow to put in order.
    """
    every = [*(c for c in ("metric",) if c in samples.columns), *keys, *extra]
    floats = [k for k in every if samples.schema[k].dataType.typeName() in ("float", "double")]
    slice_ = F.floor(F.unix_seconds("ts") / SLICE_SECONDS)
    rows = samples.select(
        *[c for c in every if c not in floats], *[F.xxhash64(k).alias(f"_{k}_id") for k in floats],
        *[(F.col(k) + F.lit(0).cast(samples.schema[k].dataType)).alias(k) for k in floats],  # -0.0 is 0.0
        series_id().alias("_series"), "ts", "value", slice_.alias("_slice"),
    ).withColumn("_spot", F.xxhash64("_series"))
    series = ["_spot", *[f"_{k}_id" if k in floats else k for k in every], "_series"]
    carried = [F.first(k).alias(k) for k in floats]
    inside = Window.partitionBy(*series, "_slice").orderBy("ts", "value")
    order = F.struct("ts", "value")
    slices = (
        rows.withColumn("_step", _step(F.lag("value").over(inside), F.col("value")))
        .groupBy(*series, "_slice")
        .agg(
            F.sum("_step").alias("_inc"), F.sum("value").alias("_sum"), F.count("*").alias("_n"),
            F.min_by("value", order).alias("_first"), F.max_by("value", order).alias("_last"), *carried,
        )
    )
    across = Window.partitionBy(*series).orderBy("_slice")
    seam = _step(F.lag("_last").over(across), F.col("_first"))
    return (
        slices.withColumn("_inc", F.col("_inc") + seam)
        .groupBy(*series)
        .agg(F.sum("_inc").alias("increase"), (F.sum("_sum") / F.sum("_n")).alias("average"), *carried)
    )


def counter_rate(
    samples: DataFrame, metric: str, as_of: dt.datetime, hours: float, keys: dict[str, Column]
) -> DataFrame:
    """Per-second rate of a counter, summed over the series of each key.

    The raw increase inside the window is divided by its length; it is not extrapolated to the
    window's edges.
    """
    rows = keyed(lookback(samples, as_of, hours).filter(F.col("metric") == metric), keys)
    return series_totals(rows.drop("metric"), list(keys)).groupBy(*keys).agg(
        (F.sum("increase") / F.lit(hours * 3600)).alias("value")
    )


def gauge_avg(
    samples: DataFrame, metric: str, as_of: dt.datetime, hours: float, keys: dict[str, Column]
) -> DataFrame:
    """Average of each gauge series, summed over the series of each key."""
    rows = keyed(lookback(samples, as_of, hours).filter(F.col("metric") == metric), keys)
    per_series = rows.groupBy(*keys, series_id().alias("_series")).agg(F.avg("value").alias("_avg"))
    return per_series.groupBy(*keys).agg(F.sum("_avg").alias("value"))


def keyed(samples: DataFrame, keys: dict[str, Column]) -> DataFrame:
    return samples.select("ts", "metric", "labels", "value", *[c.alias(k) for k, c in keys.items()])


def request_rate(
    samples: DataFrame, as_of: dt.datetime, keys: dict[str, Column], minutes: int = 5,
    metric: str = "http_requests_total",
) -> DataFrame:
    """Requests per second of each key over the last minutes."""
    return counter_rate(samples, metric, as_of, minutes / 60, keys)


def target_up(samples: DataFrame, as_of: dt.datetime | None = None) -> DataFrame:
    """Availability: the latest ``up`` sample of each job."""
    rows = samples.filter(F.col("metric") == "up")
    if as_of is not None:
        rows = rows.filter(F.col("ts") <= F.lit(as_of).cast(samples.schema["ts"].dataType))
    newest = Window.partitionBy("job").orderBy(F.desc("ts"), F.desc("value"))
    latest = rows.select(label("job").alias("job"), "ts", "value").withColumn("_rank", F.row_number().over(newest))
    return latest.filter(F.col("_rank") == 1).select("job", F.col("value").alias("up"), F.col("ts").alias("last_seen"))


def bucket_quantile(
    samples: DataFrame, q: float, as_of: dt.datetime, hours: float, keys: dict[str, Column],
    metric: str,
) -> DataFrame:
    """Quantile of a bucketed histogram, interpolated inside the bucket that reaches it.

    A quantile in the open last bucket reads as the largest finite bound.  The ordering runs over a
    key's buckets, not its samples.
    """
    bound = F.when(label("le") == "+Inf", F.lit(float("inf"))).otherwise(
        label("le").cast("double")
    )
    rates = counter_rate(samples, metric, as_of, hours, {**keys, "_le": bound})
    ordered = Window.partitionBy(*keys).orderBy("_le")
    steps = rates.select(
        *keys, F.col("_le"), F.col("value").alias("_cum"),
        F.coalesce(F.lag("value").over(ordered), F.lit(0.0)).alias("_below"),
        F.coalesce(F.lag("_le").over(ordered), F.lit(0.0)).alias("_from"),
        F.max("value").over(Window.partitionBy(*keys)).alias("_total"),
    )
    reached = steps.filter((F.col("_total") > 0) & (F.col("_cum") >= F.col("_total") * q))
    first = reached.groupBy(*keys).agg(
        F.min_by(F.struct("_le", "_cum", "_below", "_from", "_total"), "_le").alias("b")
    )
    b = F.col("b")
    inside = b["_from"] + (b["_le"] - b["_from"]) * F.coalesce(
        F.try_divide(b["_total"] * q - b["_below"], b["_cum"] - b["_below"]), F.lit(1.0)
    )
    return first.select(
        *keys, F.when(b["_le"] == float("inf"), b["_from"]).otherwise(inside).alias("quantile")
    )
