"""Joins that hold up when the small side stops being small, and gap filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

def join_dimension(
    fact: DataFrame, dimension: DataFrame, on: Column | str | list[str], how: str = "inner"
) -> DataFrame:
    """Join a fact table to a dimension.

    No hint and no count: Spark broadcasts a dimension whose size in bytes is below its own limit, by
    statistics or at run time, and else shuffles both sides and splits hot keys.
    """
    return fact.join(dimension, on, how)


def bucketed(rows: DataFrame, name: str, path: str, key: str, buckets: int = 64) -> DataFrame:
    """``rows`` stored as a table of ``buckets`` buckets of ``key``, sorted by it inside each.

    Two tables with the same number of buckets of one key join without moving either of them; a key that holds much of a table
    stays in one bucket, so it suits keys like accounts, whose largest share is known.
    """
    writer = rows.write.mode("overwrite").format("parquet").option("path", path)
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return rows.sparkSession.table(name)


def calendar(spark: SparkSession, start, end, column: str = "ds") -> DataFrame:
    """One row per day from ``start`` to ``end``, both included."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return spark.range(1).select(F.explode(days).alias(column))


def densify(
    daily: DataFrame, start, end, by: Sequence[str] = (), ds: str = "ds", value: str = "amount"
) -> DataFrame:
    """Exactly one row per key and day of the window; days without data hold 0.

    ``daily`` is already aggregated to one row per key and day, so only aggregates move here, never
    raw records.  With keys, every day fills the gap up to the next one (the first also back to the
    start of the window), which reads ``daily`` once; a key's window partition is at most as long as
    the calendar.
    """
    zero = F.lit(0).cast(daily.schema[value].dataType)
    amount = F.coalesce(F.col(value), zero)
    if not by:
        spine = calendar(daily.sparkSession, start, end, ds)
        return spine.join(daily, ds, "left").select(ds, amount.alias(value))
    first, last = (F.lit(edge).cast("date") for edge in (start, end))
    order = Window.partitionBy(*by).orderBy(ds)
    inside = daily.filter(F.col(ds).between(first, last))
    reach = inside.select(
        *by, ds, value,
        F.when(F.lag(ds).over(order).isNull(), first).otherwise(F.col(ds)).alias("_from"),
        F.coalesce(F.date_sub(F.lead(ds).over(order), 1), last).alias("_to"),
    )
    days = reach.withColumn("_day", F.explode(F.sequence("_from", "_to")))
    return days.select(
        *by, F.col("_day").alias(ds),
        F.when(F.col("_day") == F.col(ds), amount).otherwise(zero).alias(value),
    )


def merge_metrics(
    cpu: DataFrame, memory: DataFrame, received: DataFrame, sent: DataFrame, on: list[str],
    value: str = "value",
) -> DataFrame:
    """Keys known to cpu or memory, with 0 for a missing side; network-only keys are dropped."""
    def named(df: DataFrame, name: str) -> DataFrame:
        return df.select(*on, F.col(value).alias(name))

    merged = named(cpu, "cpu").join(named(memory, "memory"), on, "full_outer")
    for frame, name in ((received, "received"), (sent, "sent")):
        merged = merged.join(named(frame, name), on, "left")
    zero = F.lit(0.0)
    return merged.select(
        *on, *[F.coalesce(c, zero).alias(c) for c in ("cpu", "memory", "received", "sent")]
    )
