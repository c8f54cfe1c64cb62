"""Tables as streams, for the queries over arriving data."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from costlake.session import scratch_path
from costlake.sources import retail
from costlake.streaming.ordered import heartbeat

#: Far behind every sample: a row of this time moves the watermark past all others.
THE_END = dt.datetime(2100, 1, 1)


def stream_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A sample table as a file stream."""
    schema = retail.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def stored(rows: DataFrame, label: str) -> DataFrame:
    """Derived rows as a stream."""
    path = scratch_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(path)


def delivered_twice(rows: DataFrame, label: str) -> tuple[DataFrame, Callable[[], None]]:
    """Derived rows as a stream, and what delivers all of them to it once more."""
    path = scratch_path(rows.sparkSession, label)
    rows.write.parquet(path)
    live = rows.sparkSession.readStream.schema(rows.schema).parquet(path)
    return live, lambda: rows.write.mode("append").parquet(path)


def closed(stream: DataFrame, ts: str) -> DataFrame:
    """``stream`` and one row without values at its end, so that all of its rows become final."""
    spark, path = stream.sparkSession, scratch_path(stream.sparkSession, "end")
    heartbeat(THE_END, stream, ts).write.parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path))
