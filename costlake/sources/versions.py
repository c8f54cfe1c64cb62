"""Tables of day folders that change all at once.

Every day of a table has its rows in ``usage_date=D/version=V``.  A manifest names the version that counts for each
day; manifests are numbered, and the highest number is the table.  A writer puts new versions of some days next
to the old ones, where nobody looks yet, and then publishes one manifest by renaming it to the next
number.  So a reader sees all days before a change or all days after it, a writer that dies in between leaves
the table as it was, and of two writers that start from the same manifest one is refused.

The rename must be atomic and must not replace a file, as on HDFS and local disks.  A manifest has one entry per
day; it is the only thing that passes through the driver.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
_FOLDER = "_versions"  # readers of plain folders skip such names


class Conflict(RuntimeError):
    """Another writer published first."""


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path
    return folder, folder(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    folder, fs = _files(spark, path)
    root = folder(f"{path}/{_FOLDER}")
    if not fs.exists(root):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(root)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def current(spark: SparkSession, path: str, number: int | None = None) -> tuple[int, dict[dt.date, str]]:
    """(number of the manifest, version of every day); (0, nothing) for a table that does not exist yet."""
    numbers = _numbers(spark, path)
    if not numbers:
        return 0, {}
    number = number or numbers[-1]
    text = spark.read.text(f"{path}/{_FOLDER}/{number:012d}.json", wholetext=True).first()[0]
    return number, {dt.date.fromisoformat(day): version for day, version in json.loads(text).items()}


def publish(spark: SparkSession, path: str, days: dict[dt.date, str], after: int) -> int:
    """Make ``days`` the table, if manifest ``after`` is still the last one; the new manifest's number."""
    folder, fs = _files(spark, path)
    number = after + 1
    draft = folder(f"{path}/{_FOLDER}/.{number:012d}-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps({day.isoformat(): v for day, v in sorted(days.items())}).encode()))
    finally:
        out.close()
    final = folder(f"{path}/{_FOLDER}/{number:012d}.json")
    # a rename onto a name that is taken fails; the test before spares the attempt where a file system would replace it
    if _numbers(spark, path)[-1:] > [after] or fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise Conflict(f"manifest {number} of {path} was published by another writer")
    return number


def new_version() -> str:
    return uuid.uuid4().hex


def write_days(rows: DataFrame, path: str, version: str) -> set[dt.date]:
    """Write rows with a ``usage_date`` as ``version`` of their days; the days.  Nothing is published."""
    placed = rows.withColumn("version", F.lit(version)).hint("rebalance", "usage_date").sortWithinPartitions("usage_date")
    placed.write.mode("append").partitionBy("usage_date", "version").parquet(path)
    folder, fs = _files(rows.sparkSession, path)
    made = fs.globStatus(folder(f"{path}/usage_date=*/version={version}"))
    return {dt.date.fromisoformat(s.getPath().getParent().getName().split("=")[1]) for s in made or []}


def read_days(
    spark: SparkSession, path: str, schema: T.StructType, days: Iterable[dt.date] | None = None,
    number: int | None = None,
) -> DataFrame:
    """The rows of a table, or of some of its days, with ``usage_date``; filters on it skip folders."""
    _, versions = current(spark, path, number)
    wanted = sorted(versions if days is None else set(days) & set(versions))
    whole = T.StructType(
        schema.fields + [T.StructField("usage_date", T.DateType()), T.StructField("version", T.StringType())])
    if not wanted:
        return spark.createDataFrame([], whole).drop("version")
    folders = [f"{path}/usage_date={day}/version={versions[day]}" for day in wanted]
    # a listing job of a few dozen tasks instead of one per day
    before = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, min(int(before), 64))
    try:
        return spark.read.schema(whole).option("basePath", path).parquet(*folders).drop("version")
    finally:
        spark.conf.set(_LISTING, before)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete day folders that none of the last ``keep`` manifests names, and older manifests; folders deleted.

    Readers of older manifests and unpublished writers must be done.
    """
    numbers = _numbers(spark, path)
    folder, fs = _files(spark, path)
    live = {(day.isoformat(), v) for n in numbers[-keep:] for day, v in current(spark, path, n)[1].items()}
    gone = 0
    for status in fs.globStatus(folder(f"{path}/usage_date=*/version=*")) or []:
        place = status.getPath()
        if (place.getParent().getName().split("=")[1], place.getName().split("=")[1]) not in live:
            gone += bool(fs.delete(place, True))
    for n in numbers[:-keep]:
        fs.delete(folder(f"{path}/{_FOLDER}/{n:012d}.json"), False)
    return gone
