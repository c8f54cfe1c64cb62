"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from costlake.session import scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_TABLES: list[str] = []  # scratch tables of this driver, oldest first


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, later reads are cheap, and the shuffle files of
    the write go with it."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before else spark.conf.unset(_CLEANUP)
    _TABLES.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _TABLES.remove(path)


def discard(table: DataFrame) -> None:
    """Delete a scratch table that its operator needs no longer."""
    files = table.inputFiles()
    for path in [p for p in _TABLES if any(_of(p) in f for f in files)]:
        _delete(table.sparkSession, path)


def tables() -> list[str]:
    """The scratch tables of this driver that are still there."""
    return list(_TABLES)


def release(spark: SparkSession, paths: list[str], kept: DataFrame) -> None:
    """Delete those of the scratch tables ``paths`` that ``kept`` does not read."""
    files = kept.inputFiles()
    for path in [p for p in paths if p in _TABLES and not any(_of(p) in f for f in files)]:
        _delete(spark, path)


def _of(path: str) -> str:
    """The part of a scratch path that no other has."""
    return "/" + path.rsplit("/", 1)[1] + "/"


def text_of(df: DataFrame, text_col: str = "text") -> Column:
    """A document's text; null counts as empty."""
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; null for a null id."""
    return (F.crc32(doc_id.cast("string")) % n).cast("int")


Batches = Iterator[pa.RecordBatch]


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Batches], Batches]:
    """An Arrow map function from a function of one batch; None and empty batches give no rows."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    return run


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about ``limit`` bytes together, so that memory stays bounded
    (a single longer text is a part of its own)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begun, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(begun, i - begun)
            begun, held = i, 0
        held += size + 64
    if begun < len(sizes):
        yield batch.slice(begun)
