"""Reading and writing the library's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from costlake.schemas import AUDIT_LOGS, COST_RECORDS


def write_costs(records: DataFrame, path: str, mode: str = "append") -> None:
    """Write cost records partitioned by day.

    Within a file rows are ordered by account and service, which keeps row-group statistics
    selective.
    """
    day_files(records).write.mode(mode).partitionBy("usage_date").parquet(path)


def day_files(records: DataFrame) -> DataFrame:
    """Records gathered by day for writing, with their ``usage_date``.

    The rebalance lets adaptive execution size the partitions: small days share a task, and a day
    that holds much of the data is split over many.
    """
    return (
        records.withColumn("usage_date", F.to_date("date")).hint("rebalance", "usage_date")
        .sortWithinPartitions("usage_date", "cloud_account_id", "service")
    )


def read_costs(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType(COST_RECORDS.fields + [T.StructField("usage_date", T.DateType())])
    return spark.read.schema(schema).parquet(path)


def write_audit(events: DataFrame, path: str) -> None:
    """Append audit events; the log is never rewritten."""
    columns = [
        (F.col(f.name) if f.name in events.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in AUDIT_LOGS
    ]
    events.select(*columns).write.mode("append").parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_LOGS).parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV export with a header per part file; empty strings stay empty, not quoted."""
    rows.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
