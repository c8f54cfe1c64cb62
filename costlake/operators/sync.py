"""Importing a billing pull into the charge table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from costlake.schemas import COST_RECORDS
from costlake.sources import versions
from costlake.sources.billing import SUPPORTED_PROVIDERS
from costlake.session import scratch_path
from costlake.sources.tables import day_files, read_costs


def _as_daily(incoming: DataFrame, account_id: str | None) -> DataFrame:
    """Normalized provider rows in the shape of the charge table, marked daily."""
    columns = []
    for field in COST_RECORDS:
        if field.name == "granularity":
            value = F.lit("daily")
        elif field.name == "cloud_account_id" and account_id is not None:
            value = F.lit(account_id)
        elif field.name == "currency":
            value = (F.coalesce("currency", F.lit("USD"))
                     if "currency" in incoming.columns else F.lit("USD"))
        elif field.name == "id" and "id" not in incoming.columns:
            value = F.expr("uuid()")
        elif field.name in incoming.columns:
            value = F.col(field.name)
        else:
            value = F.lit(None)
        columns.append(value.cast(field.dataType).alias(field.name))
    return incoming.select(*columns)


def replace_window(
    existing: DataFrame, incoming: DataFrame, account_id: str, start: dt.datetime, end: dt.datetime
) -> DataFrame:
    """The charge table after one account's daily rows of ``[start, end]`` were replaced.

    Other accounts, granularities and days stay, and an empty pull changes nothing.
    """
    fresh = _as_daily(incoming, account_id)
    arrived = incoming.limit(1).agg(F.count("*") > 0).scalar()  # one row settles it
    kind = existing.schema["date"].dataType
    stale = (
        (F.col("cloud_account_id") == account_id) & (F.col("granularity") == "daily")
        & F.col("date").between(F.lit(start).cast(kind), F.lit(end).cast(kind))
    )
    columns = [f.name for f in COST_RECORDS]
    return existing.filter(~(F.coalesce(stale, F.lit(False)) & arrived)).select(*columns).unionByName(fresh)


def replace_windows(existing: DataFrame, incoming: DataFrame, start, end) -> DataFrame:
    """:func:`replace_window` for every account found in ``incoming``, in one pass.

    An account without incoming rows keeps what it has.
    """
    landed = scratch_path(incoming.sparkSession, "pulls")  # parsed once, read for its accounts and its rows
    incoming.write.parquet(landed)
    fresh = _as_daily(incoming.sparkSession.read.schema(incoming.schema).parquet(landed), None)
    synced = fresh.select("cloud_account_id").distinct().withColumn("_synced", F.lit(True))
    kind = existing.schema["date"].dataType
    replaceable = (F.col("granularity") == "daily") & F.col("date").between(
        F.lit(start).cast(kind), F.lit(end).cast(kind)
    )
    columns = [f.name for f in COST_RECORDS]
    # one pass: a row goes if it is replaceable, which a null date or granularity is not, and its account synced
    stale = F.coalesce(replaceable, F.lit(False)) & F.coalesce("_synced", F.lit(False))
    kept = existing.join(synced, "cloud_account_id", "left").filter(~stale)
    return kept.select(*columns).unionByName(fresh)


def import_window(
    spark: SparkSession, path: str, incoming: DataFrame, account_id: str, start: dt.datetime,
    end: dt.datetime,
) -> int:
    """Apply :func:`replace_window` to a table partitioned by ``usage_date``; rows imported.

    Only the days of the window and of the incoming rows are read and rewritten, never the whole
    table.  Spark swaps in the partitions it wrote when the job commits, and leaves others alone: a
    day that lost its last row is therefore emptied on its own.  Readers that must never see one day
    swapped before the next need a transactional table format underneath.
    """
    landed = scratch_path(spark, "pull")  # parsed once, read for its days, its rows and their number
    incoming.write.parquet(landed)
    incoming = spark.read.schema(incoming.schema).parquet(landed)
    rows = incoming.count()
    if rows == 0:
        return 0
    # calendar days, so these sets are as short as the window
    window = {start.date() + dt.timedelta(days=i) for i in range((end.date() - start.date()).days + 1)}
    touched = sorted(window | _days(incoming))
    affected = read_costs(spark, path).filter(F.col("usage_date").isin(touched))
    after = replace_window(affected, incoming, account_id, start, end)
    emptied = _days(affected) - _days(after)
    writer = day_files(after).write.mode("overwrite").partitionBy("usage_date")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path
    files = folder(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for day in emptied:  # no job: a partition without rows is dropped
        files.delete(folder(f"{path.rstrip('/')}/usage_date={day}"), True)
    return rows


def write_charges(records: DataFrame, path: str, unit: str = "day") -> int:
    """Charges as a new table of versioned days (``sources.versions``), or months where days hold little.

    ``usage_date`` is the day, or the first day of the month.
    """
    version = versions.new_version()
    shaped = records.select([f.name for f in COST_RECORDS]).withColumn("usage_date", _folder(unit))
    days = versions.write_days(shaped, path, version)
    return versions.publish(records.sparkSession, path, dict.fromkeys(days, version), 0)


def _folder(unit: str) -> Column:
    return F.to_date("date") if unit == "day" else F.trunc("date", unit)


def read_charges(spark: SparkSession, path: str, days: Iterable[dt.date] | None = None) -> DataFrame:
    return versions.read_days(spark, path, COST_RECORDS, days)


def import_charges(
    spark: SparkSession, path: str, incoming: DataFrame, account_id: str, start: dt.datetime,
    end: dt.datetime, unit: str = "day",
) -> int:
    """:func:`import_window` on versioned days: all of them change in one step, or none; rows imported.

    Only the days (or months, as the table was written) of the window and of the incoming rows are read and written.
    """
    landed = scratch_path(spark, "pull")
    incoming.write.parquet(landed)
    incoming = spark.read.schema(incoming.schema).parquet(landed)
    rows = incoming.count()
    if rows == 0:
        return 0
    number, days = versions.current(spark, path)
    window = {start.date() + dt.timedelta(days=i) for i in range((end.date() - start.date()).days + 1)}
    touched = {day if unit == "day" else day.replace(day=1) for day in window | _days(incoming)}
    affected = versions.read_days(spark, path, COST_RECORDS, touched, number or None)
    after = replace_window(affected, incoming, account_id, start, end).withColumn("usage_date", _folder(unit))
    version = versions.new_version()
    filled = versions.write_days(after, path, version)
    kept = {day: v for day, v in days.items() if day not in touched}  # a touched day without rows is no more
    versions.publish(spark, path, kept | dict.fromkeys(filled, version), number)
    return rows


#: What a day's charges are summed by.
ROLLUP_KEYS = ("cloud_account_id", "granularity", "service", "region", "currency")
ROLLUP = T.StructType([
    T.StructField("ds", T.DateType()), *[f for f in COST_RECORDS if f.name in ROLLUP_KEYS], T.StructField("amount", T.DecimalType(38, 8)),
    T.StructField("records", T.LongType())])


def refresh_rollup(spark: SparkSession, charges: str, rollup: str) -> set[dt.date]:
    """Bring the daily rollup of a table of versioned days up to date; the days that were read for it.

    A day of the rollup bears the version of the charges it was summed from, so those that changed are known
    without reading any, and the change is published at once like any other.
    """
    _, source = versions.current(spark, charges)
    number, have = versions.current(spark, rollup)
    stale = {day for day, version in source.items() if have.get(day) != version}
    if not stale and set(have) == set(source):
        return set()
    for version in sorted({source[day] for day in stale}):
        days = [day for day in stale if source[day] == version]
        summed = versions.read_days(spark, charges, COST_RECORDS, days).groupBy(
            "usage_date", F.to_date("date").alias("ds"), *ROLLUP_KEYS).agg(
            F.sum("amount").cast("decimal(38,8)").alias("amount"), F.count("*").alias("records"))
        versions.write_days(summed.select(*ROLLUP.fieldNames(), "usage_date"), rollup, version)
    versions.publish(spark, rollup, source, number)
    return stale


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """(``ds``, keys, ``amount``, ``records``, ``usage_date``)."""
    return versions.read_days(spark, path, ROLLUP)


def _days(records: DataFrame) -> set[dt.date]:
    return {row[0] for row in records.select(F.to_date("date")).distinct().collect()}


def sync_telemetry(accounts: DataFrame, results: DataFrame) -> DataFrame:
    """Latest sync state of each account; accounts never synced say so."""
    newest = Window.partitionBy("cloud_account_id").orderBy(F.desc("finished_at"), F.desc("status"))
    latest = results.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") == 1).select(
        "cloud_account_id", F.struct("status", "records_imported", "error", "finished_at").alias("s"))
    s = F.col("s")
    known = s["status"].isin("queued", "syncing", "ready", "error")
    status = F.when(s.isNull(), "never_synced").when(known, s["status"]).otherwise("error")
    done = s["status"].isin("ready", "error")
    return accounts.join(latest, accounts["id"] == latest["cloud_account_id"], "left").select(
        accounts["id"].alias("account_id"),
        status.alias("last_sync_status"),
        F.when(done, s["finished_at"]).alias("last_sync_completed_at"),
        F.when(s["status"] == "ready", s["records_imported"])
        .when(s["status"] == "error", F.lit(0)).cast("bigint").alias("last_sync_records_imported"),
        F.when(s["status"] == "error", s["error"]).alias("last_sync_error"),
    )


def select_sync_accounts(accounts: DataFrame, organization_id: str | None) -> DataFrame:
    """Active accounts of a tenant whose provider can be pulled."""
    if organization_id is not None:
        accounts = accounts.filter(F.col("organization_id") == organization_id)
    return accounts.filter(F.col("is_active") & F.col("provider").isin(*SUPPORTED_PROVIDERS))
