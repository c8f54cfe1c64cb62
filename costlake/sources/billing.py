"""Provider billing exports to one record shape.

Each normalizer is a row-local projection (no shuffle).  The three providers treat signs and
malformed rows differently on purpose: AWS drops everything at or below zero, GCP drops only exact
zeros so credits stay, Azure keeps every sign.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from costlake.schemas import AWS_PAGE, MONEY

#: The providers a sync can be run for.
SUPPORTED_PROVIDERS = ("demo", "aws", "gcp", "azure")

NORMALIZED = ["date", "service", "region", "amount", "currency", "usage_quantity"]


def _aws_groups(raw: DataFrame, payload: str, keep: tuple[str, ...]) -> DataFrame:
    return (
        raw.select(*keep, F.from_json(payload, AWS_PAGE).alias("page"))
        .select(*keep, F.explode("page.ResultsByTime").alias("period"))
        .select(*keep, F.col("period.TimePeriod.Start").alias("day"),
                F.col("period.TimePeriod.Start").try_cast("date").alias("start"), F.explode("period.Groups").alias("group"))
    )


def aws_normalize(raw: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """AWS response pages (JSON text) to records; ``keep`` carries columns of ``raw`` along.

    What cannot be read is left out here and listed by :func:`aws_quarantine`.
    """
    cost = F.col("group.Metrics.UnblendedCost")
    usage = F.col("group.Metrics.UsageQuantity.Amount")
    return _aws_groups(raw, payload, keep).filter(F.col("start").isNotNull()).select(
        *keep,
        F.col("start").cast("timestamp").alias("date"),
        F.coalesce(F.get("group.Keys", F.lit(0)), F.lit("Unknown")).alias("service"),
        F.lit(None).cast("string").alias("region"),
        F.coalesce(cost["Amount"], F.lit("0")).try_cast(MONEY).alias("amount"),
        F.coalesce(cost["Unit"], F.lit("USD")).alias("currency"),
        F.coalesce(usage, F.lit("0")).try_cast(MONEY).alias("usage_quantity"),
    ).filter(F.col("amount") > 0)


def aws_quarantine(raw: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """What of the pages cannot be read: (``keep``, ``reason``, ``item`` as it came).

    ``page``: no JSON of the expected shape; ``date``: a group under an unreadable day; ``amount``: a group
    whose cost is no number.
    """
    pages = raw.filter(F.from_json(payload, AWS_PAGE)["ResultsByTime"].isNull()).select(
        *keep, F.lit("page").alias("reason"), F.col(payload).alias("item"))
    amount = F.col("group.Metrics.UnblendedCost.Amount")
    reason = F.when(F.col("start").isNull(), "date").when(
        amount.isNotNull() & amount.try_cast(MONEY).isNull(), "amount")
    groups = _aws_groups(raw, payload, keep).select(*keep, reason.alias("reason"), F.to_json("group").alias("item"))
    return pages.unionByName(groups.filter(F.col("reason").isNotNull()))


def gcp_quarantine(export: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Export rows without a usable day or cost; they are in no aggregate."""
    lost = export.filter(F.col("usage_start_time").isNull() | F.col("cost").isNull())
    reason = F.when(F.col("usage_start_time").isNull(), "date").otherwise("amount")
    return lost.select(*keep, reason.alias("reason"), F.to_json(F.struct(*export.columns)).alias("item"))


def gcp_billing_aggregate(
    export: DataFrame, start: dt.datetime, end: dt.datetime, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Daily totals per service and place over the half-open window ``[start, end)``."""
    place = F.col("location")
    cells = (
        _export_window(export, start, end)
        .groupBy(
            *keep,
            F.to_date("usage_start_time").alias("usage_date"),
            F.coalesce(F.col("service.description"), F.lit("Unknown")).alias("service_name"),
            F.coalesce(place["region"], place["location"], place["zone"], F.lit("global"))
            .alias("region_name"),
            "currency",
        )
        .agg(F.sum("cost").alias("total_cost"))
    )
    # raw rows are summed by hash per currency; min() then takes a value that any_value() may return
    return (
        cells.groupBy(*keep, "usage_date", "service_name", "region_name")
        .agg(F.sum("total_cost").alias("total_cost"), F.min("currency").alias("currency"))
    )


def gcp_export_row_count(export: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    return _export_window(export, start, end).agg(F.count("*").alias("row_count"))


def _export_window(export: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    kind = export.schema["usage_start_time"].dataType
    when = F.col("usage_start_time")
    return export.filter((when >= F.lit(start).cast(kind)) & (when < F.lit(end).cast(kind)))


def gcp_normalize(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Aggregated export rows to records: only exact zeros go, credits stay."""
    amount = F.col("total_cost").cast(MONEY)
    return rows.filter(amount != 0).select(
        *keep,
        F.col("usage_date").cast("timestamp").alias("date"),
        F.col("service_name").alias("service"),
        _or_default(F.col("region_name"), "global").alias("region"),
        amount.alias("amount"),
        _or_default(F.col("currency"), "USD").alias("currency"),
        F.lit(0).cast(MONEY).alias("usage_quantity"),
    )


def _or_default(column, value: str):
    return F.coalesce(F.nullif(column, F.lit("")), F.lit(value))


def azure_parse(raw: DataFrame, row: str = "row", keep: tuple[str, ...] = ()) -> DataFrame:
    """Positional rows ``[cost, date, service, region, currency?]`` plus a ``malformed`` flag.

    A row is malformed if it has under four cells, or its cost or date cannot be read.
    """
    cells = F.col(row)
    return raw.select(
        *keep,
        F.get(cells, F.lit(1)).try_cast("timestamp").alias("date"),
        F.get(cells, F.lit(2)).alias("service"),
        F.get(cells, F.lit(3)).alias("region"),
        F.get(cells, F.lit(0)).try_cast(MONEY).alias("amount"),
        F.when(F.size(cells) > 4, F.get(cells, F.lit(4))).otherwise(F.lit("USD")).alias("currency"),
        F.lit(0).cast(MONEY).alias("usage_quantity"),
        cells.alias(row),
    ).withColumn(
        "malformed",
        (F.size(row) < 4) | F.col("amount").isNull() | F.col("date").isNull(),
    )


def azure_normalize(raw: DataFrame, row: str = "row", keep: tuple[str, ...] = ()) -> DataFrame:
    """The well-formed rows as records."""
    return azure_parse(raw, row, keep).filter(~F.col("malformed")).select(*keep, *NORMALIZED)


def azure_quarantine(raw: DataFrame, row: str = "row", keep: tuple[str, ...] = ()) -> DataFrame:
    """The malformed rows, as they came."""
    return azure_parse(raw, row, keep).filter("malformed").select(*keep, row)


def unify_costs(**by_provider: DataFrame) -> DataFrame:
    """One table from normalized frames, named by provider: ``unify_costs(aws=…, gcp=…)``."""
    unknown = sorted(set(by_provider) - set(SUPPORTED_PROVIDERS))
    if unknown or not by_provider:
        raise ValueError(f"unsupported providers: {unknown or 'none given'}")
    merged = None
    for provider, frame in by_provider.items():
        frame = frame.withColumn("provider", F.lit(provider))
        merged = frame if merged is None else merged.unionByName(frame, allowMissingColumns=True)
    return merged
