"""Cost queries over the charge table.

Every aggregate takes ``by``: leave it empty for one tenant's answer, or pass for example
``["organization_id"]`` to answer for all tenants in one job.  Aggregations combine on the map side
before any shuffle, so a tenant or service that owns a third of all rows costs no more than others.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from costlake.functions.dates import in_window, resolve_window
from costlake.functions.text import mask_identifier
from costlake.operators.joins import densify, join_dimension

ACCOUNT_COLUMNS = (
    "organization_id", "provider", "account_id", "account_name", "business_unit", "environment",
    "cost_center",
)
_RECORD_FILTERS = {"account_id": "cloud_account_id", "service": "service", "region": "region"}
_ACCOUNT_FILTERS = ("provider", "business_unit", "environment", "cost_center")


# ---- scoping ---------------------------------------------------------------------------------


def with_accounts(records: DataFrame, accounts: DataFrame) -> DataFrame:
    """Attach account attributes to charges; charges of unknown accounts drop out."""
    side = accounts.select(F.col("id").alias("cloud_account_id"), *ACCOUNT_COLUMNS)
    return join_dimension(records, side, "cloud_account_id")


def cost_filters(
    records: DataFrame,
    accounts: DataFrame,
    organization_id: str | None,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    **equals: str | None,
) -> DataFrame:
    """Charges of a tenant (``None``: of all tenants) inside a window, narrowed by equality.

    Keywords: account_id, provider, service, region, business_unit, environment, cost_center.
    Filters are applied to each side before the join.
    """
    unknown = sorted(set(equals) - set(_RECORD_FILTERS) - set(_ACCOUNT_FILTERS))
    if unknown:
        raise ValueError(f"unknown filters: {unknown}")
    if organization_id is not None:
        accounts = accounts.filter(F.col("organization_id") == organization_id)
    records = in_window(records, start, end)
    for name, value in equals.items():
        if value is None:
            continue
        if name in _RECORD_FILTERS:
            records = records.filter(F.col(_RECORD_FILTERS[name]) == value)
        else:
            accounts = accounts.filter(F.col(name) == value)
    return with_accounts(records, accounts)


def context_filters(
    records: DataFrame,
    accounts: DataFrame,
    organization_id: str | None,
    keys: Mapping[str, str | None],
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
) -> DataFrame:
    """Like :func:`cost_filters`, where ``all`` in any case, blank and missing mean no filter."""
    chosen = {
        name: value for name, value in keys.items()
        if name in {*_RECORD_FILTERS, *_ACCOUNT_FILTERS} and value and value.lower() != "all"
    }
    if "provider" in chosen:
        chosen["provider"] = chosen["provider"].lower()
    return cost_filters(records, accounts, organization_id, start, end, **chosen)


def records_filter(
    records: DataFrame,
    accounts: DataFrame,
    organization_id: str | None,
    start_date: dt.datetime | None = None,
    end_date: dt.datetime | None = None,
    **equals: str | None,
) -> DataFrame:
    """Record listing filter: both date bounds are optional and inclusive."""
    return cost_filters(records, accounts, organization_id, start_date, end_date, **equals)


# ---- breakdowns ------------------------------------------------------------------------------


def total_cost(costs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    zero = F.lit(0).cast("decimal(28,8)")
    return costs.groupBy(*by).agg(F.coalesce(F.sum("amount"), zero).alias("total_cost"))


def _breakdown(costs: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    return costs.groupBy(*by, column).agg(F.sum("amount").alias("total_cost"))


def cost_by_service(costs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Spend per service, highest first; blank service names are left out."""
    named = costs.filter(F.col("service") != "")
    return _breakdown(named, "service", by).orderBy(*by, F.desc("total_cost"), "service")


def cost_by_region(costs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    placed = costs.filter(F.col("region").isNotNull())
    return _breakdown(placed, "region", by).orderBy(*by, F.desc("total_cost"), "region")


def daily_totals(costs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return costs.groupBy(*by, F.to_date("date").alias("ds")).agg(F.sum("amount").alias("amount"))


def cost_by_day(
    costs: DataFrame, as_of: dt.datetime, days: int, by: Sequence[str] = ()
) -> DataFrame:
    """Exactly ``days`` rows (per key), in day order, 0 where nothing was spent."""
    start, end = resolve_window(as_of, days)
    daily = daily_totals(in_window(costs, start, end), by)
    return densify(daily, start, end, by).orderBy(*by, "ds")


def top_services(costs: DataFrame, limit: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """The most expensive services with their record counts."""
    if not 1 <= limit <= 50:
        raise ValueError("limit must be between 1 and 50")
    totals = costs.groupBy(*by, "service").agg(
        F.sum("amount").alias("total_cost"), F.count("*").alias("record_count")
    )
    return head_n(totals, limit, by)


def head_n(totals: DataFrame, n: int, by: Sequence[str] = (), name: str = "service") -> DataFrame:
    """The ``n`` largest rows of a breakdown, per key if any."""
    order = [F.desc("total_cost"), F.col(name)]
    if not by:
        return totals.orderBy(*order).limit(n)
    return _first_n(totals, n, by, order)


def tail_days(series: DataFrame, n: int = 6, by: Sequence[str] = ()) -> DataFrame:
    """The latest ``n`` days of a daily series."""
    if not by:
        return series.orderBy(F.desc("ds")).limit(n).orderBy("ds")
    return _first_n(series, n, by, [F.desc("ds")])


def _first_n(df: DataFrame, n: int, by: Sequence[str], order: list[Column]) -> DataFrame:
    # Spark turns a row_number filter into a per-task limit ahead of the shuffle
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def cost_trend(
    costs: DataFrame, as_of: dt.datetime, days: int, by: Sequence[str] = ()
) -> DataFrame:
    """Dense daily trend with the change against the day before.

    The change is null on the first day and after a day that did not cost anything.
    """
    if days < 7:
        raise ValueError("a trend needs at least 7 days")
    start, end = resolve_window(as_of, days)
    daily = densify(daily_totals(in_window(costs, start, end), by), start, end, by)
    # one row per key and calendar day: a window partition is bounded by the length of the window
    previous = F.lag("amount").over(Window.partitionBy(*by).orderBy("ds"))
    change = (F.col("amount") - F.col("_prev")).cast("double") / F.col("_prev").cast("double") * 100
    return daily.withColumn("_prev", previous).select(
        *by, "ds", "amount",
        F.when(F.col("_prev") > 0, change).alias("change_percent"),
        F.lit(False).alias("predicted"),
    )


def latest_change(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Percent change of the last day against the one before it; 0 after a day without cost."""
    order = Window.partitionBy(*by).orderBy(F.desc("ds"))
    last_two = series.withColumn("_rank", F.row_number().over(order)).filter("_rank <= 2")
    last = F.max(F.when(F.col("_rank") == 1, F.col("amount"))).cast("double")
    previous = F.max(F.when(F.col("_rank") == 2, F.col("amount"))).cast("double")
    return last_two.groupBy(*by).agg(last.alias("_last"), previous.alias("_prev")).select(
        *by,
        F.when(F.col("_prev") > 0, (F.col("_last") - F.col("_prev")) / F.col("_prev") * 100)
        .otherwise(F.lit(0.0)).alias("change_percent"),
    )


def cost_summary(
    costs: DataFrame, as_of: dt.datetime, days: int, by: Sequence[str] = ()
) -> DataFrame:
    """Total, services, regions and days of a window from one scan.

    Long form: ``section`` is total, service, region or day, ``item`` its key.  Days without
    data appear with 0.
    """
    start, end = resolve_window(as_of, days)
    keys = [F.col(k) for k in by]
    inside = in_window(costs, start, end).withColumn("ds", F.to_date("date"))
    # raw rows are summed by hash once; the sets, and the smallest currency, are taken from those cells
    cells = inside.groupBy(*keys, "service", "region", "ds", "currency").agg(F.sum("amount").alias("amount"))
    grouped = cells.groupingSets(
        [keys, [*keys, F.col("service")], [*keys, F.col("region")], [*keys, F.col("ds")]],
        *keys, F.col("service"), F.col("region"), F.col("ds"),
    ).agg(
        F.sum("amount").alias("amount"), F.min("currency").alias("currency"),
        F.grouping("service").alias("_s"), F.grouping("region").alias("_r"),
        F.grouping("ds").alias("_d"),
    )
    section = (
        F.when(F.col("_s") == 0, "service").when(F.col("_r") == 0, "region")
        .when(F.col("_d") == 0, "day").otherwise("total")
    )
    money = "decimal(38,8)"

    def line(section: Column, item: Column, amount: Column, currency: Column) -> Column:
        return F.struct(section.alias("section"), item.alias("item"),
                        amount.cast(money).alias("amount"), currency.alias("currency"))

    # the total of a key also brings a zero for every day of the window
    no_text, zero = F.lit(None).cast("string"), F.lit(0)
    calendar_days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    zeros = F.transform(
        calendar_days, lambda d: line(F.lit("day"), d.cast("string"), zero, no_text)
    )
    own = F.array(line(
        F.col("section"),
        F.when(F.col("section") == "service", F.col("service"))
        .when(F.col("section") == "region", F.col("region"))
        .when(F.col("section") == "day", F.col("ds").cast("string")),
        F.col("amount"), F.col("currency"),
    ))
    lines = grouped.withColumn("section", section).select(
        *by, F.when(F.col("section") == "total", F.concat(own, zeros)).otherwise(own).alias("lines")
    )
    if not by:  # a tenant without any charge still gets its zeros
        nothing = F.array(line(F.lit("total"), no_text, zero, no_text))
        lines = lines.unionByName(
            costs.sparkSession.range(1).select(F.concat(nothing, zeros).alias("lines")))
    rows = lines.select(*by, F.inline("lines")).filter(
        (F.col("section") == "total") | (F.col("item").isNotNull() & (F.col("item") != ""))
    )
    return rows.groupBy(*by, "section", "item").agg(
        F.sum("amount").alias("amount"), F.min("currency").alias("currency")
    ).select(
        *by, "section", "item", "amount", F.coalesce("currency", F.lit("USD")).alias("currency"),
        F.lit(start).cast("timestamp").alias("period_start"),
        F.lit(end).cast("timestamp").alias("period_end"),
    )


# ---- listings --------------------------------------------------------------------------------


def page_of(df: DataFrame, order: list[Column | str], page: int = 1, size: int = 50) -> DataFrame:
    """One page of an ordered listing; ``order`` must be total for pages to be stable."""
    if page < 1 or not 1 <= size <= 100:
        raise ValueError("page starts at 1 and size is 1 to 100")
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


RECORD_ORDER = ("cloud_account_id", "resource_id", "service", "region", "amount", "granularity")


def list_records(costs: DataFrame, page: int = 1, page_size: int = 50) -> DataFrame:
    """Newest charges first; equal dates are ordered by the rest of the row."""
    return page_of(costs, [F.desc("date"), *RECORD_ORDER], page, page_size)


def page_info(df: DataFrame, page_size: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """Rows and pages of a listing."""
    return df.groupBy(*by).agg(F.count("*").alias("total")).withColumn(
        "total_pages", F.expr(f"(total + {page_size} - 1) div {page_size}")
    )


EXPORT_COLUMNS = (
    "date", "provider", "account_name", "account_id", "business_unit", "environment",
    "cost_center", "service", "region", "amount", "currency",
)


def export_costs(costs: DataFrame) -> DataFrame:
    """The CSV export: fixed columns, blanks for nulls, newest first, then account and service.

    Amount and region extend the sort key, so that a day holding much of the data still spreads
    over many range partitions.
    """
    ordered = costs.orderBy(F.desc("date"), "account_name", "service", "amount", "region")
    blank = F.lit("")
    return ordered.select(
        F.date_format("date", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("date"),
        "provider", "account_name", "account_id",
        *[F.coalesce(F.col(c), blank).alias(c) for c in ("business_unit", "environment", "cost_center")],
        "service",
        F.coalesce("region", blank).alias("region"),
        F.col("amount").cast("string").alias("amount"),
        "currency",
    )


# ---- derived figures -------------------------------------------------------------------------


def reconcile(
    imported: DataFrame, provider_rows: DataFrame, as_of: dt.datetime | None = None,
    days: int | None = None, key: str = "cloud_account_id",
) -> DataFrame:
    """Imported against provider totals per account; ``matched`` within max(1.00, 1 %)."""
    if as_of is not None and days is not None:
        start, end = resolve_window(as_of, days)
        imported, provider_rows = (in_window(f, start, end) for f in (imported, provider_rows))
    cents = "decimal(28,2)"

    def totals(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.bround(F.sum("amount"), 2).cast(cents).alias(name))

    zero = F.lit(0).cast(cents)
    both = totals(imported, "imported_total").join(
        totals(provider_rows, "provider_total"), key, "full_outer"
    ).select(
        key, F.coalesce("imported_total", zero).alias("imported_total"),
        F.coalesce("provider_total", zero).alias("provider_total"),
    )
    variance = F.col("imported_total") - F.col("provider_total")
    tolerance = F.greatest(F.lit("1.00").cast("decimal(30,4)"),
                           F.col("provider_total") * F.lit("0.01").cast("decimal(3,2)"))
    percent = F.when(
        F.col("provider_total") > 0,
        F.bround(F.try_divide(variance.cast("decimal(24,2)"), F.col("provider_total").cast("decimal(24,2)")) * 100, 2),
    ).otherwise(F.lit(0))
    return both.select(
        "*", variance.alias("variance_amount"), percent.cast("decimal(20,2)").alias("variance_percent"),
        F.when(F.abs(variance) <= tolerance, "matched").otherwise("drift").alias("status"),
    )


def account_coverage(records: DataFrame, accounts: DataFrame) -> DataFrame:
    """What has been imported for each account, including accounts without a single record."""
    # raw rows are combined by hash; the text aggregates see one row per service and currency
    cells = records.groupBy("cloud_account_id", "service", "currency").agg(
        F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))
    seen = cells.groupBy("cloud_account_id").agg(
        F.sum("n").alias("total_records"),
        F.min("first").alias("coverage_start"),
        F.max("last").alias("coverage_end"),
        F.count_distinct("service").alias("services_detected"),
        F.min("currency").alias("currency"),
    )
    joined = accounts.join(seen, accounts["id"] == seen["cloud_account_id"], "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        accounts["id"].alias("account_id"), "is_active",
        F.coalesce("total_records", zero).alias("total_records"),
        "coverage_start", "coverage_end",
        F.coalesce("services_detected", zero).alias("services_detected"), "currency",
    )


def context_summary(
    records: DataFrame, accounts: DataFrame, organization_id: str | None,
    keys: Mapping[str, str | None], as_of: dt.datetime, days: int = 30,
) -> DataFrame:
    """One row per tenant with the figures an assistant would quote.

    One scan feeds total, services and days through grouping sets.  Only the five largest services
    and the seven latest days with data are ever gathered into a row.
    """
    start, end = resolve_window(as_of, days)
    costs = context_filters(records, accounts, organization_id, keys, start, end)
    org = F.col("organization_id")
    ds = F.col("ds")
    grouped = costs.withColumn("ds", F.to_date("date")).groupingSets(
        [[org], [org, F.col("service")], [org, ds]], org, F.col("service"), ds
    ).agg(
        F.sum("amount").alias("amount"), F.count("*").alias("n"),
        F.grouping("service").alias("_s"), F.grouping("ds").alias("_d"),
    )
    section = F.when(F.col("_s") == 0, "service").when(F.col("_d") == 0, "day").otherwise("total")
    order = [
        F.when(F.col("section") == "service", F.col("amount")).desc_nulls_last(),
        ds.desc_nulls_last(), F.col("service"),
    ]
    ranked = grouped.withColumn("section", section).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("organization_id", "section").orderBy(*order))
    ).filter(F.col("_rank") <= 7)
    money = F.round(F.col("amount").cast("double"), 2)
    is_top = (F.col("section") == "service") & (F.col("_rank") <= 5) & (F.col("service") != "")
    service_entry = F.when(is_top, F.struct("_rank", "service", money.alias("amount")))
    day_entry = F.when(F.col("section") == "day", F.struct("ds", money.alias("amount")))
    found = ranked.groupBy("organization_id").agg(
        F.max(F.when(F.col("section") == "total", money)).alias("total_cost"),
        F.max(F.when(F.col("section") == "total", F.col("n"))).alias("records_found"),
        F.transform(
            F.array_sort(F.collect_list(service_entry)),
            lambda e: F.struct(e["service"].alias("service"), e["amount"].alias("amount")),
        ).alias("top_services"),
        F.array_sort(F.collect_list(day_entry)).alias("daily_trend"),
    )
    tenants = accounts.select("organization_id").distinct()
    if organization_id is not None:
        tenants = tenants.filter(org == organization_id)
    account = keys.get("account_id")
    names = accounts.filter(F.col("id") == (account or "")).select("organization_id", "account_name")
    scope = {c: F.lit(keys.get(c) or "all") for c in ("business_unit", "environment", "cost_center")}
    return tenants.join(found, "organization_id", "left").join(names, "organization_id", "left").select(
        "organization_id",
        F.lit(f"Last {days} Days").alias("period"),
        F.lit((keys.get("provider") or "ALL").upper()).alias("provider_scope"),
        mask_identifier(F.lit(account).cast("string")).alias("account_scope"),
        F.coalesce("account_name", F.lit("All Accounts")).alias("account_name"),
        *[value.alias(name) for name, value in scope.items()],
        F.lit(keys.get("service") or "all").alias("service_scope"),
        F.lit(keys.get("region") or "all").alias("region_scope"),
        F.coalesce("total_cost", F.lit(0.0)).alias("total_cost"),
        F.coalesce("records_found", F.lit(0).cast("bigint")).alias("records_found"),
        "top_services", "daily_trend",
        F.col("records_found").isNull().alias("no_records"),
    )


def share_of_total(df: DataFrame, value: str = "total_cost", out: str = "share") -> DataFrame:
    """Percent of the column's sum, one decimal; 0 if the sum is not positive.

    The sum is a scalar subquery: no window over the whole table and no join.
    """
    whole = df.agg(F.sum(value).cast("double").alias("whole")).scalar()
    share = F.when(whole > 0, F.round(F.col(value).cast("double") / whole * 100, 1))
    return df.withColumn(out, F.coalesce(share, F.lit(0.0)))


def avg_daily(costs: DataFrame, days: int, by: Sequence[str] = ()) -> DataFrame:
    return total_cost(costs, by).withColumn("avg_daily", F.col("total_cost").cast("double") / days)


def growth_by_service(
    costs: DataFrame, as_of: dt.datetime, days: int, by: Sequence[str] = ()
) -> DataFrame:
    """Spend of the window against the window just before it, fastest growing first."""
    start, end = resolve_window(as_of, days)
    before = start - dt.timedelta(days=days)
    recent = F.col("date") >= F.lit(start).cast(costs.schema["date"].dataType)
    totals = in_window(costs, before, end).groupBy(*by, "service").agg(
        F.sum(F.when(recent, F.col("amount")).otherwise(F.lit(0))).cast("double").alias("current_cost"),
        F.sum(F.when(~recent, F.col("amount")).otherwise(F.lit(0))).cast("double").alias("previous_cost"),
    )
    growth = F.when(
        F.col("previous_cost") > 0,
        (F.col("current_cost") - F.col("previous_cost")) / F.col("previous_cost") * 100,
    )
    return totals.withColumn("growth_percent", growth).orderBy(
        *by, F.desc_nulls_last("growth_percent"), "service"
    )
