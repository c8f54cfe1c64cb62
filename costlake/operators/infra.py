"""Monthly cost of infrastructure plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from costlake.schemas import PLAN_DOCUMENT

#: Monthly USD per resource type
#: (provider, description, size attribute, default rate, rate by size).
RATES = {
    "aws_instance": ("aws", "EC2 Instance", "instance_type", 30.00, {
        "t3.micro": 7.59, "t3.small": 15.18, "t3.medium": 30.37, "t3.large": 60.74,
        "t3.xlarge": 121.47, "m5.large": 69.12, "m5.xlarge": 138.24, "m5.2xlarge": 276.48,
        "c5.large": 62.05, "c5.xlarge": 124.10, "r5.large": 90.72, "r5.xlarge": 181.44,
    }),
    "aws_db_instance": ("aws", "RDS Instance", "instance_class", 50.00, {
        "db.t3.micro": 12.41, "db.t3.small": 24.82, "db.t3.medium": 49.64, "db.m5.large": 124.10,
        "db.m5.xlarge": 248.20, "db.r5.large": 172.80, "db.r5.xlarge": 345.60,
    }),
    "aws_lambda_function": ("aws", "Lambda Function", None, 5.00, {}),
    "aws_s3_bucket": ("aws", "S3 Bucket", None, 2.30, {}),
    "aws_nat_gateway": ("aws", "NAT Gateway", None, 32.40, {}),
    "aws_elasticache_cluster": ("aws", "ElastiCache Cluster", "node_type", 23.00, {
        "cache.t3.micro": 11.52, "cache.t3.small": 23.04, "cache.m5.large": 110.59,
        "cache.r5.large": 163.58,
    }),
    "aws_lb": ("aws", "Load Balancer", None, 16.20, {}),
    "azurerm_virtual_machine": ("azure", "Azure VM", "vm_size", 70.00, {
        "Standard_B1s": 7.59, "Standard_B2s": 30.37, "Standard_D2s_v3": 70.08,
        "Standard_D4s_v3": 140.16, "Standard_E2s_v3": 91.98, "Standard_F2s_v2": 61.32,
    }),
    "azurerm_linux_virtual_machine": ("azure", "Azure Linux VM", "size", 70.00, {
        "Standard_B1s": 7.59, "Standard_B2s": 30.37, "Standard_D2s_v3": 70.08,
        "Standard_D4s_v3": 140.16,
    }),
    "azurerm_managed_disk": ("azure", "Managed Disk", None, 5.00, {}),
    "azurerm_sql_database": ("azure", "Azure SQL Database", None, 15.00, {}),
    "google_compute_instance": ("gcp", "GCP Compute Instance", "machine_type", 25.00, {
        "e2-micro": 6.11, "e2-small": 12.23, "e2-medium": 24.46, "n1-standard-1": 24.27,
        "n1-standard-2": 48.55, "n1-standard-4": 97.09, "n2-standard-2": 56.52,
        "n2-standard-4": 113.04,
    }),
    "google_sql_database_instance": ("gcp", "Cloud SQL Instance", None, 25.00, {}),
    "google_storage_bucket": ("gcp", "Cloud Storage Bucket", None, 2.30, {}),
    "google_cloud_run_service": ("gcp", "Cloud Run Service", None, 5.00, {}),
}

RATE_SCHEMA = (
    "resource_type string, provider string, description string, size_key string, "
    "default_rate double, rates map<string,double>"
)


def rate_table(spark: SparkSession) -> DataFrame:
    """The price list as a table, one row per resource type."""
    return spark.createDataFrame([(kind, *row) for kind, row in RATES.items()], RATE_SCHEMA)


def supported_resources(rates: DataFrame) -> DataFrame:
    return rates.select(
        F.col("resource_type").alias("type"), "provider", "description",
        (F.size("rates") > 0).alias("has_size_rates"),
    )


_EMPTY = "map<string,string>"


def _changes(document: Column) -> Column:
    """The planned changes of a parsed document with their defaults; pure no-ops are dropped."""
    def filled(c: Column) -> Column:
        kind, name = (F.coalesce(c[field], F.lit("")) for field in ("type", "name"))
        empty = F.create_map().cast(_EMPTY)
        return F.struct(
            F.coalesce(c["address"], F.concat(kind, F.lit("."), name)).alias("address"),
            kind.alias("type"), name.alias("name"),
            F.coalesce(c["change"]["actions"], F.array().cast("array<string>")).alias("actions"),
            F.coalesce(c["change"]["before"], empty).alias("before"),
            F.coalesce(c["change"]["after"], empty).alias("after"),
        )

    planned = F.filter(
        document["resource_changes"],
        lambda c: F.coalesce(c["change"]["actions"] != F.array(F.lit("no-op")), F.lit(True)),
    )
    return F.coalesce(F.transform(planned, filled), F.array())


def explode_plans(
    plans: DataFrame, keep: Sequence[str] = ("plan_id",), document: str = "document"
) -> DataFrame:
    """One row per planned change of a JSON plan; pure no-ops are dropped."""
    parsed = plans.select(*keep, F.from_json(document, PLAN_DOCUMENT).alias("p"))
    return parsed.select(*keep, F.inline(_changes(F.col("p"))))


def _rate(values: Column, price: Column) -> Column:
    """Monthly rate of one side of a change, from its entry of the price list (null if none)."""
    # a type without sizes, a missing attribute and an unknown size all look up null
    size = F.substring_index(F.element_at(values, price["size_key"]), "/", -1)
    priced = F.element_at(price["rates"], size)
    return F.coalesce(priced, price["default_rate"])


def _prices(rates: DataFrame) -> DataFrame:
    """Price list as (type, price), rounded to cents."""
    return rates.select(
        F.col("resource_type").alias("type"),
        F.struct(
            "size_key", F.round("default_rate", 2).alias("default_rate"),
            F.transform_values("rates", lambda _, rate: F.round(rate, 2)).alias("rates"),
        ).alias("price"),
    )


def _with_prices(resources: DataFrame, rates: DataFrame) -> DataFrame:
    # a price list has one row per resource type that providers sell: it stays short whatever is priced
    return resources.join(F.broadcast(_prices(rates)), "type", "left")


def resource_cost(resources: DataFrame, rates: DataFrame, values: str = "after") -> DataFrame:
    """Add ``monthly_cost`` for the attributes in ``values``; null for an unknown type."""
    priced = _with_prices(resources, rates)
    return priced.select(*resources.columns, _rate(F.col(values), F.col("price")).alias("monthly_cost"))


def _kind(actions: Column, replace_mode: str) -> Column:
    """What a change is priced as: ``create``, ``delete``, ``update``, ``replace`` or null.

    A replacement (delete and create) counts as a creation whose old cost is 0; with the mode
    ``delta`` its old cost is taken into account.  Looked up once per change: searching the actions in
    each condition again took over a fifth of a plan's time.
    """
    if replace_mode not in ("create", "delta"):
        raise ValueError("replace_mode is 'create' or 'delta'")
    creates, deletes, updates = (F.array_contains(actions, a) for a in ("create", "delete", "update"))
    if replace_mode == "delta":
        kind = F.when(creates & ~deletes, "create").when(creates, "replace")
    else:
        kind = F.when(creates, "create")
    return kind.when(deletes, "delete").when(updates, "update")


def _monthly(kind: Column, after: Column, before: Column) -> tuple[Column, Column]:
    """Cost after and before a change of a ``_kind``."""
    zero = F.lit(0.0)
    after, before = F.coalesce(after, zero), F.coalesce(before, zero)
    monthly = F.when(kind == "delete", zero).when(kind.isNotNull(), after)
    previous = F.when(kind == "create", zero).when(kind.isNotNull(), before)
    return monthly, previous


def plan_estimates(
    changes: DataFrame, rates: DataFrame, replace_mode: str = "create"
) -> DataFrame:
    """Cost before and after each change (output of :func:`explode_plans`)."""
    price = F.col("price")
    sides = _with_prices(changes, rates).select(
        *changes.columns, _rate(F.col("after"), price).alias("_after"),
        _rate(F.col("before"), price).alias("_before"),
    )
    monthly, previous = _monthly(_kind(F.col("actions"), replace_mode), F.col("_after"), F.col("_before"))
    kept = [c for c in changes.columns if c not in ("actions", "before", "after")]
    return sides.select(
        *kept, F.array_join("actions", "+").alias("action"),
        monthly.alias("monthly_cost"), previous.alias("previous_cost"),
        (F.col("_after").isNull() & F.col("_before").isNull()).alias("unsupported"),
    )


def _delta(monthly: Column, previous: Column) -> Column:
    return F.coalesce(monthly - previous, F.lit(0.0))


def plan_summary(
    plans: DataFrame, rates: DataFrame, keep: Sequence[str] = ("plan_id",),
    document: str = "document", replace_mode: str = "create",
) -> DataFrame:
    """Counts, monthly deltas and unsupported addresses of each plan document.

    A document is one row and stays one: its changes are priced inside the row, so nothing is
    shuffled and no list grows past its document.  The price list arrives as one small map.
    """
    entries = F.map_from_entries(F.collect_list(F.struct("type", "price")))
    catalog = _prices(rates).agg(entries.alias("catalog")).scalar()
    parsed = plans.select(
        *keep, _changes(F.from_json(document, PLAN_DOCUMENT)).alias("_changes"),
        catalog.alias("_catalog"),
    )

    def listed(c: Column) -> Column:
        return F.struct(c.alias("change"), F.element_at(F.col("_catalog"), c["type"]).alias("price"))

    def sides(c: Column) -> Column:
        change, price = c["change"], c["price"]
        return F.struct(
            change["address"].alias("address"), _kind(change["actions"], replace_mode).alias("kind"),
            _rate(change["after"], price).alias("after"), _rate(change["before"], price).alias("before"),
        )

    def outcome(c: Column) -> Column:
        return F.struct(
            c["address"].alias("address"),
            (c["after"].isNull() & c["before"].isNull()).alias("unsupported"),
            _delta(*_monthly(c["kind"], c["after"], c["before"])).alias("delta"),
        )

    def add(sums: Column, c: Column) -> Column:
        zero = F.lit(0.0)
        return F.struct(
            (sums["up"] + F.greatest(c["delta"], zero)).alias("up"),
            (sums["down"] + F.greatest(-c["delta"], zero)).alias("down"),
        )

    def rounded(sums: Column) -> Column:
        return F.struct(
            F.round(sums["up"], 2).alias("up"), F.round(sums["down"], 2).alias("down"),
            F.round(sums["up"] - sums["down"], 2).alias("net"),
        )

    priced = parsed.select(
        *keep, F.transform(F.transform(F.transform("_changes", listed), sides), outcome).alias("_done")
    )
    nothing = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"))
    summed = priced.select(
        *keep, F.size("_done").alias("total_resources"),
        F.aggregate("_done", nothing, add, rounded).alias("_sums"),
        F.transform(F.filter("_done", lambda c: c["unsupported"]), lambda c: c["address"]).alias("unsupported_resources"),
    )
    return summed.select(
        *keep, "total_resources", F.col("_sums.up").alias("estimated_monthly_increase"),
        F.col("_sums.down").alias("estimated_monthly_decrease"), F.col("_sums.net").alias("net_monthly_delta"),
        F.size("unsupported_resources").alias("unsupported_count"), "unsupported_resources",
    )


def estimate_totals(estimates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts and monthly deltas over the plans of each key; sums combine before the shuffle."""
    delta = _delta(F.col("monthly_cost"), F.col("previous_cost"))
    up = F.sum(F.greatest(delta, F.lit(0.0)))
    down = F.sum(F.greatest(-delta, F.lit(0.0)))
    return estimates.groupBy(*keys).agg(
        F.count("*").alias("total_resources"),
        F.round(up, 2).alias("estimated_monthly_increase"),
        F.round(down, 2).alias("estimated_monthly_decrease"),
        F.round(up - down, 2).alias("net_monthly_delta"),
        F.count_if("unsupported").alias("unsupported_count"),
    )
