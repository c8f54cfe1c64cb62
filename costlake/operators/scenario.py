"""Scenario-driven shifts of the service mix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from costlake.functions.text import service_bucket


def _rules(days: int) -> list[tuple[str, Column, str, str]]:
    """Fixed values: (scenario, when it applies, multiplier, event label), over ``b`` and ``d``."""
    b, d = F.col("_bucket"), F.col("day_index")
    half = max(days // 2, 1)
    surge_from = max(10, int(days * 0.62))
    surge_to = min(days - 1, surge_from + 6)
    in_surge = d.between(surge_from, surge_to)
    return [
        ("saas", (d >= half) & (b == "storage"), "1.18", "retention_growth"),
        ("saas", (d % 28 == 0) & (b == "delivery"), "1.12", "launch_cycle"),
        ("startup", (d >= half) & (b == "serverless"), "1.35", "serverless_adoption"),
        ("startup", (d >= half) & (b == "compute"), "0.78", "rightsizing"),
        ("startup", (d % 21 == 0) & b.isin("compute", "serverless"), "1.25", "release_spike"),
        ("enterprise", (d >= int(days * 0.66)) & (b == "database"), "1.18", "quarterly_capacity_step"),
        ("enterprise", (d % 30).isin(0, 1) & (b == "compute"), "0.92", "reserved_capacity_coverage"),
        ("incident", in_surge & (b == "delivery"), "3.60", "traffic_surge"),
        ("incident", in_surge & (b == "compute"), "1.85", "autoscaling_surge"),
        ("incident", (d > surge_to) & (b == "delivery"), "0.94", "post_incident_normalization"),
    ]


def scenario_mix_shift(records: DataFrame, total_days: int) -> DataFrame:
    """Scale ``amount`` by scenario, service class and ``day_index``; list the events that applied.

    Rules that apply together multiply.  Amounts are rounded half-even to four decimals.
    """
    with_bucket = records.withColumn("_bucket", service_bucket("service"))
    factor, events = F.lit("1.0").cast("decimal(4,2)"), []
    for scenario, applies, multiplier, label in _rules(total_days):
        hit = (F.col("scenario") == scenario) & applies
        one = F.lit("1.00").cast("decimal(4,2)")
        factor = (factor * F.when(hit, F.lit(multiplier).cast("decimal(4,2)")).otherwise(one)).cast(
            "decimal(12,6)")
        events.append(F.when(hit, F.lit(label)))
    return with_bucket.withColumns({
        "amount": F.bround(F.col("amount").cast("decimal(18,8)") * factor, 4).cast("decimal(18,4)"),
        "mix_events": F.array_compact(F.array(*events)),
    }).drop("_bucket")
