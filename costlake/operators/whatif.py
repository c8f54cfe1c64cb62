"""What-if savings and the trend-plus-forecast series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Share of spend a measure can reach, and the saving on that share.
COMPUTE_SHARE, SPOT_SAVING = 0.4, 0.6
RESERVABLE_SHARE, RESERVED_SAVING = 0.8, 0.3


def _saving_rate(spot: Column, reserved: Column, usage: Column) -> Column:
    """Savings add up; they do not compound."""
    return (
        COMPUTE_SHARE * (spot / 100) * SPOT_SAVING
        + RESERVABLE_SHARE * (reserved / 100) * RESERVED_SAVING
        + usage / 100
    )


def what_if(
    series: DataFrame, spot: float = 0, reserved: float = 0, usage: float = 0,
    enabled: bool = True,
) -> DataFrame:
    """Add ``simulated`` spend for coverage percentages; never below 0, null amounts count as 0."""
    amount = F.coalesce(F.col("amount").cast("double"), F.lit(0.0))
    levels = [F.lit(float(v)) for v in (spot, reserved, usage)]
    simulated = F.greatest(F.lit(0.0), amount - amount * _saving_rate(*levels))
    return series.withColumn("amount", amount).withColumn(
        "simulated", simulated if enabled else F.lit(None).cast("double")
    )


def what_if_grid(series: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Total saving of each scenario row (name, spot, reserved, usage).

    The simulated amount is linear on either side of zero, so two sums over the series settle every
    scenario: the data is read once, whatever the number of scenarios, and rows are not multiplied.
    """
    amount = F.coalesce(F.col("amount").cast("double"), F.lit(0.0))
    sums = series.agg(
        F.sum(F.greatest(amount, F.lit(0.0))).alias("charges"),
        F.sum(F.greatest(-amount, F.lit(0.0))).alias("credits"),
    ).select(F.struct(F.coalesce("charges", F.lit(0.0)).alias("charges"),
                      F.coalesce("credits", F.lit(0.0)).alias("credits")).alias("sums"))
    levels = [F.col(c).cast("double") for c in ("spot", "reserved", "usage")]
    kept = 1 - F.col("rate")
    simulated = (
        F.col("sums.charges") * F.greatest(kept, F.lit(0.0))
        + F.col("sums.credits") * F.greatest(-kept, F.lit(0.0))
    )
    original = F.col("sums.charges") - F.col("sums.credits")
    return scenarios.withColumn("sums", sums.scalar()).withColumn(
        "rate", _saving_rate(*levels)
    ).select("name", original.alias("amount"), simulated.alias("simulated"),
             (original - simulated).alias("saving"))


def trend_with_forecast(
    history: DataFrame, forecast: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """History rows without predictions, followed by forecast rows without amounts."""
    past = history.select(*by, "ds", F.col("amount").cast("double").alias("amount"))
    future = forecast.select(
        *by, "ds", F.col("predicted_cost").alias("predicted"),
        F.col("lower_bound").alias("lower"), F.col("upper_bound").alias("upper"),
    )
    return past.unionByName(future, allowMissingColumns=True)
