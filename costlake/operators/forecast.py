"""Daily forecasts with bands, and how well they did.

The model is a per-weekday profile of each series: its median, 10th and 90th percentile.  Sample
paths of any other model can be turned into the same contract with :func:`bands_from_samples`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Days of history a forecast needs, default paths, confidence reported.
MIN_HISTORY_DAYS = 14
SAMPLE_PATHS = 20
CONFIDENCE_LEVEL = 0.8


def prepare_series(rows: DataFrame, by: Sequence[str] = (), ds: str = "ds") -> DataFrame:
    """One double per day from the first to the last day of each series; gaps hold 0.

    Each day fills the days up to the next one, so no calendar is joined.
    """
    daily = rows.groupBy(*by, F.to_date(ds).alias("ds")).agg(
        F.sum("amount").cast("double").alias("amount")
    )
    following = F.lead("ds").over(Window.partitionBy(*by).orderBy("ds"))
    last_filled = F.coalesce(F.date_sub("_next", 1), F.col("ds"))
    return (
        daily.withColumn("_next", following)
        .withColumn("_day", F.explode(F.sequence("ds", last_filled)))
        .select(
            *by, F.col("_day").alias("ds"),
            F.when(F.col("_day") == F.col("ds"), F.coalesce("amount", F.lit(0.0)))
            .otherwise(F.lit(0.0)).alias("amount"),
        )
    )


def _clipped(column: Column) -> Column:
    return F.greatest(F.lit(0.0), column)


def bands_from_samples(paths: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Median and 10/90 % band of the sample paths at each day, never below 0.

    An even number of paths averages the two middle values.
    """
    at = F.percentile("value", [0.5, 0.1, 0.9])
    return paths.groupBy(*by, "ds").agg(at.alias("_p")).select(
        *by, "ds",
        *[_clipped(F.col("_p")[i]).alias(name)
          for i, name in enumerate(("predicted_cost", "lower_bound", "upper_bound"))],
    )


def weekday_profile(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Percentiles per series and weekday, for series with enough history.

    ``series`` must be dense (see :func:`prepare_series`), so a group holds one value per week.
    """
    stats = series.groupBy(*by, F.weekday("ds").alias("weekday")).agg(
        F.percentile("amount", [0.5, 0.1, 0.9]).alias("_p"),
        F.max("ds").alias("_last"), F.count("*").alias("_n"),
    )
    whole = Window.partitionBy(*by)  # at most seven rows per series
    return stats.select(
        *by, "weekday", F.col("_p")[0].alias("level"), F.col("_p")[1].alias("low"),
        F.col("_p")[2].alias("high"), F.max("_last").over(whole).alias("last_day"),
        F.sum("_n").over(whole).alias("history_days"),
    ).filter(F.col("history_days") >= MIN_HISTORY_DAYS)


def seasonal_forecast(series: DataFrame, horizon: int, by: Sequence[str] = ()) -> DataFrame:
    """``horizon`` days after the last day of each series; shorter histories give no forecast.

    Every weekday row yields its own future days, so the profile is not joined to a calendar.
    """
    if horizon < 1:
        raise ValueError("horizon must be at least 1 day")
    future = F.sequence(F.date_add("last_day", 1), F.date_add("last_day", horizon))
    days = F.filter(future, lambda d: F.weekday(d) == F.col("weekday"))
    return weekday_profile(series, by).select("*", F.explode(days).alias("ds")).select(
        *by, "ds", _clipped(F.col("level")).alias("predicted_cost"),
        _clipped(F.col("low")).alias("lower_bound"), _clipped(F.col("high")).alias("upper_bound"),
    )


def join_horizon(calendar: DataFrame, profile: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Attach the weekday profile to given future days (series keys and ``ds``)."""
    keyed = calendar.withColumn("weekday", F.weekday("ds"))
    return keyed.join(profile, [*by, "weekday"]).select(
        *by, "ds", _clipped(F.col("level")).alias("predicted_cost"),
        _clipped(F.col("low")).alias("lower_bound"), _clipped(F.col("high")).alias("upper_bound"),
    )


def bootstrap_paths(
    series: DataFrame, horizon: int, by: Sequence[str] = (), n: int = SAMPLE_PATHS, seed: int = 42
) -> DataFrame:
    """Deterministic sample paths: weekday level plus a residual of the history chosen by MD5, which every engine has.

    One pass: the history of a series, one value per calendar day, travels in its weekday rows.
    """
    entry = F.struct("ds", F.col("amount").alias("amount"))
    weekdays = series.groupBy(*by, F.weekday("ds").alias("weekday")).agg(
        F.percentile("amount", 0.5).alias("level"), F.collect_list(entry).alias("days"),
    )
    residual = F.transform("days", lambda d: F.struct(
        d["ds"].alias("ds"), (d["amount"] - F.col("level")).alias("r")))
    models = weekdays.select(*by, "weekday", "level", residual.alias("rs")).groupBy(*by).agg(
        F.collect_list(F.struct("weekday", "level")).alias("levels"),
        F.array_sort(F.flatten(F.collect_list("rs"))).alias("rs"),
    ).filter(F.size("rs") >= MIN_HISTORY_DAYS)
    last = F.element_at("rs", -1)["ds"]
    future = F.sequence(F.date_add(last, 1), F.date_add(last, horizon))
    steps = models.withColumn("ds", F.explode(future)).withColumn(
        "level", F.filter("levels", lambda w: w["weekday"] == F.weekday("ds"))
    )
    drawn = steps.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    drawn_by = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in [*by, "ds", "path"]], F.lit(str(seed))))
    pick = (F.conv(F.left(drawn_by, F.lit(15)), 16, 10).cast("long") % F.size("rs")).cast("int")
    return drawn.filter(F.size("level") > 0).select(
        *by, "ds", "path", (F.get("level", F.lit(0))["level"] + F.get("rs", pick)["r"]).alias("value")
    )


def forecast_summary(forecast: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    total, days = F.sum("predicted_cost"), F.count("*")
    return forecast.groupBy(*by).agg(
        F.round(total, 2).alias("total_predicted_cost"),
        F.round(total / days, 2).alias("average_daily_cost"),
        days.alias("forecast_days"),
        F.lit(CONFIDENCE_LEVEL).alias("confidence_level"),
    )


def band_half_width(forecast: DataFrame) -> DataFrame:
    return forecast.withColumn(
        "half_width", (F.col("upper_bound") - F.col("lower_bound")) / 2
    )


def forecast_accuracy(series: DataFrame, holdout: int, by: Sequence[str] = ()) -> DataFrame:
    """Back-test on the last ``holdout`` days: absolute and percentage error, share within band.

    The weekday profile of the days before is a window over the same series, so the history is read
    once; a window partition is one series of calendar days.
    """
    whole = Window.partitionBy(*by)
    split = series.withColumn("_cut", F.date_sub(F.max("ds").over(whole), holdout))
    known = F.col("ds") <= F.col("_cut")
    past = F.percentile(F.when(known, F.col("amount")), [0.5, 0.1, 0.9])
    judged = (
        split.withColumn("_n", F.count_if(known).over(whole))
        .withColumn("_p", past.over(Window.partitionBy(*by, F.weekday("ds"))))
        .filter((F.col("ds") > F.col("_cut")) & (F.col("_n") >= MIN_HISTORY_DAYS)
                & F.col("_p").isNotNull())
    )
    predicted, low, high = (_clipped(F.col("_p")[i]) for i in range(3))
    error = F.abs(F.col("amount") - predicted)
    return judged.groupBy(*by).agg(
        F.avg(error).alias("mae"),
        F.avg(F.when(F.col("amount") != 0, error / F.abs("amount") * 100)).alias("mape"),
        (F.count_if(F.col("amount").between(low, high)) / F.count("*")).alias("band_coverage"),
        F.count("*").alias("days"),
    )
