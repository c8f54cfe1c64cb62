"""Exact quantiles of groups that do not fit into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Steps per doubling of the value: a bin spans less than 0.02 % of its values.
BINS_PER_OCTAVE = 4096


def bin_of(value: str) -> Column:
    """The number of the bin of a value: monotone, negatives by falling size, then zero, then positives."""
    size = F.abs(value)
    octave = F.when(size > 0, F.floor(F.log2(size) * BINS_PER_OCTAVE))
    far = 1 << 40
    return (
        F.when(F.col(value) < 0, -octave - far).when(F.col(value) > 0, octave + far).otherwise(F.lit(0))
    )

def wanted_bins(counts: DataFrame, keys: Sequence[str], q: float) -> DataFrame:
    """Of ``counts`` (keys, ``_bin``, ``_n``) the bins that hold the ranks of the quantile: one per group, or
    two if the ranks straddle a border."""
    upto = Window.partitionBy(*keys).orderBy("_bin")
    ranked = counts.select(
        *keys, "_bin", F.sum("_n").over(upto).alias("_end"), F.col("_n"),
        (F.sum("_n").over(Window.partitionBy(*keys)) - 1).alias("_top"),
    ).withColumns({"_start": F.col("_end") - F.col("_n"), "_at": F.col("_top") * F.lit(float(q))})
    low, high = F.floor("_at"), F.ceil("_at")
    return ranked.filter((F.col("_start") <= high) & (F.col("_end") > low)).select(
        *keys, "_bin", "_start", "_at"
    )

def values_at(values: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """The interpolated quantile from the counted values (``_n``) of the wanted bins."""
    low, high = F.floor("_at"), F.ceil("_at")
    inside = Window.partitionBy(*keys, "_bin").orderBy(value)
    placed = values.withColumn("_end", F.col("_start") + F.sum("_n").over(inside)).withColumn(
        "_begin", F.col("_end") - F.col("_n")
    )

    def at(rank):
        here = (F.col("_begin") <= rank) & (F.col("_end") > rank)
        return F.max(F.when(here, F.col(value)))

    picked = placed.groupBy(*keys).agg(
        at(low).alias("_low"), at(high).alias("_high"), F.max(F.col("_at") - low).alias("_part")
    )
    return picked.select(
        *keys, (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias(out)
    )


def exact_quantile(
    cells: DataFrame, keys: Sequence[str], q: float, value: str = "value", n: str = "n",
    out: str = "quantile",
) -> DataFrame:
    """Interpolated quantile per group of ``cells``, rows of (keys, value, count of that value).

    The built-in exact percentile gathers a group's distinct values in one buffer.  Here values are
    first counted per bin, the bins that hold the wanted ranks are looked up, and only their values
    are put in order: a task never sees more of a group than its bins and two of their contents.
    """
    binned = cells.withColumn("_bin", bin_of(value))
    wanted = wanted_bins(binned.groupBy(*keys, "_bin").agg(F.sum(n).alias("_n")), keys, q)
    values = binned.join(wanted, [*keys, "_bin"]).groupBy(*keys, "_bin", value, "_start", "_at").agg(
        F.sum(n).alias("_n"))
    return values_at(values, keys, value, out)


def windowed_quantile(
    panes: DataFrame, by: Sequence[str], q: float, minutes: int, slide: int, out: str = "quantile"
) -> DataFrame:
    """The quantile per key and sliding window ``w`` of ``panes`` (by, ``_pane``, ``value``, ``n``).

    Only counts of bins are spread over the windows that a pane lies in; values are joined to the windows
    for the wanted bins alone.
    """
    keys = [*by, "w"]
    binned = panes.withColumn("_bin", bin_of("value"))
    per_pane = binned.groupBy(*by, "_pane", "_bin").agg(F.sum("n").alias("n"))
    window = F.window("_pane", f"{minutes} minutes", f"{slide} minutes")
    counts = per_pane.select(*by, "_bin", "n", window.alias("w")).groupBy(*keys, "_bin").agg(F.sum("n").alias("_n"))
    step = F.expr(f"INTERVAL {slide} MINUTES")
    wanted = wanted_bins(counts, keys, q).withColumn(
        "_pane", F.explode(F.sequence(F.col("w.start"), F.col("w.end") - step, step)))
    values = binned.join(wanted, [*by, "_pane", "_bin"]).groupBy(*keys, "_bin", "value", "_start", "_at").agg(
        F.sum("n").alias("_n"))
    return values_at(values, keys, "value", out)
