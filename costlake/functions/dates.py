"""Reporting windows and step strings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

#: The time-range tokens the dashboards send.
TIME_RANGE_DAYS = {"last_7_days": 7, "last_30_days": 30, "last_90_days": 90}
DEFAULT_RANGE_DAYS = 30


def resolve_window(as_of: dt.datetime, days: int) -> tuple[dt.datetime, dt.datetime]:
    """Inclusive bounds: midnight of ``days - 1`` days before ``as_of``, and ``as_of`` itself."""
    if days < 1:
        raise ValueError("days must be at least 1")
    first = as_of - dt.timedelta(days=days - 1)
    return first.replace(hour=0, minute=0, second=0, microsecond=0), as_of


def in_window(df: DataFrame, start=None, end=None, column: str = "date") -> DataFrame:
    """Keep rows with ``start <= column <= end``; either bound may be open.

    Literals take the column's own type, so the comparison reaches the Parquet scan.  A table
    partitioned by ``usage_date`` is pruned on that column as well.
    """
    kind = df.schema[column].dataType
    partitioned = "usage_date" in df.columns and column != "usage_date"
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start).cast(kind))
        if partitioned:
            df = df.filter(F.col("usage_date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col(column) <= F.lit(end).cast(kind))
        if partitioned:
            df = df.filter(F.col("usage_date") <= F.lit(end).cast("date"))
    return df


def time_range_days(token: Column | str) -> Column:
    """Days meant by a time-range token; anything unknown means 30."""
    token = F.col(token) if isinstance(token, str) else token
    days = F.lit(DEFAULT_RANGE_DAYS)
    for name, value in TIME_RANGE_DAYS.items():
        days = F.when(token == name, F.lit(value)).otherwise(days)
    return days


def window_to_hours(text: Column | str) -> Column:
    """``6h`` is 6, ``7d`` is 168, and anything else 24."""
    text = F.col(text) if isinstance(text, str) else text
    pattern = r"^([0-9]+)(h|d)$"
    number = F.regexp_extract(text, pattern, 1)
    per_unit = F.when(F.regexp_extract(text, pattern, 2) == "d", F.lit(24.0)).otherwise(F.lit(1.0))
    return F.when(text.isNull() | (number == ""), F.lit(24.0)).otherwise(
        number.cast("double") * per_unit
    )


def hours_of(window: str) -> float:
    """Driver-side twin of :func:`window_to_hours`, for operator arguments."""
    count, unit = window[:-1], window[-1:]
    if not (count.isascii() and count.isdigit()) or unit not in {"h", "d"}:
        return 24.0
    return float(count) * (24.0 if unit == "d" else 1.0)
