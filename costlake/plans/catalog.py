"""Registration of a query together with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from costlake.plans.views import VIEWS

Build = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}

_SPARK = {
    "s": lambda c: c.cast("string"),
    "n": lambda c: c.cast("bigint"),
    "m": lambda c: F.round(c.cast("double"), 4) + F.lit(0.0),
    "c": lambda c: F.round(c.cast("double"), 2) + F.lit(0.0),
    "p": lambda c: F.round(c.cast("double"), 6) + F.lit(0.0),
    "d": lambda c: F.date_format(c, "yyyy-MM-dd"),
    "t": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss"),
    "b": lambda c: c.cast("string"),
}
_SQL = {
    "s": "CAST({0} AS VARCHAR)",
    "n": "CAST({0} AS BIGINT)",
    "m": "round(CAST({0} AS DOUBLE), 4) + 0.0",
    "c": "round(CAST({0} AS DOUBLE), 2) + 0.0",
    "p": "round(CAST({0} AS DOUBLE), 6) + 0.0",
    "d": "strftime({0}, '%Y-%m-%d')",
    "t": "strftime({0}, '%Y-%m-%d %H:%M:%S')",
    "b": "CAST({0} AS VARCHAR)",
}


def _columns(shape: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in shape.split()]


def query(shape: str, sql: str | None = None, views: str = "") -> Callable[[Build], Build]:
    """Register a query under the function's name.

    ``shape`` lists ``column:kind``; both sides are cut to these columns and types (s text,
    n integer, c two, m four and p six decimals, d date, t time, b boolean), so equal values compare equal.
    ``views`` names the shared SQL views the twin builds on.
    """
    pairs = _columns(shape)

    def register(build: Build) -> Build:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            result = build(spark, sf_dir)
            return result.select(*[_shaped(F.col(n), k).alias(n) for n, k in pairs])

        QUERIES[build.__name__] = run
        if sql is not None:
            used = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in _with_needs(views.split()))
            head = f"WITH {used}\n" if used else ""
            outer = ", ".join(f"{_SQL[k].format(n)} AS {n}" for n, k in pairs)
            ORACLES[build.__name__] = f"{head}SELECT {outer} FROM (\n{sql.strip()}\n) AS answer"
        return build

    return register


def _shaped(column: Column, kind: str) -> Column:
    return _SPARK[kind](column)


def _with_needs(names: list[str]) -> list[str]:
    """Views in dependency order: a view follows those its text mentions."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for other in VIEWS:
            if other != name and f" {other}" in VIEWS[name] and other not in ordered:
                add(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return ordered
