"""Container cost allocation from metric samples."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from costlake.functions.dates import hours_of
from costlake.operators.metrics import keyed, label, lookback, series_totals

#: Prices in USD and the metrics they apply to.
CPU_HOUR, MEMORY_GB_HOUR, NETWORK_GB = 0.04, 0.004, 0.01
GB = 1024**3
CPU = "container_cpu_usage_seconds_total"
MEMORY = "container_memory_working_set_bytes"
RECEIVED = "container_network_receive_bytes_total"
SENT = "container_network_transmit_bytes_total"


def usage(
    samples: DataFrame, as_of: dt.datetime, hours: float, keys: dict[str, Column],
    network: bool = False,
) -> DataFrame:
    """Cores, bytes and network rates per key from one pass over the samples.

    Conditional sums take the place of one scan and one outer join per metric.  Keys without cpu or
    memory samples are dropped.
    """
    wanted = [CPU, MEMORY, *([RECEIVED, SENT] if network else [])]
    rows = keyed(lookback(samples, as_of, hours).filter(F.col("metric").isin(wanted)), keys)
    return _usage(series_totals(rows, list(keys)), list(keys), hours)


def _usage(totals: DataFrame, keys: Sequence[str], hours: float) -> DataFrame:
    def total(metric: str, column: str, divide: float = 1.0) -> Column:
        value = F.sum(F.when(F.col("metric") == metric, F.col(column)))
        return F.coalesce(value / F.lit(float(divide)), F.lit(0.0))

    seconds = hours * 3600
    return (
        totals.groupBy(*keys)
        .agg(
            total(CPU, "increase", seconds).alias("cores"),
            total(MEMORY, "average", GB).alias("gb"),
            (total(RECEIVED, "increase", seconds) + total(SENT, "increase", seconds)).alias("net_rate"),
            F.count_if(F.col("metric").isin(CPU, MEMORY)).alias("_known"),
        )
        .filter("_known > 0").drop("_known")
    )


def _priced(rows: DataFrame, keys: Sequence[str], hours: float, network: bool) -> DataFrame:
    cpu = F.col("cores") * CPU_HOUR * hours
    memory = F.col("gb") * MEMORY_GB_HOUR * hours
    net_gb = F.col("net_rate") * hours * 3600 / GB
    net = net_gb * NETWORK_GB
    cost = cpu + memory + net if network else cpu + memory
    parts = [("cost", cost), ("cpu_cost", cpu), ("memory_cost", memory)]
    parts += [("network_cost", net)] if network else []
    parts += [("cpu_cores", F.col("cores")), ("memory_gb", F.col("gb"))]
    parts += [("network_gb", net_gb)] if network else []
    return rows.select(*keys, *[F.round(c, 4).alias(n) for n, c in parts])


def namespace_costs(samples: DataFrame, as_of: dt.datetime, window: str = "24h") -> DataFrame:
    """Cpu, memory and network cost per namespace, most expensive first; blank names dropped.

    ``cost`` is rounded from the unrounded sum of its parts.
    """
    hours = hours_of(window)
    named = samples.filter(label("namespace") != "")
    rows = usage(named, as_of, hours, {"namespace": label("namespace")}, network=True)
    return _priced(rows, ["namespace"], hours, True).orderBy(F.desc("cost"), "namespace")


def pod_costs(
    samples: DataFrame, namespace: str | None, as_of: dt.datetime, window: str = "24h"
) -> DataFrame:
    """Cost per pod of a namespace (``None``: of every namespace), without network."""
    hours = hours_of(window)
    named = samples.filter(label("pod") != "")
    if namespace is not None:
        named = named.filter(label("namespace") == namespace)
    keys = {"namespace": label("namespace"), "pod": label("pod")}
    rows = usage(named, as_of, hours, keys)
    return _priced(rows, list(keys), hours, False).orderBy(F.desc("cost"), "namespace", "pod")


def label_costs(
    samples: DataFrame, as_of: dt.datetime, name: str = "app", window: str = "24h"
) -> DataFrame:
    """Cost per value of any label; series without it count as ``unlabeled``."""
    hours = hours_of(window)
    owner = F.coalesce(F.nullif(label(name), F.lit("")), F.lit("unlabeled"))
    rows = usage(samples, as_of, hours, {"owner": owner})
    priced = _priced(rows, ["owner"], hours, False).withColumnRenamed("owner", "value")
    return priced.select(F.lit(name).alias("label"), "*").orderBy(F.desc("cost"), "value")


def namespace_trend(
    samples: DataFrame, as_of: dt.datetime, days: int = 7, step_hours: float = 24
) -> DataFrame:
    """Daily cost level of each namespace at every step, from the hour before the step.

    A sample serves the steps less than an hour after it; they are computed from its time stamp, so
    samples outside every look-back are dropped in the scan and no range join is needed.
    """
    step, back = step_hours * 3600, 3600
    start = as_of - dt.timedelta(days=days)
    kind = samples.schema["ts"].dataType
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    since = (micros - F.unix_micros(F.lit(start).cast("timestamp"))) / 1e6
    first = F.greatest(F.ceil(since / step), F.lit(0))
    # steps k with  ts <= start + k*step  and  ts > start + k*step - back
    last = F.least(F.ceil((since + back) / step) - 1, F.lit(int(days * 86400 // step)))
    ts = F.col("ts")
    near = samples.filter(
        F.col("metric").isin(CPU, MEMORY)
        & (ts > F.lit(start - dt.timedelta(seconds=back)).cast(kind))
        & (ts <= F.lit(as_of).cast(kind))
    )
    served = (
        near.withColumn("_first", first).withColumn("_final", last)
        .filter(F.col("_first") <= F.col("_final"))
        .withColumn("step", F.explode(F.sequence("_first", "_final")))
        .withColumn("namespace", F.coalesce(F.nullif(label("namespace"), F.lit("")), F.lit("unknown")))
    )
    per_step = _usage(series_totals(served, ["namespace"], ["step"]), ["namespace", "step"], 1.0)
    cpu, memory = F.col("cores") * CPU_HOUR * 24, F.col("gb") * MEMORY_GB_HOUR * 24
    at = F.timestamp_micros(
        F.unix_micros(F.lit(start).cast("timestamp")) + (F.col("step") * (step * 1e6)).cast("bigint")
    )
    return per_step.select(
        at.alias("ts"), "namespace", F.round(cpu, 4).alias("cpu_cost"),
        F.round(memory, 4).alias("memory_cost"), F.round(cpu + memory, 4).alias("cost"),
    ).orderBy("ts", "namespace")


def k8s_totals(costs: DataFrame) -> DataFrame:
    return costs.agg(*[
        F.sum(c).alias(c) for c in ("cost", "cpu_cores", "memory_gb", "cpu_cost", "memory_cost")
    ])


def trend_pivot(trend: DataFrame, namespaces: Sequence[str]) -> DataFrame:
    """One row per date with a cost column for each of the given namespaces."""
    return trend.groupBy(F.to_date("ts").alias("date")).pivot("namespace", list(namespaces)).agg(
        F.max_by("cost", "ts")
    )
