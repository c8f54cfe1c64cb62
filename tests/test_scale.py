"""Plans and results that matter once the data no longer fits one task."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from costlake import schemas
from costlake.functions.dates import resolve_window
from costlake.operators import costs as c, joins, logs, metrics
from costlake.operators.quantiles import exact_quantile
from costlake.sources import retail, tables

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2026, 1, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exact_quantile_against_numpy(spark):
    rng = random.Random(5)
    groups = {
        "wide": [rng.lognormvariate(0, 4) for _ in range(501)], "signs": [rng.uniform(-5, 5) for _ in range(400)],
        "same": [3.5] * 90, "one": [7.0], "zeros": [0.0] * 50 + [1e-9, -1e-9, 1e12],
        "near": [1000 + i * 1e-7 for i in range(300)],
    }
    rows = [(k, v, 1) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, value double, n long")
    cells = df.groupBy("k", "value").agg(F.sum("n").alias("n"))
    for q in (0.0, 0.1, 0.5, 0.95, 1.0):
        got = {r.k: r.quantile for r in exact_quantile(cells, ["k"], q).collect()}
        assert set(got) == set(groups)
        for key, values in groups.items():
            assert got[key] == pytest.approx(np.quantile(values, q), rel=1e-12, abs=1e-15), (key, q)


def test_filters_and_columns_reach_the_scan(spark):
    start, end = resolve_window(dt.datetime(2000, 12, 31, 23, 59, 59), 30)
    costs = c.cost_filters(retail.cost_records(spark, SF), retail.cloud_accounts(spark, SF), "1", start, end)
    text = plan(c.total_cost(costs))
    assert "GreaterThanOrEqual(l_shipdate,2000-12-02 00:00:00.0)" in text
    scan = next(line for line in text.splitlines() if "lineitem.parquet" in line)
    assert "l_returnflag" not in scan and "l_discount" not in scan and "l_tax" not in scan
    # one exchange: partial sums, not records
    assert text.count("Exchange") - text.count("BroadcastExchange") <= 1


def test_the_size_limit_of_spark_decides_on_a_broadcast(spark):
    fact = spark.range(100).withColumn("k", F.col("id") % 10)
    dim = spark.range(10).select(F.col("id").alias("k"))
    assert "Broadcast" in plan(joins.join_dimension(fact, dim, "k"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        big = joins.join_dimension(fact, dim, "k")
        assert "SortMergeJoin" in plan(big) and big.count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


@pytest.mark.parametrize("name", ["cost_summary", "account_coverage", "gcp_billing_aggregate", "total_cost", "top_services"])
def test_raw_rows_are_not_sorted_for_an_aggregate(spark, name):
    lines = plan(entry_points.queries()[name](spark, SF)).splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, line in enumerate(lines):
        if "SortAggregate" in line:
            below = [x for x, d in zip(lines[i + 1:], depth[i + 1:]) if d > depth[i]]
            first = next(x for x in below if "Exchange" in x or "Scan" in x or "HashAggregate" in x)
            assert "Scan" not in first, (line, first)


def test_newest_messages_are_limited_before_the_shuffle(spark):
    text = plan(logs.conversation_history(retail.chat_messages(spark, SF)))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_a_hot_series_is_cut_into_slices(spark):
    """A counter that owns nearly all samples: many window groups, and the same increase."""
    rng = random.Random(1)
    values, total, last = [], 0, None
    for _ in range(5000):
        v = rng.randrange(1000)
        if last is not None:
            total += v if v < last else v - last
        values.append(v)
        last = v
    rows = [(T0 + dt.timedelta(seconds=17 * i), "m", {"s": "hot"}, float(v)) for i, v in enumerate(values)]
    rows += [(T0, "m", {"s": f"cold{i}"}, 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, schemas.METRIC_SAMPLES)
    end = T0 + dt.timedelta(days=2)
    got = {r.s: r.value * 48 * 3600 for r in metrics.counter_rate(
        df.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 SECOND")), "m", end, 48, {"s": metrics.label("s")}).collect()}
    assert got["hot"] == pytest.approx(total) and got["cold3"] == 0
    assert "_slice" in plan(metrics.series_totals(df, []))


def test_a_heavy_day_is_written_by_a_rebalance(spark, make_costs):
    assert "REBALANCE_PARTITIONS_BY_COL" in plan(tables.day_files(make_costs(("a1", 0, "x", None, "1"))))


def test_results_do_not_depend_on_the_number_of_partitions(spark):
    costs = c.cost_filters(retail.cost_records(spark, SF), retail.cloud_accounts(spark, SF), None)
    answers = []
    for parts in ("3", "8"):
        was = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            answers.append(sorted(map(tuple, c.cost_by_service(costs, ["organization_id"]).collect())))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", was)
    assert answers[0] == answers[1]


def test_a_floating_key_costs_no_shuffle_or_sort_of_its_own(spark):
    """Series per bound, as the bucket quantile groups them: one shuffle and sort per window, and the same groups."""
    zero, nan = [("-0.0", "a"), ("0.0", "a")], float("nan")
    rows = [(T0 + dt.timedelta(minutes=7 * i), "m", {"s": s}, float(i), float(b) if b else None, s)
            for b, s in [*zero, ("NaN", "a"), ("NaN", "b"), ("inf", "a"), (None, "a")] for i in range(4)]
    df = spark.createDataFrame(rows, "ts timestamp, metric string, labels map<string,string>, value double, b double, s string")
    totals = metrics.series_totals(df, ["b", "s"])
    text = plan(totals)  # before it runs and holds its final plan too
    got = sorted(((repr(r.b), r.s, r.metric, r.increase, r.average) for r in totals.collect()), key=str)
    # the zeros are one series of eight samples, each value twice
    assert got == sorted(((repr(b), s, "m", 3.0, 1.5) for b, s in [(0.0, "a"), (nan, "a"), (nan, "b"), (float("inf"), "a"), (None, "a")]), key=str)
    assert text.count("Exchange hashpartitioning") == 2 and text.count("- Sort [") == 2
