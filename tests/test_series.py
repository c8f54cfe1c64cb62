import datetime as dt
import math
import os
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from costlake.operators import anomaly, forecast as fc, forest, whatif

DAY0 = dt.date(2026, 1, 1)


@pytest.fixture(scope="module")
def make_series(spark):
    def make(amounts, start=DAY0):
        rows = [(start + dt.timedelta(days=i), float(a)) for i, a in enumerate(amounts)]
        return spark.createDataFrame(rows, "ds date, amount double")
    return make


def test_features_against_pandas(make_series):
    amounts = [100 + (i % 7) * 10 + (250 if i == 20 else 0) for i in range(45)] + [0, 0, 5]
    got = anomaly.anomaly_features(make_series(amounts)).orderBy("ds").toPandas()
    s = pd.Series(amounts, dtype=float)
    days = pd.Series(pd.to_datetime(got["ds"]))
    expected = {
        "day_of_week": days.dt.dayofweek, "day_of_month": days.dt.day, "is_month_end": days.dt.is_month_end.astype(int),
        "cost_change": s.diff().fillna(0),
        "cost_change_pct": s.pct_change().fillna(0).replace([math.inf, -math.inf], 0),
        "rolling_mean_7d": s.rolling(7, min_periods=1).mean(),
        "rolling_std_7d": s.rolling(7, min_periods=1).std().fillna(0),
        "rolling_mean_30d": s.rolling(30, min_periods=1).mean(),
    }
    for name, values in expected.items():
        assert got[name].to_numpy() == pytest.approx(values.to_numpy(), abs=1e-6), name
    # the day itself is in its window, so the deviation cannot reach "critical"
    assert got["deviation_from_mean"].abs().max() < 6 / math.sqrt(7)


def test_report(make_series):
    amounts = [100.0] * 20 + [500.0] + [100.0] * 9
    flagged = anomaly.robust_flag(anomaly.anomaly_features(make_series(amounts)), 2.0)
    report = anomaly.anomaly_report(flagged).collect()
    assert len(report) == 1 and report[0].severity == "high" and report[0].service == "Unknown"
    mean = (6 * 100 + 500) / 7
    assert report[0].deviation_percent == round((500 - mean) / mean * 100, 2)
    rate = anomaly.anomaly_rate(flagged).first()
    assert (rate.total_records, rate.anomalies_found, rate.anomaly_rate) == (30, 1, 3.33)


def test_severity_bounds(spark):
    df = spark.createDataFrame([(3.5,), (-2.5,), (1.5,), (1.0,)], "d double")
    assert [r[0] for r in df.select(anomaly.deviation_severity(F.col("d"))).collect()] == [
        "critical", "high", "medium", "low"]


def test_baseline_and_zscore(spark, make_series):
    amounts = [100 + (d % 5) * 10 for d in range(1, 31)]
    series = make_series(amounts).withColumn("k", F.lit("s"))
    row = anomaly.baseline_stats(series, ["k"]).first()
    assert row.mean_cost == statistics.mean(amounts) and row.std_cost == pytest.approx(statistics.stdev(amounts))
    assert row.median_cost == 120 and row.p95_cost == 140
    base = spark.createDataFrame([("s", 100.0, 10.0), ("flat", 5.0, 0.0)], "k string, mean_cost double, std_cost double")
    rows = spark.createDataFrame([("s", 125.0), ("s", 125.1), ("s", 131.0), ("s", 50.0), ("flat", 9.0)],
                                 "k string, amount double")
    got = [(r.is_anomaly, r.severity, r.z_score) for r in anomaly.zscore_check(rows, base, ["k"]).orderBy("k", "amount").collect()]
    assert got == [(False, None, 0.0), (True, "critical", -5.0), (False, None, 2.5), (True, "medium", 2.51), (True, "high", 3.1)]


def test_counts(spark):
    df = spark.createDataFrame([("open", "high"), ("open", "critical"), ("resolved", "low")], "status string, severity string")
    row = anomaly.anomaly_counts(df).first()
    assert (row.total_count, row.open_count, row.resolved_count, row.critical_count, row.medium_count) == (3, 2, 1, 1, 0)


@pytest.fixture(scope="module")
def planted(make_series):
    amounts = [100 + (i % 5) * 5 for i in range(400)]
    for i in (150, 250, 333):
        amounts[i] = 900
    return anomaly.anomaly_features(make_series(amounts))


def test_forest_finds_planted_outliers(planted):
    scored = forest.iforest_score(planted, forest.iforest_fit(planted, ["ds"], "low")).toPandas()
    outliers = scored[scored["amount"] > 800]
    assert (outliers["label"] == -1).all() and (outliers["score"] < scored["score"].median()).all()
    assert scored["is_anomaly"].mean() == pytest.approx(0.05, abs=0.02)
    assert set(scored["label"]) == {-1, 1}


def test_forest_does_not_depend_on_partitioning(planted):
    nodes = [
        forest.fit_nodes(df, ["ds"], trees=20)[0].toPandas().sort_values(["tree", "node"]).reset_index(drop=True)
        for df in (planted, planted.repartition(7), planted.coalesce(1))
    ]
    for other in nodes[1:]:
        pd.testing.assert_frame_equal(nodes[0], other)
    assert not nodes[0].equals(forest.fit_nodes(planted, ["ds"], trees=20, seed=1)[0].toPandas())
    assert nodes[0].groupby("tree").size().max() <= 511


def test_forest_needs_data_and_survives_restart(planted, make_series, spark, tmp_path):
    with pytest.raises(ValueError, match="insufficient"):
        forest.iforest_fit(anomaly.anomaly_features(make_series([1.0] * 13)), ["ds"])
    path = str(tmp_path / "model")
    saved = forest.iforest_fit(planted, ["ds"], path=path)
    loaded = forest.load_forest(spark, path)
    assert loaded.limit == saved.limit
    a, b = (forest.iforest_score(planted, m).orderBy("ds").toPandas() for m in (saved, loaded))
    pd.testing.assert_frame_equal(a, b)
    nodes = spark.read.parquet(f"{path}/nodes").toPandas()
    nodes.loc[nodes.index[0], "threshold"] += 1  # readable, but not what was saved
    spark.createDataFrame(nodes, forest.NODE_SCHEMA).write.mode("overwrite").parquet(f"{path}/nodes")
    assert forest.load_forest(spark, path) is None
    for part in (tmp_path / "model" / "nodes").glob("*.parquet"):
        part.write_bytes(b"damaged")
    for crc in (tmp_path / "model" / "nodes").glob(".*.crc"):
        os.unlink(crc)
    assert forest.load_forest(spark, path) is None
    assert forest.load_forest(spark, str(tmp_path / "nothing")) is None


def test_gap_filling(spark):
    rows = spark.createDataFrame(
        [(dt.datetime(2026, 1, 1), 60.0), (dt.datetime(2026, 1, 1, 13), 40.0), (dt.datetime(2026, 1, 5, 9), 150.0)],
        "ds timestamp, amount double")
    assert [r.amount for r in fc.prepare_series(rows).orderBy("ds").collect()] == [100, 0, 0, 0, 150]


def test_bands(spark):
    paths = [(p, DAY0 + dt.timedelta(days=h), 101.0 + 10 * p + h) for p in range(3) for h in range(3)]
    df = spark.createDataFrame(paths + [(p, dt.date(2026, 2, 1), -5.0) for p in range(3)], "path int, ds date, value double")
    got = fc.bands_from_samples(df).orderBy("ds").collect()
    assert [r.predicted_cost for r in got] == [111.0, 112.0, 113.0, 0.0]
    assert got[0].lower_bound == pytest.approx(103.0) and got[0].upper_bound == pytest.approx(119.0)
    assert (got[3].lower_bound, got[3].upper_bound) == (0, 0)


def test_weekly_pattern_is_forecast_exactly(make_series):
    series = make_series([100 + (i % 7) * 10 for i in range(60)])
    got = fc.seasonal_forecast(series, 10).orderBy("ds").collect()
    assert [r.predicted_cost for r in got] == [100 + (i % 7) * 10 for i in range(60, 70)]
    assert got[0].ds == DAY0 + dt.timedelta(days=60)
    summary = fc.forecast_summary(fc.seasonal_forecast(series, 10)).first()
    total = sum(100 + (i % 7) * 10 for i in range(60, 70))
    assert (summary.total_predicted_cost, summary.average_daily_cost, summary.forecast_days) == (total, total / 10, 10)
    assert fc.band_half_width(fc.seasonal_forecast(series, 1)).first().half_width == 0
    quality = fc.forecast_accuracy(series, 10).first()
    assert (quality.mae, quality.mape, quality.band_coverage, quality.days) == (0, 0, 1, 10)
    assert fc.seasonal_forecast(make_series([1.0] * 13), 5).count() == 0


def test_bootstrap_is_deterministic(make_series):
    series = make_series([100 + (i % 7) * 10 + (i * 37 % 11) for i in range(60)])
    first, second = (
        [tuple(r) for r in fc.bootstrap_paths(s, 5).orderBy("ds", "path").collect()]
        for s in (series, series.repartition(5)))
    assert first == second and len(first) == 5 * fc.SAMPLE_PATHS
    assert fc.bands_from_samples(fc.bootstrap_paths(series, 5)).filter("lower_bound > upper_bound").count() == 0
    keyed = series.withColumn("k", F.lit("a"))
    assert fc.bootstrap_paths(keyed, 5, ["k"]).count() == 100
    assert fc.bootstrap_paths(make_series([1.0] * 13), 5).count() == 0


def test_what_if(spark):
    df = spark.createDataFrame([(100.0,), (None,)], "amount double")
    got = sorted(r.simulated for r in whatif.what_if(df, 50, 50, 10).collect())
    assert got == [0.0, pytest.approx(100 - 12 - 12 - 10)]
    assert whatif.what_if(df, 50, enabled=False).filter("simulated IS NOT NULL").count() == 0


def test_grid_equals_single_runs(spark):
    df = spark.createDataFrame([(100.0,), (-30.0,), (None,), (7.5,)], "amount double")
    cases = [("a", 0.0, 0.0, 0.0), ("b", 50.0, 20.0, 5.0), ("c", 100.0, 100.0, 100.0)]
    grid = whatif.what_if_grid(df, spark.createDataFrame(cases, "name string, spot double, reserved double, usage double"))
    for row in grid.collect():
        _, spot, reserved, usage = next(c for c in cases if c[0] == row["name"])
        single = whatif.what_if(df, spot, reserved, usage).agg(F.sum("simulated")).first()[0]
        assert row.simulated == pytest.approx(single)


def test_trend_with_forecast(make_series):
    series = make_series([10.0] * 21)
    both = whatif.trend_with_forecast(series, fc.seasonal_forecast(series, 3)).orderBy("ds").collect()
    assert len(both) == 24 and both[0].predicted is None and both[-1].amount is None and both[-1].predicted == 10
