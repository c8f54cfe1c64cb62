"""Anomalies, forecasts, budgets and alerts over daily series of every tenant and service."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import functions as F

from costlake.operators import alerts, anomaly, costs as c, forecast as fc, forest, whatif
from costlake.operators.joins import join_dimension
from costlake.plans.catalog import query
from costlake.plans.cost_queries import scoped
from costlake.session import scratch_path
from costlake.sources import retail
from costlake.sources.retail import AS_OF

SERIES = ["organization_id", "service"]
HORIZON = 30
#: A period in the middle of the data, so that budgets have spend and a forecast.
BUDGET_AS_OF = dt.datetime(2000, 12, 31, 23, 59, 59)
SENT_AT = dt.datetime(2024, 1, 31, 12, 0)


def daily(spark, sf):
    return c.daily_totals(scoped(spark, sf), SERIES)


def features(spark, sf):
    return anomaly.anomaly_features(daily(spark, sf), SERIES)


def flagged(spark, sf):
    return anomaly.robust_flag(features(spark, sf), 2.0)


def dense(spark, sf):
    rows = scoped(spark, sf).select(*SERIES, F.col("date").alias("ds"), "amount")
    return fc.prepare_series(rows, SERIES)


@query("organization_id:s service:s ds:d amount:m day_of_week:n day_of_month:n is_weekend:n is_month_end:n "
       "cost_change:m cost_change_pct:p rolling_mean_7d:p rolling_std_7d:m rolling_mean_30d:p "
       "deviation_from_mean:m", "SELECT * FROM features", "features")
def anomaly_features(spark, sf):
    return features(spark, sf)


@query("organization_id:s service:s mean_cost:m std_cost:m median_cost:m p95_cost:m samples:n", """
SELECT organization_id, service, mean_cost, std_cost, median_cost, p95_cost, samples
FROM (SELECT organization_id, service, stddev_samp(amount) AS std_cost,
    quantile_cont(amount, 0.5) AS median_cost, quantile_cont(amount, 0.95) AS p95_cost, count(*) AS samples
  FROM service_daily GROUP BY ALL)
JOIN (SELECT organization_id, service,
    -- the exact quotient of whole units of 1e-8, its half rounded away from zero at the fourth decimal
    sign(units) * ((abs(units) * 2 + n * 10000) // (n * 20000)) / 10000.0 AS mean_cost
  FROM (SELECT organization_id, service, CAST(sum(amount) * 100000000 AS HUGEINT) AS units, count(DISTINCT ds) AS n
    FROM costs GROUP BY ALL)) USING (organization_id, service)""", "service_daily costs")
def baseline_stats(spark, sf):
    stats = anomaly.baseline_stats(daily(spark, sf), SERIES)
    return stats.withColumn("mean_cost", F.round("mean_cost", 4))


@query("organization_id:s service:s ds:d is_anomaly:b", "SELECT * FROM flagged", "flagged")
def robust_flag(spark, sf):
    return flagged(spark, sf)


@query("organization_id:s service:s ds:d actual_cost:m expected_cost:m deviation_percent:c severity:s "
       "anomaly_score:c", "SELECT * FROM anomalies", "anomalies")
def anomaly_report(spark, sf):
    return anomaly.anomaly_report(flagged(spark, sf), SERIES)


@query("organization_id:s service:s total_records:n anomalies_found:n anomaly_rate:c", """
SELECT organization_id, service, count(*) AS total_records, count(*) FILTER (WHERE is_anomaly) AS anomalies_found,
  round(count(*) FILTER (WHERE is_anomaly) / count(*) * 100, 2) AS anomaly_rate FROM flagged GROUP BY ALL""",
       "flagged")
def anomaly_rate(spark, sf):
    return anomaly.anomaly_rate(flagged(spark, sf), SERIES)


_ZSCORE = """
SELECT *, abs(z) > 2.5 AS is_anomaly, round(z, 2) AS z_score, round(m, 2) AS baseline_mean, round(s, 2) AS baseline_std,
  CASE WHEN abs(z) > 4 THEN 'critical' WHEN abs(z) > 3 THEN 'high' WHEN abs(z) > 2.5 THEN 'medium' END AS severity
FROM (SELECT d.*, b.m, b.s, CASE WHEN b.s > 0 THEN (d.amount - b.m) / b.s ELSE 0 END AS z
  FROM service_daily d JOIN (SELECT organization_id, service, avg(amount) AS m, stddev_samp(amount) AS s
    FROM service_daily GROUP BY ALL) b ON b.organization_id = d.organization_id AND b.service = d.service)"""


@query("organization_id:s service:s ds:d amount:m is_anomaly:b severity:s z_score:c baseline_mean:c baseline_std:c",
       _ZSCORE, "service_daily")
def zscore_check(spark, sf):
    rows = daily(spark, sf)
    return anomaly.zscore_check(rows, anomaly.baseline_stats(rows, SERIES), SERIES)


@query("organization_id:s total_count:n open_count:n acknowledged_count:n resolved_count:n false_positive_count:n "
       "critical_count:n high_count:n medium_count:n low_count:n", """
SELECT organization_id, count(*) AS total_count,
  count(*) FILTER (WHERE s = 0) AS open_count, count(*) FILTER (WHERE s = 1) AS acknowledged_count,
  count(*) FILTER (WHERE s = 2) AS resolved_count, count(*) FILTER (WHERE s = 3) AS false_positive_count,
  count(*) FILTER (WHERE severity = 'critical') AS critical_count, count(*) FILTER (WHERE severity = 'high') AS high_count,
  count(*) FILTER (WHERE severity = 'medium') AS medium_count, count(*) FILTER (WHERE severity = 'low') AS low_count
FROM (SELECT *, day(ds) % 4 AS s FROM anomalies) GROUP BY ALL""", "anomalies")
def anomaly_counts(spark, sf):
    found = anomaly.anomaly_report(flagged(spark, sf), SERIES)
    states = ("open", "acknowledged", "resolved", "false_positive")
    with_status = found.withColumn("status", retail.pick(states, F.dayofmonth("ds")))
    return anomaly.anomaly_counts(with_status, ["organization_id"])


@query("organization_id:s service:s ds:d amount:m label:n")
def isolation_forest(spark, sf):
    """Trained and applied over the daily features of every series."""
    path = scratch_path(spark, "features")
    features(spark, sf).write.parquet(path)  # read by three jobs, computed by one
    rows = spark.read.parquet(path)
    model = scratch_path(spark, "forest")
    detector = forest.iforest_fit(rows, [*SERIES, "ds"], "medium", path=model)
    return forest.iforest_score(spark.read.parquet(f"{model}/scores"), detector)


#: A small detector with fixed splits, as (tree, node, feature, threshold, path length); the children of node i are
#: 2 i + 1 and 2 i + 2, features are numbered as in ``FEATURES``, and -1 marks a leaf.
FIXED_NODES = (
    (0, 0, 0, 30000.0, 0.0), (0, 1, 8, 1.5, 0.0), (0, 2, -1, 0.0, 2.5), (0, 3, -1, 0.0, 9.25), (0, 4, 5, 5000.0, 0.0),
    (0, 9, -1, 0.0, 6.0), (0, 10, -1, 0.0, 3.0),
    (1, 0, 1, 4.5, 0.0), (1, 1, 7, 20000.0, 0.0), (1, 2, -1, 0.0, 4.0), (1, 3, -1, 0.0, 8.5), (1, 4, -1, 0.0, 5.75),
    (2, 0, 8, -1.0, 0.0), (2, 1, -1, 0.0, 3.5), (2, 2, 2, 15.5, 0.0), (2, 5, -1, 0.0, 7.0), (2, 6, -1, 0.0, 8.0),
)
_SPLITS = ", ".join(str(row) for row in FIXED_NODES)
_VALUE = " ".join(f"WHEN {i} THEN CAST(f.{name} AS DOUBLE)" for i, name in enumerate(anomaly.FEATURES))
_SCALE = repr(2.0 * (math.log(255) + 0.5772156649015329) - 2.0 * 255 / 256)


@query("organization_id:s service:s ds:d raw_score:p", f"""
WITH RECURSIVE nodes(tree, node, feature, threshold, path_length) AS (VALUES {_SPLITS}),
walk AS (
  SELECT f.*, t.tree, 0 AS node FROM features f CROSS JOIN (SELECT DISTINCT tree FROM nodes) t
  UNION ALL
  SELECT f.* EXCLUDE (node), 2 * n.node + 1 + CASE WHEN CASE n.feature {_VALUE} END > n.threshold THEN 1 ELSE 0 END
  FROM walk f JOIN nodes n ON n.tree = f.tree AND n.node = f.node WHERE n.feature >= 0)
SELECT organization_id, service, ds, -pow(2, -avg(path_length) / {_SCALE}) AS raw_score
FROM walk JOIN nodes USING (tree, node) WHERE feature < 0 GROUP BY ALL""", "features")
def forest_score_fixed(spark, sf):
    """Scoring by a detector whose nodes are fixed."""
    nodes = spark.createDataFrame(FIXED_NODES, forest.NODE_SCHEMA)
    return forest.raw_scores(features(spark, sf), nodes, 256.0)


@query("organization_id:s service:s ds:d amount:m label:n")
def saved_forest(spark, sf):
    """Trained, saved, read back against its manifest, and applied: the labels of ``isolation_forest``."""
    model, path = scratch_path(spark, "forest"), scratch_path(spark, "features")
    features(spark, sf).write.parquet(path)
    rows = spark.read.parquet(path)
    forest.iforest_fit(rows, [*SERIES, "ds"], "medium", path=model)
    return forest.iforest_score(rows, forest.load_forest(spark, model))


# ---- forecasts -------------------------------------------------------------------------------


@query("organization_id:s service:s ds:d amount:m", "SELECT * FROM series_days", "series_days")
def prepare_series(spark, sf):
    return dense(spark, sf)


@query("organization_id:s service:s ds:d predicted_cost:m lower_bound:m upper_bound:m",
       "SELECT * FROM forecast", "forecast")
def seasonal_forecast(spark, sf):
    return fc.seasonal_forecast(dense(spark, sf), HORIZON, SERIES)


@query("organization_id:s service:s ds:d predicted_cost:m lower_bound:m upper_bound:m",
       "SELECT * FROM forecast", "forecast")
def horizon_join(spark, sf):
    """The forecast again, by joining a calendar of future days to the weekday profile."""
    profile = fc.weekday_profile(dense(spark, sf), SERIES)
    days = profile.groupBy(*SERIES).agg(F.max("last_day").alias("last")).select(
        *SERIES, F.explode(F.sequence(F.date_add("last", 1), F.date_add("last", HORIZON))).alias("ds"))
    return fc.join_horizon(days, profile, SERIES)


_BOOTSTRAP = """
WITH levels AS (SELECT organization_id, service, isodow(ds) AS dow, quantile_cont(amount, 0.5) AS level FROM series_days GROUP BY ALL),
rs AS (SELECT d.organization_id, d.service, d.ds, CAST(d.amount AS DOUBLE) - l.level AS r,
    row_number() OVER (PARTITION BY d.organization_id, d.service ORDER BY d.ds) - 1 AS i,
    count(*) OVER (PARTITION BY d.organization_id, d.service) AS n
  FROM series_days d JOIN levels l ON l.organization_id = d.organization_id AND l.service = d.service AND l.dow = isodow(d.ds)),
steps AS (SELECT organization_id, service, n, last_ds + CAST(unnest(range(1, 31)) AS INTEGER) AS ds FROM (
  SELECT organization_id, service, max(ds) AS last_ds, max(n) AS n FROM rs GROUP BY ALL HAVING max(n) >= 14)),
paths AS (SELECT organization_id, service, ds, n, unnest(range(0, 20)) AS path FROM steps),
drawn AS (SELECT *, CAST('0x' || md5(concat_ws('|', organization_id, service, CAST(ds AS VARCHAR), CAST(path AS VARCHAR), '42'))[:15]
  AS BIGINT) % n AS i FROM paths)
SELECT d.organization_id, d.service, d.ds, greatest(0, quantile_cont(level + r, 0.5)) AS predicted_cost,
  greatest(0, quantile_cont(level + r, 0.1)) AS lower_bound, greatest(0, quantile_cont(level + r, 0.9)) AS upper_bound
FROM drawn d JOIN levels l ON l.organization_id = d.organization_id AND l.service = d.service AND l.dow = isodow(d.ds)
JOIN rs ON rs.organization_id = d.organization_id AND rs.service = d.service AND rs.i = d.i GROUP BY ALL"""


@query("organization_id:s service:s ds:d predicted_cost:m lower_bound:m upper_bound:m", _BOOTSTRAP, "series_days")
def bootstrap_bands(spark, sf):
    paths = fc.bootstrap_paths(dense(spark, sf), HORIZON, SERIES)
    return fc.bands_from_samples(paths, SERIES)


@query("organization_id:s ds:d predicted_cost:m lower_bound:m upper_bound:m", """
SELECT organization_id, ds, greatest(0, quantile_cont(amount, 0.5)) AS predicted_cost,
  greatest(0, quantile_cont(amount, 0.1)) AS lower_bound, greatest(0, quantile_cont(amount, 0.9)) AS upper_bound
FROM service_daily GROUP BY ALL""", "service_daily")
def bands_from_samples(spark, sf):
    """Each service's daily spend is one path of its tenant."""
    paths = daily(spark, sf).withColumn("value", F.col("amount").cast("double"))
    return fc.bands_from_samples(paths, ["organization_id"])


@query("organization_id:s service:s total_predicted_cost:c average_daily_cost:c forecast_days:n confidence_level:c", """
SELECT organization_id, service, round(sum(predicted_cost), 2) AS total_predicted_cost,
  round(sum(predicted_cost) / count(*), 2) AS average_daily_cost, count(*) AS forecast_days, 0.8 AS confidence_level
FROM forecast GROUP BY ALL""", "forecast")
def forecast_summary(spark, sf):
    return fc.forecast_summary(fc.seasonal_forecast(dense(spark, sf), HORIZON, SERIES), SERIES)


@query("organization_id:s service:s ds:d half_width:m",
       "SELECT organization_id, service, ds, (upper_bound - lower_bound) / 2 AS half_width FROM forecast", "forecast")
def band_half_width(spark, sf):
    return fc.band_half_width(fc.seasonal_forecast(dense(spark, sf), HORIZON, SERIES))


@query("organization_id:s service:s mae:m mape:c band_coverage:m days:n", """
SELECT organization_id, service, avg(abs(amount - predicted)) AS mae,
  avg(CASE WHEN amount <> 0 THEN abs(amount - predicted) / abs(amount) * 100 END) AS mape,
  count(*) FILTER (WHERE amount BETWEEN low AND high) / count(*) AS band_coverage, count(*) AS days
FROM (SELECT a.organization_id, a.service, a.amount, greatest(0, p.level) AS predicted,
        greatest(0, p.low) AS low, greatest(0, p.high) AS high
  FROM (SELECT *, max(ds) OVER (PARTITION BY organization_id, service) AS last_ds FROM series_days) a
  JOIN (SELECT organization_id, service, isodow(ds) AS dow, quantile_cont(amount, 0.5) AS level,
          quantile_cont(amount, 0.1) AS low, quantile_cont(amount, 0.9) AS high
    FROM (SELECT *, max(ds) OVER (PARTITION BY organization_id, service) AS last_ds FROM series_days)
    WHERE ds <= last_ds - 30 GROUP BY ALL) p
  ON p.organization_id = a.organization_id AND p.service = a.service AND p.dow = isodow(a.ds)
  WHERE a.ds > a.last_ds - 30) GROUP BY ALL""", "series_days")
def forecast_accuracy(spark, sf):
    return fc.forecast_accuracy(dense(spark, sf), HORIZON, SERIES)


@query("organization_id:s service:s ds:d amount:m predicted:m lower:m upper:m", """
SELECT organization_id, service, ds, amount, NULL AS predicted, NULL AS lower, NULL AS upper FROM series_days
UNION ALL SELECT organization_id, service, ds, NULL, predicted_cost, lower_bound, upper_bound FROM forecast""",
       "series_days forecast")
def trend_with_forecast(spark, sf):
    history = dense(spark, sf)
    return whatif.trend_with_forecast(history, fc.seasonal_forecast(history, HORIZON, SERIES), SERIES)


# ---- budgets and alerts ----------------------------------------------------------------------


def status(spark, sf):
    return alerts.budget_status(retail.budgets(spark, sf), scoped(spark, sf), BUDGET_AS_OF)


@query("id:s organization_id:s name:s amount:m current_spend:m usage_percent:m remaining:m triggered:s", """
SELECT *, array_to_string(list_filter(thresholds, lambda t: t <= usage_percent), ',') AS triggered FROM budget_state""",
       "budget_state")
def budget_status(spark, sf):
    return status(spark, sf).withColumn(
        "triggered", F.array_join(F.transform("alerts_triggered", lambda t: t.cast("string")), ","))


@query("id:s current_spend:m forecast_end_of_period:m", """
SELECT b.id, b.current_spend, CAST(b.current_spend AS DOUBLE) + coalesce(f.rest, 0) AS forecast_end_of_period
FROM (
  SELECT s.id, coalesce(sum(c.amount), 0) AS current_spend
  FROM (SELECT * FROM budgets JOIN spans ON kind = period) s
  LEFT JOIN costs c ON c.organization_id = s.organization_id AND c.ds BETWEEN s.since_at AND DATE '2000-11-15'
    AND (s.f_service IS NULL OR s.f_service = c.service) AND (s.f_region IS NULL OR s.f_region = c.region)
  GROUP BY s.id) b
LEFT JOIN (
  SELECT s.id, sum(greatest(0, p.level)) AS rest
  FROM (SELECT * FROM budgets JOIN spans ON kind = period) s
  JOIN calendar d ON d.ds > DATE '2000-11-15' AND d.ds <= s.last_day
  JOIN (SELECT organization_id, isodow(ds) AS dow, quantile_cont(CAST(amount AS DOUBLE), 0.5) AS level
        FROM org_days WHERE ds BETWEEN DATE '2000-08-18' AND DATE '2000-11-15' GROUP BY ALL) p
    ON p.organization_id = s.organization_id AND p.dow = isodow(d.ds)
  GROUP BY s.id) f ON f.id = b.id""", "budgets spans costs org_days calendar")
def budget_forecast(spark, sf):
    as_of = dt.datetime(2000, 11, 15, 23, 59, 59)
    costs = scoped(spark, sf)
    state = alerts.budget_status(retail.budgets(spark, sf), costs, as_of)
    return alerts.budget_forecast(state, costs, as_of)


def _flat(df):
    pairs = F.transform("fields", lambda f: F.concat(f["label"], F.lit("="), f["value"]))
    return df.withColumn("details", F.array_join(pairs, "; "))


_BUDGET_ALERTS = """
SELECT 'budget' AS event, organization_id, 'Budget Alert — ' || name AS title,
  'Budget *' || name || '* has reached *' || printf('%.0f', round_even(usage_percent, 0)) || '%* of its limit.' AS message,
  CASE WHEN threshold >= 100 THEN 'critical' WHEN threshold >= 80 THEN 'high' ELSE 'medium' END AS severity,
  'Budget=' || name || '; Current Spend=$'
  || format('{:,.2f}', CAST(current_spend AS DOUBLE))
  || '; Budget Limit=$' || format('{:,.2f}', CAST(amount AS DOUBLE)) || '; Usage=' || printf('%.1f', round(usage_percent, 1))
  || '%; Threshold Crossed=' || CAST(threshold AS VARCHAR) || '%' AS details
FROM (SELECT *, unnest(list_filter(thresholds, lambda t: t <= usage_percent)) AS threshold FROM budget_state)"""


@query("event:s organization_id:s title:s message:s severity:s details:s", _BUDGET_ALERTS, "budget_state")
def budget_alerts(spark, sf):
    return _flat(alerts.budget_alerts(status(spark, sf)))


ANOMALY_ALERTS = """
SELECT 'anomaly' AS event, organization_id, 'Cost Anomaly Detected — ' || upper(severity) AS title,
  'Unusual spending detected on *' || service || '* in account *' || organization_id || '*.' AS message, severity,
  'Service=' || service || '; Account=' || organization_id
  || '; Actual Cost=$' || format('{:,.2f}', round(actual_cost, 2))
  || '; Expected Cost=$' || format('{:,.2f}', round(expected_cost, 2))
  || '; Deviation=' || printf('%+.1f', round(deviation_percent, 1)) || '%; Severity='
  || upper(severity[1]) || severity[2:] AS details
FROM anomalies"""


def _anomaly_alerts(spark, sf, keep=()):
    found = anomaly.anomaly_report(flagged(spark, sf), SERIES)
    return alerts.anomaly_alerts(
        found.withColumns({"account_name": F.col("organization_id"),
                           "actual_cost": F.round("actual_cost", 2), "expected_cost": F.round("expected_cost", 2)}), keep)


def anomaly_events(spark, sf):
    """Anomaly alerts with what tells them apart and their time."""
    return _anomaly_alerts(spark, sf, ["service", "ds"]).withColumn("at", F.col("ds").cast("timestamp"))


@query("event:s organization_id:s title:s message:s severity:s details:s", ANOMALY_ALERTS, "anomalies")
def anomaly_alerts(spark, sf):
    return _flat(_anomaly_alerts(spark, sf))


_SYNC_ALERTS = """
SELECT 'sync_failure' AS event, a.organization_id, 'Sync Failed — ' || a.account_name AS title,
  'Cost sync for *' || a.account_name || '* (' || a.provider || ') failed.' AS message, 'high' AS severity,
  'Account=' || a.account_name || '; Provider=' || a.provider || '; Error=' || r.error[1:200] AS details
FROM sync_results r JOIN cloud_accounts a ON a.id = r.cloud_account_id WHERE r.error IS NOT NULL"""


def _failures(spark, sf):
    from costlake.operators.joins import join_dimension

    named = retail.cloud_accounts(spark, sf).select(
        F.col("id").alias("cloud_account_id"), "organization_id", "account_name", "provider")
    return alerts.sync_failure_alerts(
        join_dimension(retail.sync_results(spark, sf), named, "cloud_account_id"))


@query("event:s organization_id:s title:s message:s severity:s details:s", _SYNC_ALERTS,
       "sync_results cloud_accounts")
def sync_failure_alerts(spark, sf):
    return _flat(_failures(spark, sf))


@query("event:s organization_id:s title:s channel_id:s channel_type:s", f"""
SELECT x.event, x.organization_id, x.title, c.id AS channel_id, c.channel_type
FROM ({_SYNC_ALERTS} UNION ALL {_BUDGET_ALERTS}) x
JOIN channels c ON c.organization_id = x.organization_id AND list_contains(c.events, x.event)""",
       "sync_results cloud_accounts budget_state channels")
def event_channels(spark, sf):
    both = _failures(spark, sf).unionByName(alerts.budget_alerts(status(spark, sf)))
    return alerts.subscribed(both, retail.channels(spark, sf))


@query("channel_id:s channel_type:s organization_id:s event:s severity:s body:s", f"""
SELECT c.id AS channel_id, c.channel_type, x.organization_id, x.event, x.severity, CASE c.channel_type
  WHEN 'slack' THEN '{{"blocks":[{{"type":"header","text":{{"type":"plain_text","text":"⚡ ' || title || '","emoji":true}}}},'
    || '{{"type":"section","text":{{"type":"mrkdwn","text":"' || message || '"}}}},'
    || '{{"type":"section","fields":[{{"type":"mrkdwn","text":"*'
    || replace(replace(details, '=', '*\\n'), '; ', '"}},{{"type":"mrkdwn","text":"*') || '"}}]}},'
    || '{{"type":"context","elements":[{{"type":"mrkdwn","text":"Costlake • ' || event || ' • 2024-01-31 12:00 UTC"}}]}}],'
    || '"attachments":[{{"color":"#e67e22","blocks":[]}}]}}'
  WHEN 'teams' THEN '{{"type":"message","attachments":[{{"contentType":"application/vnd.microsoft.card.adaptive","content":'
    || '{{"$schema":"http://adaptivecards.io/schemas/adaptive-card.json","type":"AdaptiveCard","version":"1.4","body":['
    || '{{"type":"TextBlock","size":"Large","weight":"Bolder","text":"⚡ ' || title || '","color":"Default"}},'
    || '{{"type":"TextBlock","text":"' || message || '","wrap":true}},{{"type":"FactSet","facts":[{{"title":"'
    || replace(replace(details, '=', '","value":"'), '; ', '"}},{{"title":"') || '"}}]}},'
    || '{{"type":"TextBlock","text":"Costlake • ' || event || ' • 2024-01-31 12:00 UTC","size":"Small","isSubtle":true}}]}}}}]}}'
  ELSE '{{"event":"' || event || '","timestamp":"2024-01-31T12:00:00+00:00","title":"' || title || '","message":"' || message
    || '","severity":"' || severity || '","fields":{{"' || replace(replace(details, '=', '":"'), '; ', '","') || '"}}}}' END AS body
FROM ({ANOMALY_ALERTS}) x JOIN channels c ON c.organization_id = x.organization_id AND list_contains(c.events, x.event)""",
       "anomalies channels")
def route_alerts(spark, sf):
    return alerts.route_alerts(_anomaly_alerts(spark, sf), retail.channels(spark, sf), SENT_AT)
