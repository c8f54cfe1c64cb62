"""Stateful streams whose results equal the batch form: features, rates, quantiles, alerts, deliveries."""

from __future__ import annotations

from pyspark.sql import functions as F

from costlake.operators import alerts, metrics
from costlake.plans.catalog import query
from costlake.plans.intake_queries import TASKS, task_messages
from costlake.plans.live import closed, delivered_twice, stored, stream_of
from costlake.plans.series_queries import ANOMALY_ALERTS, SENT_AT, SERIES, anomaly_events, daily
from costlake.sources import retail
from costlake.streaming import alerting, ingest, ordered

#: Minutes of a window; the samples are sparse.
SPAN = 360

# steps of each counter inside windows that are open at their start and closed at their end
_STEPS = f"""
  SELECT 'job-' || CAST(user_id % 4 AS VARCHAR) AS job, le, window_end,
    CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END AS step
  FROM (SELECT *, lag(value) OVER (PARTITION BY user_id, le, window_end ORDER BY ts, value) AS prev
    FROM (SELECT *, make_timestamp(CAST(ceil(epoch_us(ts) / {SPAN * 60}e6) AS BIGINT) * {SPAN * 60}000000) AS window_end
      FROM request_samples))"""


@query("organization_id:s service:s ds:d amount:m day_of_week:n day_of_month:n is_weekend:n is_month_end:n "
       "cost_change:m cost_change_pct:p rolling_mean_7d:p rolling_std_7d:m rolling_mean_30d:p deviation_from_mean:m is_anomaly:b", "SELECT * FROM flagged", "flagged")
def stream_anomaly_flags(spark, sf):
    totals = closed(stored(daily(spark, sf), "daily"), "ds")
    live = ordered.anomaly_flags(totals, SERIES, slice_days=180)
    return ingest.run_to_table(live, mode="append").where("organization_id is not null")


def _samples(spark, sf, metric):
    """Counter samples with their labels as columns."""
    rows = retail.request_samples(spark, sf).where(F.col("metric") == metric)
    return rows.select("ts", "value", *[metrics.label(name).alias(name) for name in ("job", "user", "le")])


@query("job:s window_end:t value:m", f"""
SELECT job, window_end, sum(step) / {SPAN * 60}.0 * 1000 AS value FROM ({_STEPS}) WHERE le = '+Inf' GROUP BY ALL""",
       "request_samples")
def stream_request_rate(spark, sf):
    samples = closed(stored(_samples(spark, sf, "http_requests_total").drop("le"), "samples"), "ts")
    live = ordered.request_rate(samples, ["job"], ["user"], minutes=SPAN)
    rates = ingest.run_to_table(live, mode="append").where("job is not null")
    return rates.withColumn("value", F.col("value") * 1000)


@query("job:s window_end:t quantile:m", f"""
SELECT job, window_end, CASE WHEN bound = CAST('inf' AS DOUBLE) THEN low
    ELSE low + (bound - low) * CASE WHEN cum = below THEN 1 ELSE (total * 0.9 - below) / (cum - below) END END AS quantile
FROM (SELECT *, row_number() OVER (PARTITION BY job, window_end ORDER BY bound) AS rk FROM (
  SELECT *, coalesce(lag(cum) OVER w, 0) AS below, coalesce(lag(bound) OVER w, 0) AS low,
    max(cum) OVER (PARTITION BY job, window_end) AS total
  FROM (SELECT job, window_end, CASE WHEN le = '+Inf' THEN CAST('inf' AS DOUBLE) ELSE CAST(le AS DOUBLE) END AS bound,
      sum(step) / {SPAN * 60}.0 AS cum FROM ({_STEPS}) GROUP BY ALL)
  WINDOW w AS (PARTITION BY job, window_end ORDER BY bound))
  WHERE total > 0 AND cum >= total * 0.9) WHERE rk = 1""", "request_samples")
def stream_bucket_quantile(spark, sf):
    samples = closed(stored(_samples(spark, sf, "http_request_duration_seconds_bucket"), "buckets"), "ts")
    live = ordered.bucket_quantile(samples, 0.9, ["job"], ["user"], minutes=SPAN)
    return ingest.run_to_table(live, mode="append").where("job is not null")


@query("provider:s firing_from:t firing_to:t evaluations:n", """
SELECT provider, min(window_end) AS firing_from, max(window_end) AS firing_to, count(*) AS evaluations
FROM (SELECT *, window_end - row_number() OVER (PARTITION BY provider ORDER BY window_end) * INTERVAL 1 MINUTE AS run
  FROM error_windows WHERE firing)
GROUP BY provider, run HAVING max(window_end) - min(window_end) >= INTERVAL 4 MINUTE""", "error_windows")
def stream_sustained(spark, sf):
    requests = closed(retail.requests(spark, sf, stream_of(spark, sf, "events")), "ts")
    live = alerting.stream_sustained(alerting.error_ratio(requests, ["provider"]), ["provider"], minutes=4)
    return ingest.run_to_table(live, mode="append").where("provider is not null")


@query("event_id:n type:s route:s account_id:s organization_id:s days:n", TASKS)
def stream_sync_tasks(spark, sf):
    """Every message is delivered again after the stream was stopped; it goes on from its checkpoint."""
    messages, again = delivered_twice(task_messages(spark, sf), "messages")
    live = ingest.sync_tasks(ingest.once(messages, "event_id", "ts")).drop("ts")
    return ingest.run_to_table(live, mode="append", again=again)


@query("channel_id:s organization_id:s event:s messages:n deliveries:n", f"""
SELECT c.id AS channel_id, x.organization_id, x.event, count(*) AS messages, count(*) AS deliveries
FROM ({ANOMALY_ALERTS}) x JOIN channels c ON c.organization_id = x.organization_id AND list_contains(c.events, x.event)
GROUP BY ALL""", "anomalies channels")
def stream_alert_outbox(spark, sf):
    """Every alert comes again after a restart; each channel gets it once."""
    found, again = delivered_twice(anomaly_events(spark, sf), "alerts")
    live = alerts.stream_outbox(found, retail.channels(spark, sf), ["service", "ds"], "at", SENT_AT)
    sent = ingest.run_to_table(live.select("channel_id", "organization_id", "event", "delivery_id"), mode="append",
                               again=again)
    return sent.groupBy("channel_id", "organization_id", "event").agg(
        F.count("*").alias("messages"), F.count_distinct("delivery_id").alias("deliveries"))
