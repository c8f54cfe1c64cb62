"""Container costs, request metrics, alert rules and plan pricing."""

from __future__ import annotations

from pyspark.sql import functions as F

from costlake.operators import infra, k8s, metrics
from costlake.operators.joins import merge_metrics as merged
from costlake.plans.catalog import query
from costlake.plans.views import one_of
from costlake.sources import retail
from costlake.sources.retail import EVENT_HOURS, EVENTS_AS_OF, INSTANCE_SIZES
from costlake.streaming import alerting

WINDOW = "30d"


def by_label(name):
    return {name: metrics.label(name)}


@query("namespace:s value:m", """
SELECT namespace, sum(increase) / 2592000.0 * 1000 AS value FROM metric_series WHERE metric = 'cpu' GROUP BY namespace""",
       "metric_series")
def counter_rate(spark, sf):
    """In thousandths of a core, so that four decimals tell rates apart."""
    rate = metrics.counter_rate(retail.metric_samples(spark, sf), k8s.CPU, EVENTS_AS_OF, EVENT_HOURS, by_label("namespace"))
    return rate.withColumn("value", F.col("value") * 1000)


@query("namespace:s value:m", """
SELECT namespace, sum(average) / 1024 AS value FROM metric_series WHERE metric = 'memory' GROUP BY namespace""",
       "metric_series")
def gauge_avg(spark, sf):
    average = metrics.gauge_avg(retail.metric_samples(spark, sf), k8s.MEMORY, EVENTS_AS_OF, EVENT_HOURS, by_label("namespace"))
    return average.withColumn("value", F.col("value") / 1024)


@query("namespace:s cpu:m memory:m received:m sent:m", """
SELECT namespace, coalesce(sum(increase) FILTER (WHERE metric = 'cpu'), 0) / 2592.0 AS cpu,
  coalesce(sum(average) FILTER (WHERE metric = 'memory'), 0) / 1048576 AS memory,
  coalesce(sum(increase) FILTER (WHERE metric = 'received'), 0) / 2592.0 / 1048576 AS received,
  coalesce(sum(increase) FILTER (WHERE metric = 'sent'), 0) / 2592.0 / 1048576 AS sent
FROM metric_series GROUP BY namespace HAVING count(*) FILTER (WHERE metric IN ('cpu', 'memory')) > 0""",
       "metric_series")
def merge_metrics(spark, sf):
    samples = retail.metric_samples(spark, sf)
    window = (EVENTS_AS_OF, EVENT_HOURS, by_label("namespace"))
    both = merged(
        metrics.counter_rate(samples, k8s.CPU, *window), metrics.gauge_avg(samples, k8s.MEMORY, *window),
        metrics.counter_rate(samples, k8s.RECEIVED, *window), metrics.counter_rate(samples, k8s.SENT, *window),
        ["namespace"])
    return both.withColumns({
        "cpu": F.col("cpu") * 1000, "memory": F.col("memory") / 1048576,
        "received": F.col("received") * 1000 / 1048576, "sent": F.col("sent") * 1000 / 1048576})


def _costs_sql(keys: str, network: bool = False) -> str:
    net = "0" if not network else "net_gb * 0.01"
    return f"""
SELECT {keys}, round(cores * 0.04 * 720 + gb * 0.004 * 720 + {net}, 4) AS cost, round(cores * 0.04 * 720, 4) AS cpu_cost,
  round(gb * 0.004 * 720, 4) AS memory_cost, round({net}, 4) AS network_cost, round(cores, 4) AS cpu_cores,
  round(gb, 4) AS memory_gb, round(net_gb, 4) AS network_gb
FROM (SELECT {keys}, coalesce(sum(increase) FILTER (WHERE metric = 'cpu'), 0) / 2592000.0 AS cores,
    coalesce(sum(average) FILTER (WHERE metric = 'memory'), 0) / 1073741824.0 AS gb,
    coalesce(sum(increase) FILTER (WHERE metric IN ('received', 'sent')), 0) / 1073741824.0 AS net_gb
  FROM keyed GROUP BY {keys} HAVING count(*) FILTER (WHERE metric IN ('cpu', 'memory')) > 0)"""


_NAMESPACE_COSTS = _costs_sql("namespace", True).replace(
    "FROM keyed", "FROM (SELECT * FROM metric_series WHERE namespace <> '')")


@query("namespace:s cost:m cpu_cost:m memory_cost:m network_cost:m cpu_cores:m memory_gb:m network_gb:m",
       _NAMESPACE_COSTS, "metric_series")
def namespace_costs(spark, sf):
    return k8s.namespace_costs(retail.metric_samples(spark, sf), EVENTS_AS_OF, WINDOW)


@query("namespace:s pod:s cost:m cpu_cost:m memory_cost:m cpu_cores:m memory_gb:m",
       _costs_sql("namespace, pod").replace("FROM keyed", "FROM metric_series"), "metric_series")
def pod_costs(spark, sf):
    return k8s.pod_costs(retail.metric_samples(spark, sf), None, EVENTS_AS_OF, WINDOW)


@query("label:s value:s cost:m cpu_cost:m memory_cost:m cpu_cores:m memory_gb:m",
       "SELECT 'app' AS label, * FROM (" + _costs_sql("value").replace(
           "FROM keyed", "FROM (SELECT *, CASE WHEN app = '' THEN 'unlabeled' ELSE app END AS value FROM metric_series)") + ")",
       "metric_series")
def label_costs(spark, sf):
    return k8s.label_costs(retail.metric_samples(spark, sf), EVENTS_AS_OF, "app", WINDOW)


_TREND = """
SELECT TIMESTAMP '2024-01-01 00:00:00' + k * INTERVAL 6 HOUR AS ts, namespace, round(cores * 0.96, 4) AS cpu_cost,
  round(gb * 0.096, 4) AS memory_cost, round(cores * 0.96 + gb * 0.096, 4) AS cost
FROM (SELECT k, namespace, coalesce(sum(increase) FILTER (WHERE metric = 'cpu'), 0) / 3600.0 AS cores,
    coalesce(sum(average) FILTER (WHERE metric = 'memory'), 0) / 1073741824.0 AS gb
  FROM (SELECT k, metric, user_id, CASE WHEN namespace = '' THEN 'unknown' ELSE namespace END AS namespace,
      avg(value) AS average,
      sum(CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END) AS increase
    FROM (SELECT *, lag(value) OVER (PARTITION BY k, metric, user_id ORDER BY ts, value) AS prev
      FROM (SELECT *, CAST(ceil(epoch_us(ts - INTERVAL 0 DAY) / 21600e6) - 1704067200 / 21600 AS BIGINT) AS k FROM metric_samples
            WHERE metric IN ('cpu', 'memory'))
      WHERE ts > TIMESTAMP '2024-01-01 00:00:00' + k * INTERVAL 6 HOUR - INTERVAL 1 HOUR AND k BETWEEN 0 AND 120)
    GROUP BY ALL) GROUP BY ALL)"""


@query("ts:t namespace:s cpu_cost:m memory_cost:m cost:m", _TREND, "metric_samples")
def namespace_trend(spark, sf):
    return k8s.namespace_trend(retail.metric_samples(spark, sf), EVENTS_AS_OF, 30, 6)


@query("cost:c cpu_cores:c memory_gb:c cpu_cost:c memory_cost:c", f"""
SELECT sum(cost) AS cost, sum(cpu_cores) AS cpu_cores, sum(memory_gb) AS memory_gb, sum(cpu_cost) AS cpu_cost,
  sum(memory_cost) AS memory_cost FROM ({_NAMESPACE_COSTS})""", "metric_series")
def k8s_totals(spark, sf):
    return k8s.k8s_totals(namespace_costs(spark, sf))


_PIVOTED = (*(f"ns-{i}" for i in range(11)), "unknown")


@query("date:d " + " ".join(f"{n.replace('-', '_')}:m" for n in _PIVOTED), f"""
SELECT date, {", ".join(f"arg_max(cost, ts) FILTER (WHERE namespace = '{n}') AS {n.replace('-', '_')}" for n in _PIVOTED)}
FROM (SELECT *, CAST(ts AS DATE) AS date FROM ({_TREND})) GROUP BY date""", "metric_samples")
def trend_pivot(spark, sf):
    pivoted = k8s.trend_pivot(namespace_trend(spark, sf), _PIVOTED)
    return pivoted.withColumnsRenamed({n: n.replace("-", "_") for n in _PIVOTED})


# ---- requests --------------------------------------------------------------------------------


@query("job:s value:m", """
SELECT job, cum * 1000 AS value FROM bucket_rates WHERE bound = CAST('inf' AS DOUBLE)""", "bucket_rates")
def request_rate(spark, sf):
    rate = metrics.request_rate(retail.request_samples(spark, sf), EVENTS_AS_OF, by_label("job"),
                                minutes=EVENT_HOURS * 60)
    return rate.withColumn("value", F.col("value") * 1000)


@query("job:s up:n last_seen:t", """
SELECT job, arg_max(up, ts) AS up, max(ts) AS last_seen
FROM (SELECT 'job-' || CAST(user_id % 4 AS VARCHAR) AS job, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS up, ts
  FROM events) GROUP BY job""")
def target_up(spark, sf):
    return metrics.target_up(retail.request_samples(spark, sf))


@query("job:s quantile:m", """
SELECT job, CASE WHEN bound = CAST('inf' AS DOUBLE) THEN lower_bound
  ELSE lower_bound + (bound - lower_bound) * (total * 0.9 - below) / nullif(cum - below, 0) END AS quantile
FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY bound) AS rk
  FROM (SELECT *, coalesce(lag(cum) OVER w, 0) AS below, coalesce(lag(bound) OVER w, 0) AS lower_bound,
      max(cum) OVER (PARTITION BY job) AS total
    FROM bucket_rates WINDOW w AS (PARTITION BY job ORDER BY bound))
  WHERE cum >= total * 0.9) WHERE rk = 1""", "bucket_rates")
def bucket_quantile(spark, sf):
    return metrics.bucket_quantile(
        retail.request_samples(spark, sf), 0.9, EVENTS_AS_OF, EVENT_HOURS, by_label("job"),
        "http_request_duration_seconds_bucket")


@query("provider:s window_start:t window_end:t error_ratio:m firing:b", "SELECT * FROM error_windows", "error_windows")
def error_ratio(spark, sf):
    return alerting.error_ratio(retail.requests(spark, sf), ["provider"])


@query("provider:s window_start:t window_end:t p95:m firing:b", "SELECT * FROM latency_windows", "latency_windows")
def latency_p95(spark, sf):
    return alerting.latency_p95(retail.requests(spark, sf), ["provider"])


@query("provider:s firing_from:t firing_to:t evaluations:n", """
SELECT provider, min(window_end) AS firing_from, max(window_end) AS firing_to, count(*) AS evaluations
FROM (SELECT *, window_end - row_number() OVER (PARTITION BY provider ORDER BY window_end) * INTERVAL 1 MINUTE AS run
  FROM latency_windows WHERE firing)
GROUP BY provider, run HAVING max(window_end) - min(window_end) >= INTERVAL 10 MINUTE""", "latency_windows")
def sustained_latency(spark, sf):
    return alerting.sustained(alerting.latency_p95(retail.requests(spark, sf), ["provider"]), ["provider"], minutes=10)


# ---- infrastructure plans --------------------------------------------------------------------


def changes(spark, sf):
    return infra.explode_plans(retail.plans(spark, sf), ["plan_id", "cloud_account_id"])


def estimates(spark, sf, **options):
    return infra.plan_estimates(changes(spark, sf), infra.rate_table(spark), **options)


@query("plan_id:s address:s type:s name:s action:s", "SELECT * FROM plan_changes", "plan_changes")
def explode_plans(spark, sf):
    return changes(spark, sf).withColumn("action", F.array_join("actions", "+"))


@query("plan_id:s type:s monthly_cost:c", "SELECT plan_id, type, round(after_cost, 2) AS monthly_cost FROM plan_rates",
       "plan_rates")
def resource_cost(spark, sf):
    return infra.resource_cost(changes(spark, sf), infra.rate_table(spark))


@query("plan_id:s address:s action:s monthly_cost:c previous_cost:c unsupported:b", "SELECT * FROM plan_costs", "plan_costs")
def plan_estimates(spark, sf):
    return estimates(spark, sf)


_INSTANCE = "CASE {size} WHEN 't3.micro' THEN 7.59 WHEN 't3.large' THEN 60.74 WHEN 'm5.large' THEN 69.12 " \
    "WHEN 'zones/a/r5.large' THEN 90.72 ELSE 30.0 END"


@query("plan_id:s total_resources:n estimated_monthly_increase:c estimated_monthly_decrease:c net_monthly_delta:c "
       "unsupported_count:n unsupported:s", f"""
SELECT plan_id, CASE WHEN action = 'no-op' THEN 1 ELSE 2 END + CASE WHEN l_tax = 0 THEN 1 ELSE 0 END AS total_resources,
  greatest(instance, 0) + second AS estimated_monthly_increase, greatest(-instance, 0) AS estimated_monthly_decrease,
  instance + second AS net_monthly_delta, CASE WHEN second = 0 THEN 1 ELSE 0 END AS unsupported_count,
  CASE WHEN second = 0 THEN 'aws_iam_role.main' ELSE '' END AS unsupported
FROM (SELECT *, CASE action WHEN 'create' THEN after_cost WHEN 'delete+create' THEN after_cost WHEN 'delete' THEN -before_cost
    WHEN 'update' THEN after_cost - before_cost ELSE 0 END AS instance
  FROM (SELECT *, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS plan_id,
      CASE WHEN l_returnflag = 'A' THEN 'create' WHEN l_returnflag = 'R' THEN 'delete' WHEN l_linestatus = 'F' THEN 'update'
        WHEN l_linenumber = 1 THEN 'delete+create' ELSE 'no-op' END AS action,
      {_INSTANCE.format(size=one_of(INSTANCE_SIZES, "l_partkey"))} AS before_cost,
      {_INSTANCE.format(size=one_of(INSTANCE_SIZES, "l_partkey + l_linenumber"))} AS after_cost,
      CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE 50.0 END AS second FROM lineitem))""")
def plan_summary(spark, sf):
    return infra.plan_summary(retail.plans(spark, sf), infra.rate_table(spark)).withColumn(
        "unsupported", F.array_join("unsupported_resources", ","))


@query("cloud_account_id:s total_resources:n estimated_monthly_increase:c estimated_monthly_decrease:c "
       "net_monthly_delta:c unsupported_count:n", """
SELECT cloud_account_id, count(*) AS total_resources,
  coalesce(sum(greatest(monthly_cost - previous_cost, 0)), 0) AS estimated_monthly_increase,
  coalesce(sum(greatest(previous_cost - monthly_cost, 0)), 0) AS estimated_monthly_decrease,
  coalesce(sum(monthly_cost - previous_cost), 0) AS net_monthly_delta,
  count(*) FILTER (WHERE unsupported) AS unsupported_count
FROM plan_costs GROUP BY cloud_account_id""", "plan_costs")
def account_plan_totals(spark, sf):
    return infra.estimate_totals(estimates(spark, sf), ["cloud_account_id"])


@query("type:s provider:s has_size_rates:b resources:n", """
SELECT t.type, t.provider, t.sized AS has_size_rates, count(p.plan_id) AS resources
FROM (VALUES ('aws_instance', 'aws', true), ('aws_db_instance', 'aws', true), ('aws_lambda_function', 'aws', false),
  ('aws_s3_bucket', 'aws', false), ('aws_nat_gateway', 'aws', false), ('aws_elasticache_cluster', 'aws', true),
  ('aws_lb', 'aws', false), ('azurerm_virtual_machine', 'azure', true), ('azurerm_linux_virtual_machine', 'azure', true),
  ('azurerm_managed_disk', 'azure', false), ('azurerm_sql_database', 'azure', false), ('google_compute_instance', 'gcp', true),
  ('google_sql_database_instance', 'gcp', false), ('google_storage_bucket', 'gcp', false),
  ('google_cloud_run_service', 'gcp', false)) AS t(type, provider, sized)
LEFT JOIN plan_changes p ON p.type = t.type GROUP BY ALL""", "plan_changes")
def supported_resources(spark, sf):
    """The price list with the number of planned changes it prices."""
    used = changes(spark, sf).groupBy("type").agg(F.count("*").alias("n"))
    listed = infra.supported_resources(infra.rate_table(spark)).join(used, "type", "left")
    return listed.withColumn("resources", F.coalesce("n", F.lit(0)))
