"""SQL text of the shared views, for the twins of the registered queries."""

from __future__ import annotations

from costlake.sources.retail import HISTOGRAM_BOUNDS, INSTANCE_SIZES, SERVICES

START, END = "TIMESTAMP '1995-01-01 00:00:00'", "TIMESTAMP '2001-12-31 23:59:59'"


def one_of(values, number: str) -> str:
    """CASE that picks a value by number modulo their count."""
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE ({number}) % {len(values)} {arms} END"


VIEWS = {
    "cloud_accounts": f"""
  SELECT CAST(s_suppkey AS VARCHAR) AS id, CAST(n_regionkey AS VARCHAR) AS organization_id,
    {one_of(("demo", "aws", "gcp", "azure"), "s_suppkey")} AS provider,
    'acct-' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS account_id, s_name AS account_name,
    n_name AS business_unit,
    CASE s_suppkey % 3 WHEN 0 THEN 'prod' WHEN 1 THEN 'staging' END AS environment,
    'cc-' || CAST(s_nationkey % 5 AS VARCHAR) AS cost_center, s_acctbal > 0 AS is_active,
    CAST(DATE '1994-01-01' + CAST(s_suppkey % 365 AS INTEGER) AS TIMESTAMP) AS created_at
  FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "cost_records": f"""
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS resource_id,
    CAST(l_suppkey AS VARCHAR) AS cloud_account_id, l_shipdate AS date,
    CAST(l_shipdate AS DATE) AS ds,
    CASE WHEN l_linenumber = 6 THEN 'monthly' ELSE 'daily' END AS granularity,
    {one_of(SERVICES, "l_partkey")} AS service,
    CASE WHEN l_returnflag <> 'N' THEN l_returnflag || l_linestatus END AS region,
    CAST(CASE WHEN l_linenumber = 7 THEN -l_quantity ELSE l_extendedprice END AS DECIMAL(18,8)) AS amount,
    'USD' AS currency, l_tax = 0 AS untagged, l_discount = 0 AS ownerless,
    'w-' || CAST(l_orderkey % 9 AS VARCHAR) AS tag_workload,
    CASE WHEN l_discount <> 0 THEN 'team-' || CAST(l_partkey % 7 AS VARCHAR) END AS tag_owner
  FROM lineitem""",
    "costs": """
  SELECT r.*, a.organization_id, a.provider, a.account_id, a.account_name, a.business_unit,
    a.environment, a.cost_center
  FROM cost_records r JOIN cloud_accounts a ON r.cloud_account_id = a.id""",
    "calendar": f"""
  SELECT CAST(unnest(generate_series({START}, {END}, INTERVAL 1 DAY)) AS DATE) AS ds""",
    "org_daily": """
  SELECT organization_id, ds, sum(amount) AS amount FROM costs GROUP BY ALL""",
    "org_days": """
  SELECT o.organization_id, c.ds, coalesce(d.amount, 0) AS amount
  FROM (SELECT DISTINCT organization_id FROM costs) o CROSS JOIN calendar c
  LEFT JOIN org_daily d ON d.organization_id = o.organization_id AND d.ds = c.ds""",
    "service_daily": """
  SELECT organization_id, service, ds, CAST(sum(amount) AS DOUBLE) AS amount
  FROM costs GROUP BY ALL""",
    "features": """
  SELECT *, (amount - rolling_mean_7d) / (rolling_std_7d + 0.01) AS deviation_from_mean FROM (
    SELECT organization_id, service, ds, amount, isodow(ds) - 1 AS day_of_week,
      day(ds) AS day_of_month, CASE WHEN isodow(ds) >= 6 THEN 1 ELSE 0 END AS is_weekend,
      CASE WHEN ds = last_day(ds) THEN 1 ELSE 0 END AS is_month_end,
      coalesce(amount - lag(amount) OVER w, 0) AS cost_change,
      coalesce((amount - lag(amount) OVER w) / nullif(lag(amount) OVER w, 0), 0) AS cost_change_pct,
      avg(amount) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling_mean_7d,
      coalesce(stddev_samp(amount) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0) AS rolling_std_7d,
      avg(amount) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS rolling_mean_30d
    FROM service_daily WINDOW w AS (PARTITION BY organization_id, service ORDER BY ds))""",
    "flagged": """
  SELECT *, abs(deviation_from_mean) > 2.0 AS is_anomaly, 2.0 - abs(deviation_from_mean) AS score
  FROM features""",
    "anomalies": """
  SELECT organization_id, ds, service, amount AS actual_cost, rolling_mean_7d AS expected_cost,
    round(CASE WHEN rolling_mean_7d > 0 THEN (amount - rolling_mean_7d) / rolling_mean_7d * 100 ELSE 0 END, 2)
      AS deviation_percent,
    CASE WHEN abs(deviation_from_mean) > 3 THEN 'critical' WHEN abs(deviation_from_mean) > 2 THEN 'high'
         WHEN abs(deviation_from_mean) > 1 THEN 'medium' ELSE 'low' END AS severity,
    round(score, 4) AS anomaly_score
  FROM flagged WHERE is_anomaly""",
    "series_days": """
  SELECT s.organization_id, s.service, g.ds, coalesce(d.amount, 0) AS amount
  FROM (SELECT organization_id, service, min(ds) AS first_ds, max(ds) AS last_ds
        FROM service_daily GROUP BY ALL) s
  CROSS JOIN calendar g
  LEFT JOIN service_daily d
    ON d.organization_id = s.organization_id AND d.service = s.service AND d.ds = g.ds
  WHERE g.ds BETWEEN s.first_ds AND s.last_ds""",
    "profile": """
  SELECT organization_id, service, isodow(ds) AS dow, quantile_cont(amount, 0.5) AS level,
    quantile_cont(amount, 0.1) AS low, quantile_cont(amount, 0.9) AS high
  FROM series_days GROUP BY ALL""",
    "horizon": """
  SELECT organization_id, service, last_ds + CAST(unnest(range(1, 31)) AS INTEGER) AS ds FROM (
    SELECT organization_id, service, max(ds) AS last_ds FROM series_days
    GROUP BY ALL HAVING count(*) >= 14)""",
    "forecast": """
  SELECT h.organization_id, h.service, h.ds, greatest(0, p.level) AS predicted_cost,
    greatest(0, p.low) AS lower_bound, greatest(0, p.high) AS upper_bound
  FROM horizon h JOIN profile p ON p.organization_id = h.organization_id
    AND p.service = h.service AND p.dow = isodow(h.ds)""",
    "metric_samples": """
  SELECT * FROM (
    SELECT ts, event_id, user_id,
      CASE event_type WHEN 'click' THEN 'cpu' WHEN 'view' THEN 'memory'
           WHEN 'purchase' THEN 'received' WHEN 'error' THEN 'errors' ELSE 'sent' END AS kind,
      CASE WHEN (user_id % 12 = 10 AND event_type <> 'view') OR (user_id % 12 = 9 AND event_type IN ('click', 'view'))
           THEN 'unscheduled_' || kind ELSE kind END AS metric,
      CASE WHEN user_id % 12 = 11 THEN '' ELSE 'ns-' || CAST(user_id % 12 AS VARCHAR) END AS namespace,
      'pod-' || CAST(user_id AS VARCHAR) AS pod,
      CASE WHEN user_id % 7 = 0 THEN '' ELSE 'app-' || CAST(user_id % 7 AS VARCHAR) END AS app,
      CASE WHEN event_type = 'view' THEN value * 1024 * 1024
           ELSE CASE WHEN event_type IN ('purchase', 'signup') THEN 1048576 ELSE 1 END * sum(value) OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id)
      END AS value
    FROM events)
  WHERE ts > TIMESTAMP '2024-01-01 00:00:00' AND ts <= TIMESTAMP '2024-01-31 00:00:00'""",
    "metric_steps": """
  SELECT *, CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END AS step
  FROM (SELECT *, lag(value) OVER (PARTITION BY metric, user_id ORDER BY ts, value) AS prev
        FROM metric_samples)""",
    "metric_series": """
  SELECT metric, user_id, namespace, pod, app, sum(step) AS increase, avg(value) AS average
  FROM metric_steps GROUP BY ALL""",
    "request_samples": " UNION ALL ".join(
        f"""
  SELECT ts, event_id, user_id, {bound!r} AS le, 'bucket' AS metric,
    CAST(count(*) FILTER (WHERE {condition}) OVER (
      PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS DOUBLE) AS value
  FROM events"""
        for bound, condition in [(str(b), f"value <= {b}") for b in HISTOGRAM_BOUNDS] + [("+Inf", "true")]
    ),
    "bucket_rates": """
  SELECT job, bound, sum(step) / 2592000.0 AS cum FROM (
    SELECT 'job-' || CAST(user_id % 4 AS VARCHAR) AS job,
      CASE WHEN le = '+Inf' THEN CAST('inf' AS DOUBLE) ELSE CAST(le AS DOUBLE) END AS bound,
      CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END AS step
    FROM (SELECT *, lag(value) OVER (PARTITION BY user_id, le ORDER BY ts, value) AS prev
          FROM request_samples
          WHERE ts > TIMESTAMP '2024-01-01 00:00:00' AND ts <= TIMESTAMP '2024-01-31 00:00:00'))
  GROUP BY ALL""",
    "requests": f"""
  SELECT ts, CAST(user_id AS VARCHAR) AS key,
    {one_of(("demo", "aws", "gcp", "azure"), "user_id")} AS provider,
    CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value AS seconds, event_id
  FROM events""",
    "error_windows": """
  SELECT provider, window_end - INTERVAL 5 MINUTE AS window_start, window_end,
    (bad / 300.0) / greatest(n / 300.0, 0.001) AS error_ratio,
    (bad / 300.0) / greatest(n / 300.0, 0.001) > 0.05 AS firing
  FROM (
    SELECT provider, date_trunc('minute', ts) + k * INTERVAL 1 MINUTE AS window_end,
      count(*) FILTER (WHERE status BETWEEN 500 AND 599) AS bad, count(*) AS n
    FROM requests CROSS JOIN (SELECT unnest(range(1, 6)) AS k) GROUP BY ALL)""",
    "latency_windows": """
  SELECT provider, window_end - INTERVAL 10 MINUTE AS window_start, window_end, p95, p95 > 60 AS firing
  FROM (
    SELECT provider, date_trunc('minute', ts) + k * INTERVAL 1 MINUTE AS window_end,
      quantile_cont(seconds, 0.95) AS p95
    FROM requests CROSS JOIN (SELECT unnest(range(1, 11)) AS k) GROUP BY ALL)""",
    "plan_changes": f"""
  SELECT plan_id, cloud_account_id, kind AS type, 'main' AS name, kind || '.main' AS address, action,
    before_size, after_size
  FROM (
    SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS plan_id,
      CAST(l_suppkey AS VARCHAR) AS cloud_account_id, 'aws_instance' AS kind,
      CASE WHEN l_returnflag = 'A' THEN 'create' WHEN l_returnflag = 'R' THEN 'delete'
           WHEN l_linestatus = 'F' THEN 'update' WHEN l_linenumber = 1 THEN 'delete+create'
           ELSE 'no-op' END AS action,
      {one_of(INSTANCE_SIZES, "l_partkey")} AS before_size,
      {one_of(INSTANCE_SIZES, "l_partkey + l_linenumber")} AS after_size
    FROM lineitem
    UNION ALL
    SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR),
      CAST(l_suppkey AS VARCHAR),
      CASE WHEN l_linenumber % 3 = 0 THEN 'aws_iam_role' ELSE 'aws_db_instance' END, 'create', NULL, NULL
    FROM lineitem
    UNION ALL
    SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR),
      CAST(l_suppkey AS VARCHAR), 'aws_s3_bucket', CASE WHEN l_tax = 0 THEN 'read' ELSE 'no-op' END,
      NULL, NULL
    FROM lineitem)
  WHERE action <> 'no-op'""",
    "plan_rates": """
  SELECT *,
    CASE type WHEN 'aws_db_instance' THEN 50.0 WHEN 'aws_s3_bucket' THEN 2.3 WHEN 'aws_instance' THEN
      CASE after_size WHEN 't3.micro' THEN 7.59 WHEN 't3.large' THEN 60.74 WHEN 'm5.large' THEN 69.12
        WHEN 'zones/a/r5.large' THEN 90.72 ELSE 30.0 END END AS after_cost,
    CASE type WHEN 'aws_db_instance' THEN 50.0 WHEN 'aws_s3_bucket' THEN 2.3 WHEN 'aws_instance' THEN
      CASE before_size WHEN 't3.micro' THEN 7.59 WHEN 't3.large' THEN 60.74 WHEN 'm5.large' THEN 69.12
        WHEN 'zones/a/r5.large' THEN 90.72 ELSE 30.0 END END AS before_cost
  FROM plan_changes""",
    "plan_costs": """
  SELECT *, after_cost IS NULL AND before_cost IS NULL AS unsupported,
    CASE WHEN action LIKE '%create%' THEN coalesce(after_cost, 0) WHEN action = 'delete' THEN 0
         WHEN action = 'update' THEN coalesce(after_cost, 0) END AS monthly_cost,
    CASE WHEN action LIKE '%create%' THEN 0 WHEN action = 'delete' THEN coalesce(before_cost, 0)
         WHEN action = 'update' THEN coalesce(before_cost, 0) END AS previous_cost
  FROM plan_rates""",
    "chat_messages": """
  SELECT CAST(conv_id AS VARCHAR) AS conversation_id, CAST(conv_id % 10 AS VARCHAR) AS user_id, role,
    text AS content,
    TIMESTAMP '2024-01-01 00:00:00' + turn * INTERVAL 1 MINUTE + conv_id * INTERVAL 1 HOUR AS created_at
  FROM conversations""",
    "audit_logs": """
  SELECT CAST(user_id % 5 AS VARCHAR) AS organization_id, CAST(user_id AS VARCHAR) AS user_id,
    event_type AS action, 'event' AS resource_type, CAST(event_id AS VARCHAR) AS resource_id,
    props, ts AS created_at
  FROM events""",
    "sync_results": """
  SELECT CAST(user_id AS VARCHAR) AS cloud_account_id, ts AS finished_at,
    CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'syncing' WHEN 'error' THEN 'error'
         ELSE 'ready' END AS status,
    CAST(floor(value) AS BIGINT) AS records_imported,
    CASE WHEN event_type = 'error' THEN 'token=' || props END AS error
  FROM events""",
    "budgets": """
  SELECT CAST(r_regionkey AS VARCHAR) || '-' || period AS id, CAST(r_regionkey AS VARCHAR) AS organization_id,
    upper(period[1]) || period[2:] AS name, amount, period, f_service, f_region, since,
    CASE WHEN r_regionkey <> 0 THEN [10, 50, 80, 100] ELSE [50, 80, 100] END AS thresholds
  FROM region CROSS JOIN (VALUES
    ('monthly', 4000000.0, 'Amazon S3', NULL, DATE '2000-12-01'),
    ('quarterly', 30000000.0, NULL, 'AF', DATE '2000-10-01'),
    ('yearly', 200000000.0, NULL, NULL, DATE '2000-01-01'))
    AS t(period, amount, f_service, f_region, since)
  WHERE r_regionkey <> 4""",
    "spans": """
  SELECT * FROM (VALUES ('monthly', DATE '2000-11-01', DATE '2000-11-30'),
    ('quarterly', DATE '2000-10-01', DATE '2000-12-31'), ('yearly', DATE '2000-01-01', DATE '2000-12-31'))
    AS e(kind, since_at, last_day)""",
    "budget_state": """
  SELECT *, CAST(current_spend AS DOUBLE) * 100 / amount AS usage_percent,
    amount - CAST(current_spend AS DOUBLE) AS remaining FROM (
    SELECT b.id, b.organization_id, b.name, b.period, b.amount, b.thresholds,
      coalesce(sum(c.amount), 0) AS current_spend
    FROM budgets b LEFT JOIN costs c ON c.organization_id = b.organization_id
      AND c.ds BETWEEN b.since AND DATE '2000-12-31'
      AND (b.f_service IS NULL OR b.f_service = c.service)
      AND (b.f_region IS NULL OR b.f_region = c.region)
    GROUP BY ALL)""",
    "channels": """
  SELECT CAST(r_regionkey AS VARCHAR) || '-' || kind AS id, CAST(r_regionkey AS VARCHAR) AS organization_id,
    kind AS channel_type, events
  FROM region CROSS JOIN (VALUES ('slack', ['anomaly', 'budget']), ('teams', ['anomaly', 'sync_failure']),
    ('webhook', ['budget', 'sync_failure', 'anomaly'])) AS t(kind, events)
  WHERE NOT (r_regionkey = 3 AND kind = 'slack')""",
}
