"""Billing normalization, sync, conversations, audit, tasks, bursts and streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from costlake.operators import anomaly, logs, scenario, sync
from costlake.plans.catalog import query
from costlake.plans.live import closed, stream_of
from costlake.plans.views import one_of
from costlake.session import scratch_path
from costlake.sources import billing, retail, tables
from costlake.sources.retail import SERVICES
from costlake.streaming import alerting, ingest, limits

ACCOUNT = ("cloud_account_id",)
GCP_START, GCP_END = dt.datetime(1990, 1, 1), dt.datetime(2010, 1, 1)

_AWS = f"""
SELECT * FROM (
  SELECT CAST(l_suppkey AS VARCHAR) AS cloud_account_id, CAST(l_shipdate AS DATE) AS date,
    CASE WHEN l_linenumber = 3 THEN 'Unknown' ELSE {one_of(SERVICES, "l_partkey")} END AS service,
    CASE WHEN l_discount <> 0 THEN l_extendedprice ELSE 0 END AS amount,
    CASE WHEN l_linenumber <> 2 THEN 'EUR' ELSE 'USD' END AS currency,
    CASE WHEN l_linenumber <> 4 THEN l_quantity ELSE 0 END AS usage_quantity FROM lineitem
  WHERE l_orderkey % 97 <> 0 AND l_orderkey % 89 <> 0
  UNION ALL
  SELECT CAST(l_suppkey AS VARCHAR), CAST(l_shipdate AS DATE), 'Tax', round(l_tax * 100, 2), 'USD', 0 FROM lineitem
  WHERE l_orderkey % 97 <> 0)
WHERE amount > 0"""


def aws_records(spark, sf):
    return billing.aws_normalize(retail.aws_pages(spark, sf), keep=ACCOUNT)


@query("cloud_account_id:s date:d service:s region:s amount:c currency:s usage_quantity:c",
       f"SELECT *, NULL AS region FROM ({_AWS})")
def aws_normalize(spark, sf):
    return aws_records(spark, sf)


_GCP = """
SELECT CAST(o_orderdate AS DATE) AS usage_date, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderpriority ELSE 'Unknown' END AS service_name,
  CASE o_orderkey % 4 WHEN 0 THEN 'us-central1' WHEN 1 THEN 'eu' WHEN 2 THEN 'asia-a' ELSE 'global' END AS region_name,
  sum(CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN -CAST(o_totalprice AS DECIMAL(18,2)) WHEN o_orderkey % 7 = 0 THEN 0
      ELSE CAST(o_totalprice AS DECIMAL(18,2)) END) AS total_cost,
  min(CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'USD' END) AS currency
FROM orders GROUP BY ALL"""


def gcp_rows(spark, sf):
    return billing.gcp_billing_aggregate(retail.gcp_export(spark, sf), GCP_START, GCP_END)


@query("usage_date:d service_name:s region_name:s total_cost:c currency:s", _GCP)
def gcp_billing_aggregate(spark, sf):
    return gcp_rows(spark, sf)


@query("date:d service:s region:s amount:c currency:s", f"""
SELECT usage_date AS date, service_name AS service, region_name AS region, total_cost AS amount, 'USD' AS currency
FROM ({_GCP}) WHERE total_cost <> 0""")
def gcp_normalize(spark, sf):
    return billing.gcp_normalize(gcp_rows(spark, sf))


@query("row_count:n", "SELECT count(*) AS row_count FROM orders")
def gcp_export_row_count(spark, sf):
    return billing.gcp_export_row_count(retail.gcp_export(spark, sf), GCP_START, GCP_END)


@query("cloud_account_id:s reason:s items:n", """
SELECT cloud_account_id, reason, count(*) AS items FROM (
  SELECT CAST(l_suppkey AS VARCHAR) AS cloud_account_id, CASE WHEN l_orderkey % 97 = 0 THEN 'page' ELSE 'amount' END AS reason
  FROM lineitem WHERE l_orderkey % 97 = 0 OR l_orderkey % 89 = 0) GROUP BY ALL""")
def aws_quarantine(spark, sf):
    lost = billing.aws_quarantine(retail.aws_pages(spark, sf), keep=ACCOUNT)
    return lost.groupBy("cloud_account_id", "reason").agg(F.count("*").alias("items"))


@query("reason:s items:n", "SELECT 'amount' AS reason, count(*) AS items FROM orders WHERE o_orderkey % 13 = 0")
def gcp_quarantine(spark, sf):
    return billing.gcp_quarantine(retail.gcp_export(spark, sf)).groupBy("reason").agg(F.count("*").alias("items"))


_AZURE = f"""
SELECT CAST(l_suppkey AS VARCHAR) AS cloud_account_id, CAST(l_shipdate AS DATE) AS date, {one_of(SERVICES, "l_partkey")} AS service,
  l_returnflag AS region, l_extendedprice AS amount, CASE WHEN l_linenumber = 2 THEN 'USD' ELSE 'EUR' END AS currency
FROM lineitem WHERE l_linenumber NOT IN (1, 5)"""


@query("cloud_account_id:s date:d service:s region:s amount:c currency:s", _AZURE)
def azure_normalize(spark, sf):
    return billing.azure_normalize(retail.azure_rows(spark, sf), keep=ACCOUNT)


@query("cloud_account_id:s cells:n first_cell:s", """
SELECT CAST(l_suppkey AS VARCHAR) AS cloud_account_id, CASE l_linenumber WHEN 1 THEN 3 ELSE 5 END AS cells,
  CASE l_linenumber WHEN 1 THEN printf('%.2f', l_extendedprice) ELSE 'n/a' END AS first_cell
FROM lineitem WHERE l_linenumber IN (1, 5)""")
def azure_quarantine(spark, sf):
    return billing.azure_quarantine(retail.azure_rows(spark, sf), keep=ACCOUNT).select(
        "cloud_account_id", F.size("row").alias("cells"), F.get("row", F.lit(0)).alias("first_cell"))


@query("provider:s service:s records:n amount:c", f"""
SELECT provider, service, count(*) AS records, sum(amount) AS amount FROM (
  SELECT 'aws' AS provider, service, amount FROM ({_AWS})
  UNION ALL SELECT 'azure', service, amount FROM ({_AZURE})
  UNION ALL SELECT 'gcp', service_name, CAST(total_cost AS DOUBLE) FROM ({_GCP}) WHERE total_cost <> 0) GROUP BY ALL""")
def unify_costs(spark, sf):
    merged = billing.unify_costs(
        aws=aws_records(spark, sf), azure=billing.azure_normalize(retail.azure_rows(spark, sf)),
        gcp=billing.gcp_normalize(gcp_rows(spark, sf)))
    return merged.groupBy("provider", "service").agg(F.count("*").alias("records"), F.sum("amount").alias("amount"))


@query("cloud_account_id:s granularity:s currency:s records:n amount:c", f"""
SELECT cloud_account_id, granularity, currency, count(*) AS records, sum(amount) AS amount FROM (
  SELECT cloud_account_id, granularity, currency, CAST(amount AS DOUBLE) AS amount FROM cost_records
  WHERE NOT (granularity = 'daily' AND date BETWEEN TIMESTAMP '1997-01-01 00:00:00' AND TIMESTAMP '1999-12-31 23:59:59'
    AND cloud_account_id IN (SELECT cloud_account_id FROM ({_AWS}) WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'))
  UNION ALL
  SELECT cloud_account_id, 'daily', currency, amount FROM ({_AWS}) WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31')
GROUP BY ALL""", "cost_records")
def replace_windows(spark, sf):
    start, end = dt.datetime(1997, 1, 1), dt.datetime(1999, 12, 31, 23, 59, 59)
    pulled = aws_records(spark, sf).filter(F.col("date").between(F.lit(start), F.lit(end)))
    after = sync.replace_windows(retail.cost_records(spark, sf), pulled, start, end)
    return after.groupBy("cloud_account_id", "granularity", "currency").agg(
        F.count("*").alias("records"), F.sum("amount").alias("amount"))


def _replaced(spark, sf, account):
    start, end = dt.datetime(1997, 1, 1), dt.datetime(1999, 12, 31, 23, 59, 59)
    pulled = aws_records(spark, sf).filter(
        (F.col("cloud_account_id") == account) & F.col("date").between(F.lit(start), F.lit(end)))
    records = retail.cost_records(spark, sf)
    return records, pulled, start, end


@query("cloud_account_id:s granularity:s records:n amount:c", f"""
SELECT cloud_account_id, granularity, count(*) AS records, sum(amount) AS amount FROM (
  SELECT cloud_account_id, granularity, CAST(amount AS DOUBLE) AS amount FROM cost_records
  WHERE NOT (granularity = 'daily' AND date BETWEEN TIMESTAMP '1997-01-01 00:00:00' AND TIMESTAMP '1999-12-31 23:59:59'
    AND cloud_account_id = '3')
  UNION ALL SELECT cloud_account_id, 'daily', amount FROM ({_AWS})
  WHERE cloud_account_id = '3' AND date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31') GROUP BY ALL""", "cost_records")
def replace_window(spark, sf):
    """Account 3 is pulled; an account without a single incoming row keeps what it has."""
    records, pulled, start, end = _replaced(spark, sf, "3")
    after = sync.replace_window(records, pulled, "3", start, end)
    after = sync.replace_window(after, pulled.filter(F.col("cloud_account_id") == "none"), "4", start, end)
    return after.groupBy("cloud_account_id", "granularity").agg(F.count("*").alias("records"), F.sum("amount").alias("amount"))


@query("cloud_account_id:s ds:d records:n amount:c", f"""
SELECT cloud_account_id, ds, count(*) AS records, sum(amount) AS amount FROM (
  SELECT cloud_account_id, ds, CAST(amount AS DOUBLE) AS amount FROM cost_records
  WHERE NOT (granularity = 'daily' AND cloud_account_id = '3'
    AND date BETWEEN TIMESTAMP '1999-12-01 00:00:00' AND TIMESTAMP '1999-12-31 23:59:59')
  UNION ALL SELECT cloud_account_id, date, amount FROM ({_AWS})
  WHERE cloud_account_id = '3' AND date BETWEEN DATE '1999-12-01' AND DATE '1999-12-31') GROUP BY ALL""", "cost_records")
def import_window(spark, sf):
    """The same on a written table, of which only the days of the window are rewritten; read back."""
    start, end = dt.datetime(1999, 12, 1), dt.datetime(1999, 12, 31, 23, 59, 59)
    records, pulled, _, _ = _replaced(spark, sf, "3")
    pulled = pulled.filter(F.col("date") >= F.lit(start))
    path = scratch_path(spark, "charges")
    tables.write_costs(records, path)
    sync.import_window(spark, path, pulled, "3", start, end)
    return tables.read_costs(spark, path).groupBy("cloud_account_id", F.to_date("date").alias("ds")).agg(
        F.count("*").alias("records"), F.sum("amount").alias("amount"))


_IMPORTED = f"""
  SELECT cloud_account_id, ds, service, CAST(amount AS DOUBLE) AS amount FROM cost_records
  WHERE NOT (granularity = 'daily' AND cloud_account_id = '3'
    AND date BETWEEN TIMESTAMP '1999-12-01 00:00:00' AND TIMESTAMP '1999-12-31 23:59:59')
  UNION ALL SELECT cloud_account_id, date, service, amount FROM ({_AWS})
  WHERE cloud_account_id = '3' AND date BETWEEN DATE '1999-12-01' AND DATE '1999-12-31'"""


def _imported(spark, sf, rollup=None):
    """The charges as versioned months, with a rollup, and then one month of an account replaced in one step."""
    start, end = dt.datetime(1999, 12, 1), dt.datetime(1999, 12, 31, 23, 59, 59)
    records, pulled, _, _ = _replaced(spark, sf, "3")
    charges = scratch_path(spark, "charges")
    sync.write_charges(records, charges, "month")
    if rollup:
        sync.refresh_rollup(spark, charges, rollup)
    sync.import_charges(spark, charges, pulled.filter(F.col("date") >= F.lit(start)), "3", start, end, "month")
    return charges


@query("cloud_account_id:s ds:d records:n amount:c", f"""
SELECT cloud_account_id, ds, count(*) AS records, sum(amount) AS amount FROM ({_IMPORTED}) GROUP BY ALL""", "cost_records")
def import_charges(spark, sf):
    return sync.read_charges(spark, _imported(spark, sf)).groupBy("cloud_account_id", F.to_date("date").alias("ds")).agg(
        F.count("*").alias("records"), F.sum("amount").alias("amount"))


@query("ds:d service:s records:n amount:c", f"""
SELECT ds, service, count(*) AS records, sum(amount) AS amount FROM ({_IMPORTED}) GROUP BY ALL""", "cost_records")
def rollup_by_service(spark, sf):
    """Daily spend by service from the rollup, of which only the month of the import was summed again."""
    rollup = scratch_path(spark, "rollup")
    sync.refresh_rollup(spark, _imported(spark, sf, rollup), rollup)
    return sync.read_rollup(spark, rollup).groupBy("ds", "service").agg(
        F.sum("records").alias("records"), F.sum("amount").alias("amount"))


@query("account_id:s last_sync_status:s last_sync_completed_at:t records:s last_sync_error:s", """
SELECT a.id AS account_id, coalesce(r.status, 'never_synced') AS last_sync_status,
  CASE WHEN r.status IN ('ready', 'error') THEN r.finished_at END AS last_sync_completed_at,
  CASE r.status WHEN 'ready' THEN CAST(r.records_imported AS VARCHAR) WHEN 'error' THEN '0' END AS records,
  r.error AS last_sync_error
FROM cloud_accounts a LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY cloud_account_id ORDER BY finished_at DESC, status DESC) AS rk FROM sync_results) r
  ON r.cloud_account_id = a.id AND r.rk = 1""", "cloud_accounts sync_results")
def sync_telemetry(spark, sf):
    state = sync.sync_telemetry(retail.cloud_accounts(spark, sf), retail.sync_results(spark, sf))
    return state.withColumn("records", F.col("last_sync_records_imported").cast("string"))


@query("id:s organization_id:s provider:s", "SELECT * FROM cloud_accounts WHERE is_active", "cloud_accounts")
def select_sync_accounts(spark, sf):
    return sync.select_sync_accounts(retail.cloud_accounts(spark, sf), None)


_BUCKET = """CASE WHEN service IN ('AWS Lambda', 'Azure Functions') THEN 'serverless'
  WHEN service IN ('Amazon RDS', 'SQL Database') THEN 'database' WHEN service IN ('Amazon S3', 'Blob Storage') THEN 'storage'
  WHEN service IN ('Amazon CloudFront', 'Azure CDN') THEN 'delivery' ELSE 'compute' END"""


@query("resource_id:s scenario:s day_index:n adjusted:m events:s", f"""
SELECT resource_id, scenario, d AS day_index, concat_ws(',', e1, e2, e3) AS events,
  sign(micros) * (abs(micros) // 100 + CASE WHEN abs(micros) % 100 > 50 OR (abs(micros) % 100 = 50 AND abs(micros) // 100 % 2 = 1)
    THEN 1 ELSE 0 END) / 10000.0 AS adjusted
FROM (SELECT *, CAST(round(CAST(amount AS DOUBLE) * 100) AS BIGINT) * CAST(round(m1 * m2 * m3 * 10000) AS BIGINT) AS micros FROM (SELECT *,
  CASE WHEN scenario = 'saas' AND d >= 1278 AND b = 'storage' THEN 1.18 WHEN scenario = 'startup' AND d >= 1278 AND b = 'serverless' THEN 1.35
    WHEN scenario = 'startup' AND d >= 1278 AND b = 'compute' THEN 0.78 WHEN scenario = 'enterprise' AND d >= 1687 AND b = 'database' THEN 1.18
    WHEN scenario = 'incident' AND d BETWEEN 1585 AND 1591 AND b = 'delivery' THEN 3.60
    WHEN scenario = 'incident' AND d BETWEEN 1585 AND 1591 AND b = 'compute' THEN 1.85
    WHEN scenario = 'incident' AND d > 1591 AND b = 'delivery' THEN 0.94 ELSE 1.0 END AS m1,
  CASE WHEN scenario = 'saas' AND d >= 1278 AND b = 'storage' THEN 'retention_growth'
    WHEN scenario = 'startup' AND d >= 1278 AND b = 'serverless' THEN 'serverless_adoption'
    WHEN scenario = 'startup' AND d >= 1278 AND b = 'compute' THEN 'rightsizing'
    WHEN scenario = 'enterprise' AND d >= 1687 AND b = 'database' THEN 'quarterly_capacity_step'
    WHEN scenario = 'incident' AND d BETWEEN 1585 AND 1591 AND b = 'delivery' THEN 'traffic_surge'
    WHEN scenario = 'incident' AND d BETWEEN 1585 AND 1591 AND b = 'compute' THEN 'autoscaling_surge'
    WHEN scenario = 'incident' AND d > 1591 AND b = 'delivery' THEN 'post_incident_normalization' END AS e1,
  CASE WHEN scenario = 'saas' AND d % 28 = 0 AND b = 'delivery' THEN 1.12 WHEN scenario = 'enterprise' AND d % 30 < 2 AND b = 'compute' THEN 0.92 ELSE 1.0 END AS m2,
  CASE WHEN scenario = 'saas' AND d % 28 = 0 AND b = 'delivery' THEN 'launch_cycle' WHEN scenario = 'enterprise' AND d % 30 < 2 AND b = 'compute' THEN 'reserved_capacity_coverage' END AS e2,
  CASE WHEN scenario = 'startup' AND d % 21 = 0 AND b IN ('compute', 'serverless') THEN 1.25 ELSE 1.0 END AS m3,
  CASE WHEN scenario = 'startup' AND d % 21 = 0 AND b IN ('compute', 'serverless') THEN 'release_spike' END AS e3
  FROM (SELECT resource_id, amount, {_BUCKET} AS b, {one_of(("saas", "startup", "enterprise", "incident"), "CAST(cloud_account_id AS BIGINT)")} AS scenario,
    date_diff('day', DATE '1995-01-01', ds) AS d FROM cost_records)))""", "cost_records")
def scenario_mix_shift(spark, sf):
    names = ("saas", "startup", "enterprise", "incident")
    records = retail.cost_records(spark, sf).select(
        "resource_id", "service", "amount",
        retail.pick(names, F.col("cloud_account_id").cast("bigint")).alias("scenario"),
        F.datediff("date", F.lit("1995-01-01").cast("date")).alias("day_index"))
    shifted = scenario.scenario_mix_shift(records, retail.ALL_DAYS)
    return shifted.select("resource_id", "scenario", "day_index", F.col("amount").alias("adjusted"),
                          F.array_join("mix_events", ",").alias("events"))


# ---- conversations, audit, accounts ----------------------------------------------------------


_RANKED = """SELECT *, row_number() OVER (PARTITION BY conversation_id, user_id
  ORDER BY created_at DESC, role DESC, content DESC) AS rk FROM chat_messages"""


@query("conversation_id:s user_id:s role:s content:s created_at:t", f"SELECT * FROM ({_RANKED}) WHERE rk <= 20",
       "chat_messages")
def conversation_history(spark, sf):
    return logs.conversation_history(retail.chat_messages(spark, sf))


@query("user_id:s conversation_id:s message_count:n last_message_at:t preview:s", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_message_at DESC, conversation_id) AS rk
  FROM (SELECT user_id, conversation_id, count(*) AS message_count, max(created_at) AS last_message_at,
      substring(min(content), 1, 80) AS preview FROM chat_messages WHERE role = 'user' GROUP BY ALL)) WHERE rk <= 20""",
       "chat_messages")
def conversation_list(spark, sf):
    return logs.conversation_list(retail.chat_messages(spark, sf))


@query("conversation_id:s user_id:s history:s", f"""
SELECT conversation_id, user_id, string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || content,
  chr(10) ORDER BY rk DESC) AS history FROM ({_RANKED}) WHERE rk <= 10 GROUP BY ALL""", "chat_messages")
def prompt_history(spark, sf):
    return logs.prompt_history(retail.chat_messages(spark, sf))


@query("conversation_id:s user_id:s messages:n", """
SELECT conversation_id, user_id, count(*) AS messages FROM chat_messages
WHERE NOT (conversation_id = '17' AND user_id = '7') GROUP BY ALL""", "chat_messages")
def delete_conversation(spark, sf):
    left = logs.delete_conversation(retail.chat_messages(spark, sf), "17", "7")
    return left.groupBy("conversation_id", "user_id").agg(F.count("*").alias("messages"))


@query("organization_id:s action:s resource_id:s created_at:t", """
SELECT * FROM audit_logs WHERE action = 'purchase'
ORDER BY created_at DESC, action, resource_type, resource_id LIMIT 50 OFFSET 50""", "audit_logs")
def audit_page(spark, sf):
    return logs.audit_page(retail.audit_logs(spark, sf), None, "purchase", page=2)


@query("id:s organization_id:s provider:s account_name:s created_at:t", """
SELECT * FROM cloud_accounts WHERE is_active ORDER BY created_at DESC, id LIMIT 20 OFFSET 20""", "cloud_accounts")
def list_accounts(spark, sf):
    return logs.list_accounts(retail.cloud_accounts(spark, sf), None, is_active=True, page=2, page_size=20)


@query("total:n total_pages:n", """
SELECT count(*) AS total, (count(*) + 19) // 20 AS total_pages FROM cloud_accounts WHERE is_active""", "cloud_accounts")
def account_pages(spark, sf):
    return logs.account_pages(retail.cloud_accounts(spark, sf), None, is_active=True, page_size=20)


@query("organization_id:s provider:s account_id:s copies:n", """
SELECT organization_id, provider, account_id, count(*) AS copies FROM (
  SELECT organization_id, provider, 'c-' || CAST(CAST(id AS BIGINT) // 10 AS VARCHAR) AS account_id FROM cloud_accounts)
GROUP BY ALL HAVING count(*) > 1""", "cloud_accounts")
def duplicate_accounts(spark, sf):
    accounts = retail.cloud_accounts(spark, sf).withColumn(
        "account_id", F.concat(F.lit("c-"), F.expr("CAST(CAST(id AS BIGINT) div 10 AS STRING)")))
    return logs.duplicate_accounts(accounts)


# ---- tasks, bursts, streams ------------------------------------------------------------------


def task_messages(spark, sf):
    """A task message per event."""
    user = F.col("user_id").cast("string")
    kind = F.col("event_type")
    body = F.when(kind == "click", F.to_json(F.struct(F.lit("sync_account").alias("type"), user.alias("account_id"),
                                                      F.floor("value").cast("int").alias("days"))))
    body = body.when(kind == "view", F.to_json(F.struct(
        F.lit("sync_all").alias("type"), (F.col("user_id") % 5).cast("string").alias("organization_id"))))
    body = body.when(kind == "error", F.lit("not json")).otherwise(F.to_json(F.struct(
        F.lit("cleanup").alias("type"), user.alias("account_id"))))
    return retail.table(spark, sf, "events").select("event_id", "ts", body.alias("value"))


TASKS = """
SELECT event_id, CASE event_type WHEN 'click' THEN 'sync_account' WHEN 'view' THEN 'sync_all' WHEN 'error' THEN 'unknown'
    ELSE 'cleanup' END AS type,
  CASE event_type WHEN 'click' THEN 'sync_account' WHEN 'view' THEN 'sync_all' ELSE 'dropped' END AS route,
  CASE WHEN event_type NOT IN ('view', 'error') THEN CAST(user_id AS VARCHAR) END AS account_id,
  CASE WHEN event_type = 'view' THEN CAST(user_id % 5 AS VARCHAR) END AS organization_id,
  CASE WHEN event_type = 'click' THEN CAST(floor(value) AS INTEGER) ELSE 30 END AS days FROM events"""


@query("event_id:n type:s route:s account_id:s organization_id:s days:n", TASKS)
def sync_tasks(spark, sf):
    return ingest.sync_tasks(task_messages(spark, sf))


@query("id:s organization_id:s provider:s days:n", f"""
SELECT id, organization_id, provider, max(days) AS days FROM (
  SELECT a.id, a.organization_id, a.provider, t.days FROM cloud_accounts a
  JOIN ({TASKS}) t ON t.route = 'sync_account' AND t.account_id = a.id
  UNION ALL
  SELECT a.id, a.organization_id, a.provider, t.days FROM cloud_accounts a
  JOIN ({TASKS}) t ON t.route = 'sync_all' AND t.organization_id = a.organization_id WHERE a.is_active) GROUP BY ALL""",
       "cloud_accounts")
def accounts_to_sync(spark, sf):
    return ingest.accounts_to_sync(ingest.sync_tasks(task_messages(spark, sf)), retail.cloud_accounts(spark, sf))


@query("organization_id:s action:s events:n first:t last:t", """
SELECT organization_id, action, count(*) AS events, min(created_at) AS first, max(created_at) AS last FROM audit_logs
GROUP BY ALL""", "audit_logs")
def audit_trail(spark, sf):
    """Written to the append-only log and read back."""
    path = scratch_path(spark, "audit")
    tables.write_audit(retail.audit_logs(spark, sf), path)
    return tables.read_audit(spark, path).groupBy("organization_id", "action").agg(
        F.count("*").alias("events"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))


def _hits(spark, sf):
    return retail.requests(spark, sf).select("key", "ts", "event_id")


#: Few enough hits over long enough that the sample events overrun it.
BURST = {"limit": 2, "seconds": 6 * 3600}


#: The log of accepted hits is carried along each key's hits.
_SLIDING = f"""
WITH RECURSIVE hits AS (
  SELECT CAST(user_id AS VARCHAR) AS key, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rk FROM events),
run AS (
  SELECT key, event_id, ts, rk, [ts] AS log, true AS accepted FROM hits WHERE rk = 1
  UNION ALL
  SELECT key, event_id, ts, rk, CASE WHEN len(live) < {BURST['limit']} THEN list_append(live, ts) ELSE live END,
    len(live) < {BURST['limit']}
  FROM (SELECT h.*, list_filter(r.log, lambda x: x >= h.ts - INTERVAL 6 HOUR) AS live
    FROM run r JOIN hits h ON h.key = r.key AND h.rk = r.rk + 1))"""


@query("event_id:n key:s accepted:b", _SLIDING + " SELECT event_id, key, accepted FROM run")
def burst_windows(spark, sf):
    return limits.burst_windows(_hits(spark, sf), **BURST)


@query("event_id:n key:s accepted:b", f"""
WITH RECURSIVE hits AS (
  SELECT CAST(user_id AS VARCHAR) AS key, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rk FROM events),
run AS (
  SELECT key, event_id, ts, rk, ts AS opened, 1 AS hits FROM hits WHERE rk = 1
  UNION ALL
  SELECT h.key, h.event_id, h.ts, h.rk, CASE WHEN h.ts >= r.opened + INTERVAL 6 HOUR THEN h.ts ELSE r.opened END,
    CASE WHEN h.ts >= r.opened + INTERVAL 6 HOUR THEN 1 ELSE r.hits + 1 END
  FROM run r JOIN hits h ON h.key = r.key AND h.rk = r.rk + 1)
SELECT event_id, key, hits <= {BURST['limit']} AS accepted FROM run""")
def burst_counter(spark, sf):
    return limits.burst_counter(_hits(spark, sf), **BURST)


@query("organization_id:s service:s ds:d amount:m records:n", """
SELECT organization_id, service, ds, sum(amount) AS amount, count(*) AS records FROM costs GROUP BY ALL""", "costs")
def stream_costs(spark, sf):
    records = retail.cost_records(spark, sf, stream_of(spark, sf, "lineitem"))
    totals = ingest.stream_costs(records, retail.cloud_accounts(spark, sf))
    return ingest.run_to_table(totals, ["organization_id", "service", "ds"])


@query("provider:s window_start:t window_end:t error_ratio:m firing:b", "SELECT * FROM error_windows", "error_windows")
def stream_error_ratio(spark, sf):
    requests = retail.requests(spark, sf, stream_of(spark, sf, "events"))
    return ingest.run_to_table(alerting.error_ratio(requests, ["provider"]), ["provider", "window_start", "window_end"])


@query("event_id:n key:s amount:m is_anomaly:b severity:s z_score:c", """
SELECT event_id, key, amount, abs(z) > 2.5 AS is_anomaly, round(z, 2) AS z_score,
  CASE WHEN abs(z) > 4 THEN 'critical' WHEN abs(z) > 3 THEN 'high' WHEN abs(z) > 2.5 THEN 'medium' END AS severity
FROM (SELECT e.event_id, CAST(e.user_id AS VARCHAR) AS key, e.value AS amount, CASE WHEN b.s > 0 THEN (e.value - b.m) / b.s ELSE 0 END AS z
  FROM events e JOIN (SELECT user_id, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY user_id) b
  ON b.user_id = e.user_id)""")
def stream_zscore(spark, sf):
    def amounts(requests):
        return requests.select("event_id", "key", F.col("seconds").alias("amount"))

    baseline = anomaly.baseline_stats(amounts(retail.requests(spark, sf)), ["key"], exact=False)
    arriving = amounts(retail.requests(spark, sf, stream_of(spark, sf, "events")))
    return ingest.run_to_table(ingest.stream_zscore(arriving, baseline, ["key"]), mode="append")


@query("key:s ts:t accepted:b", _SLIDING + " SELECT key, ts, accepted FROM run")
def stream_bursts(spark, sf):
    hits = closed(retail.requests(spark, sf, stream_of(spark, sf, "events")).select("key", "ts"), "ts")
    live = limits.stream_burst_windows(hits, slice_seconds=3600, **BURST)
    return ingest.run_to_table(live, mode="append").where("key is not null")


@query("key:s ts:t accepted:b", f"""
SELECT key, ts, accepted FROM (
WITH RECURSIVE hits AS (
  SELECT CAST(user_id AS VARCHAR) AS key, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rk FROM events),
run AS (
  SELECT key, ts, rk, ts AS opened, 1 AS hits FROM hits WHERE rk = 1
  UNION ALL
  SELECT h.key, h.ts, h.rk, CASE WHEN h.ts >= r.opened + INTERVAL 6 HOUR THEN h.ts ELSE r.opened END,
    CASE WHEN h.ts >= r.opened + INTERVAL 6 HOUR THEN 1 ELSE r.hits + 1 END
  FROM run r JOIN hits h ON h.key = r.key AND h.rk = r.rk + 1)
SELECT key, ts, hits <= {BURST['limit']} AS accepted FROM run)""")
def stream_burst_counter(spark, sf):
    hits = closed(retail.requests(spark, sf, stream_of(spark, sf, "events")).select("key", "ts"), "ts")
    live = limits.stream_burst_counter(hits, slice_seconds=3600, **BURST)
    return ingest.run_to_table(live, mode="append").where("key is not null")


@query("provider:s window_start:t window_end:t p95:m firing:b", """
SELECT provider, window_end - INTERVAL 10 MINUTE AS window_start, window_end, p95, p95 > 60 AS firing FROM (
  SELECT provider, window_end, list_sort(list(seconds))[CAST(greatest(1, ceil(0.95 * count(*))) AS BIGINT)] AS p95
  FROM (SELECT provider, seconds, date_trunc('minute', ts) + k * INTERVAL 1 MINUTE AS window_end
    FROM requests CROSS JOIN (SELECT unnest(range(1, 11)) AS k)) GROUP BY ALL)""", "requests")
def stream_latency_p95(spark, sf):
    """The sketch of a window with fewer values than its accuracy is exact: the value at the rank itself."""
    requests = retail.requests(spark, sf, stream_of(spark, sf, "events"))
    return ingest.run_to_table(alerting.latency_p95(requests, ["provider"]), ["provider", "window_start", "window_end"])
