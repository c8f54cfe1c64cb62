"""Cost breakdowns, listings and derived figures, for all tenants over the whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from costlake.functions import dates, tags, text
from costlake.operators import costs as c, whatif
from costlake.operators.joins import bucketed, densify, join_dimension
from costlake.plans.catalog import query
from costlake.session import scratch_path
from costlake.sources import retail
from costlake.sources.retail import ALL_DAYS, AS_OF

ORG = ["organization_id"]


def scoped(spark, sf, **filters):
    """All charges with their account, for every tenant."""
    return c.cost_filters(
        retail.cost_records(spark, sf), retail.cloud_accounts(spark, sf), None, **filters
    )


@query("organization_id:s ds:d amount:m change_percent:m predicted:b", """
SELECT organization_id, ds, amount, CASE WHEN prev > 0 THEN
  (CAST(amount AS DOUBLE) - CAST(prev AS DOUBLE)) / CAST(prev AS DOUBLE) * 100 END AS change_percent,
  false AS predicted
FROM (SELECT *, lag(amount) OVER (PARTITION BY organization_id ORDER BY ds) AS prev FROM org_days)""",
       "org_days")
def cost_trend(spark, sf):
    return c.cost_trend(scoped(spark, sf), AS_OF, ALL_DAYS, ORG)


@query("organization_id:s total_cost:m",
       "SELECT organization_id, sum(amount) AS total_cost FROM costs GROUP BY ALL", "costs")
def total_cost(spark, sf):
    return c.total_cost(scoped(spark, sf), ORG)


@query("organization_id:s service:s total_cost:m", """
SELECT organization_id, service, sum(amount) AS total_cost FROM costs WHERE service <> '' GROUP BY ALL""",
       "costs")
def cost_by_service(spark, sf):
    return c.cost_by_service(scoped(spark, sf), ORG)


@query("organization_id:s region:s total_cost:m", """
SELECT organization_id, region, sum(amount) AS total_cost FROM costs WHERE region IS NOT NULL GROUP BY ALL""",
       "costs")
def cost_by_region(spark, sf):
    return c.cost_by_region(scoped(spark, sf), ORG)


@query("organization_id:s ds:d amount:m", "SELECT * FROM org_days", "org_days")
def cost_by_day(spark, sf):
    return c.cost_by_day(scoped(spark, sf), AS_OF, ALL_DAYS, ORG)


@query("service:s total_cost:m record_count:n", """
SELECT service, sum(amount) AS total_cost, count(*) AS record_count FROM costs GROUP BY service
ORDER BY total_cost DESC, service LIMIT 10""", "costs")
def top_services(spark, sf):
    return c.top_services(scoped(spark, sf), 10)


@query("organization_id:s section:s item:s amount:m currency:s period_start:t period_end:t", """
SELECT *, 'USD' AS currency, TIMESTAMP '1995-01-01 00:00:00' AS period_start,
  TIMESTAMP '2001-12-31 23:59:59' AS period_end
FROM (SELECT organization_id, 'total' AS section, NULL AS item, sum(amount) AS amount FROM costs GROUP BY ALL
  UNION ALL SELECT organization_id, 'service', service, sum(amount) FROM costs WHERE service <> '' GROUP BY ALL
  UNION ALL SELECT organization_id, 'region', region, sum(amount) FROM costs WHERE region IS NOT NULL GROUP BY ALL
  UNION ALL SELECT organization_id, 'day', CAST(ds AS VARCHAR), amount FROM org_days)""", "costs org_days")
def cost_summary(spark, sf):
    return c.cost_summary(scoped(spark, sf), AS_OF, ALL_DAYS, ORG)


@query("date:t cloud_account_id:s resource_id:s service:s region:s amount:m granularity:s", """
SELECT * FROM costs
ORDER BY date DESC, cloud_account_id, resource_id, service, region NULLS FIRST, amount, granularity
LIMIT 100 OFFSET 200""", "costs")
def list_records(spark, sf):
    return c.list_records(scoped(spark, sf), 3, 100)


@query("organization_id:s total:n total_pages:n", """
SELECT organization_id, count(*) AS total, (count(*) + 49) // 50 AS total_pages FROM costs GROUP BY ALL""",
       "costs")
def page_info(spark, sf):
    return c.page_info(scoped(spark, sf), 50, ORG)


@query("provider:s environment:s business_unit:s records:n amount:m", """
SELECT provider, environment, business_unit, count(*) AS records, sum(amount) AS amount FROM costs
WHERE provider = 'aws' AND environment = 'prod' AND region = 'AF' GROUP BY ALL""", "costs")
def cost_filters(spark, sf):
    kept = scoped(spark, sf, provider="aws", environment="prod", region="AF")
    return kept.groupBy("provider", "environment", "business_unit").agg(
        F.count("*").alias("records"), F.sum("amount").alias("amount"))


@query("organization_id:s service:s records:n amount:m", """
SELECT organization_id, service, count(*) AS records, sum(amount) AS amount FROM costs
WHERE provider = 'gcp' AND service = 'Amazon RDS' GROUP BY ALL""", "costs")
def context_filters(spark, sf):
    keys = {"provider": "GCP", "service": "Amazon RDS", "region": "All", "environment": None}
    kept = c.context_filters(retail.cost_records(spark, sf), retail.cloud_accounts(spark, sf), None, keys)
    return kept.groupBy("organization_id", "service").agg(
        F.count("*").alias("records"), F.sum("amount").alias("amount"))


@query("granularity:s records:n amount:m", """
SELECT granularity, count(*) AS records, sum(amount) AS amount FROM costs
WHERE date >= TIMESTAMP '1998-01-01 00:00:00' GROUP BY ALL""", "costs")
def records_filter(spark, sf):
    kept = c.records_filter(retail.cost_records(spark, sf), retail.cloud_accounts(spark, sf), None,
                            start_date=AS_OF.replace(1998, 1, 1, 0, 0, 0))
    return kept.groupBy("granularity").agg(F.count("*").alias("records"), F.sum("amount").alias("amount"))


@query("first_day:d last_day:d records:n amount:m", """
SELECT min(date) AS first_day, max(date) AS last_day, count(*) AS records, sum(amount) AS amount
FROM cost_records WHERE date BETWEEN TIMESTAMP '2000-12-02 00:00:00' AND TIMESTAMP '2000-12-31 23:59:59'""",
       "cost_records")
def resolve_window(spark, sf):
    start, end = dates.resolve_window(AS_OF.replace(2000), 30)
    kept = dates.in_window(retail.cost_records(spark, sf), start, end)
    return kept.agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"),
                    F.count("*").alias("records"), F.sum("amount").alias("amount"))


@query("cloud_account_id:s organization_id:s records:n amount:m", """
SELECT cloud_account_id, organization_id, count(*) AS records, sum(amount) AS amount FROM costs GROUP BY ALL""",
       "costs")
def costs_with_accounts(spark, sf):
    return scoped(spark, sf).groupBy("cloud_account_id", "organization_id").agg(
        F.count("*").alias("records"), F.sum("amount").alias("amount"))


@query("cloud_account_id:s organization_id:s records:n amount:m", """
SELECT cloud_account_id, organization_id, count(*) AS records, sum(amount) AS amount FROM costs GROUP BY ALL""",
       "costs")
def costs_with_accounts_bucketed(spark, sf):
    """Both tables in buckets of the account: neither the join nor the totals move the charges."""
    tag = uuid.uuid4().hex
    fact = bucketed(retail.cost_records(spark, sf), f"charges_{tag}", scratch_path(spark, "charges"), "cloud_account_id")
    side = retail.cloud_accounts(spark, sf).withColumnRenamed("id", "cloud_account_id").select(
        "cloud_account_id", "organization_id")
    side = bucketed(side, f"accounts_{tag}", scratch_path(spark, "accounts"), "cloud_account_id")
    return join_dimension(fact, side, "cloud_account_id").groupBy("cloud_account_id", "organization_id").agg(
        F.count("*").alias("records"), F.sum("amount").alias("amount"))


@query("ds:d amount:m", """
SELECT c.ds, coalesce(sum(r.amount), 0) AS amount FROM calendar c LEFT JOIN cost_records r ON r.ds = c.ds
GROUP BY ALL""", "calendar cost_records")
def calendar_join(spark, sf):
    daily = c.daily_totals(retail.cost_records(spark, sf))
    return densify(daily, "1995-01-01", "2001-12-31")


@query("date:s provider:s account_name:s account_id:s business_unit:s environment:s cost_center:s "
       "service:s region:s amount:s currency:s", """
SELECT strftime(date, '%Y-%m-%dT%H:%M:%SZ') AS date, provider, account_name, account_id, business_unit,
  coalesce(environment, '') AS environment, cost_center, service, coalesce(region, '') AS region,
  CAST(amount AS VARCHAR) AS amount, currency FROM costs""", "costs")
def export_costs(spark, sf):
    return c.export_costs(scoped(spark, sf))


@query("cloud_account_id:s imported_total:c provider_total:c variance_amount:c variance_percent:c status:s", """
SELECT *, CASE WHEN abs(variance_amount) <= greatest(1.0, provider_total * 0.01) THEN 'matched' ELSE 'drift' END AS status
FROM (SELECT *, CASE WHEN provider_total > 0 THEN round_even(variance_amount / provider_total * 100, 2) ELSE 0 END
        AS variance_percent
  FROM (SELECT cloud_account_id, round(CAST(sum(amount) AS DOUBLE), 2) AS imported_total,
      round(CAST(coalesce(sum(amount) FILTER (WHERE granularity = 'daily' OR cloud_account_id[-1] IN ('1', '2')), 0) AS DOUBLE), 2)
        AS provider_total,
      round(CAST(sum(amount) - coalesce(sum(amount) FILTER (WHERE granularity = 'daily' OR cloud_account_id[-1] IN ('1', '2')), 0) AS DOUBLE), 2)
        AS variance_amount
    FROM cost_records GROUP BY ALL))""", "cost_records")
def reconcile(spark, sf):
    """The provider side knows no monthly rows, except for accounts ending in 1 or 2."""
    records = retail.cost_records(spark, sf)
    billed = records.filter((F.col("granularity") == "daily")
                            | F.right("cloud_account_id", F.lit(1)).isin("1", "2"))
    return c.reconcile(records, billed, AS_OF, ALL_DAYS)


@query("account_id:s is_active:b total_records:n coverage_start:d coverage_end:d services_detected:n currency:s", """
SELECT a.id AS account_id, a.is_active, count(r.date) AS total_records, min(r.date) AS coverage_start,
  max(r.date) AS coverage_end, count(DISTINCT r.service) AS services_detected, min(r.currency) AS currency
FROM cloud_accounts a LEFT JOIN cost_records r ON r.cloud_account_id = a.id GROUP BY ALL""",
       "cloud_accounts cost_records")
def account_coverage(spark, sf):
    return c.account_coverage(retail.cost_records(spark, sf), retail.cloud_accounts(spark, sf))


@query("organization_id:s period:s provider_scope:s account_scope:s account_name:s service_scope:s "
       "total_cost:c records_found:n services:s days:s no_records:b", """
SELECT o.organization_id, 'Last 2557 Days' AS period, 'AWS' AS provider_scope, 'all' AS account_scope,
  'All Accounts' AS account_name, 'all' AS service_scope, coalesce(t.total_cost, 0) AS total_cost,
  coalesce(t.records_found, 0) AS records_found, s.services, d.days, t.records_found IS NULL AS no_records
FROM (SELECT DISTINCT organization_id FROM cloud_accounts) o
LEFT JOIN (SELECT organization_id, sum(amount) AS total_cost, count(*) AS records_found FROM costs
      WHERE provider = 'aws' GROUP BY ALL) t USING (organization_id)
LEFT JOIN (SELECT organization_id, string_agg(service || '=' || printf('%.2f', CAST(amount AS DOUBLE)), ';' ORDER BY rk) AS services
      FROM (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY amount DESC, service) AS rk
            FROM (SELECT organization_id, service, sum(amount) AS amount FROM costs WHERE provider = 'aws' GROUP BY ALL))
      WHERE rk <= 5 AND service <> '' GROUP BY ALL) s USING (organization_id)
LEFT JOIN (SELECT organization_id, string_agg(CAST(ds AS VARCHAR) || '=' || printf('%.2f', CAST(amount AS DOUBLE)), ';' ORDER BY ds) AS days
      FROM (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY ds DESC) AS rk
            FROM (SELECT organization_id, ds, sum(amount) AS amount FROM costs WHERE provider = 'aws' GROUP BY ALL))
      WHERE rk <= 7 GROUP BY ALL) d USING (organization_id)""", "cloud_accounts costs")
def context_summary(spark, sf):
    found = c.context_summary(retail.cost_records(spark, sf), retail.cloud_accounts(spark, sf), None,
                              {"provider": "aws", "account_id": None}, AS_OF, ALL_DAYS)

    def joined(column, key):
        return F.array_join(F.transform(column, lambda e: F.concat(
            e[key].cast("string"), F.lit("="), F.format_string("%.2f", e["amount"]))), ";")

    return found.withColumns({"services": joined("top_services", "service"),
                              "days": joined("daily_trend", "ds")})


@query("service:s total_cost:m share:m", """
SELECT *, CASE WHEN whole > 0 THEN round(total_cost / whole * 100, 1) ELSE 0 END AS share
FROM (SELECT service, CAST(sum(amount) AS DOUBLE) AS total_cost, CAST(sum(sum(amount)) OVER () AS DOUBLE) AS whole
      FROM costs WHERE service <> '' GROUP BY service)""", "costs")
def share_of_total(spark, sf):
    return c.share_of_total(c.cost_by_service(scoped(spark, sf)))


@query("organization_id:s total_cost:m avg_daily:m", """
SELECT organization_id, sum(amount) AS total_cost, CAST(sum(amount) AS DOUBLE) / 2557 AS avg_daily
FROM costs GROUP BY ALL""", "costs")
def avg_daily(spark, sf):
    return c.avg_daily(scoped(spark, sf), ALL_DAYS, ORG)


@query("organization_id:s service:s change_percent:m", """
SELECT organization_id, service, CASE WHEN max(prev) > 0 THEN (max(last) - max(prev)) / max(prev) * 100 ELSE 0 END AS change_percent
FROM (SELECT organization_id, service, CASE WHEN rk = 1 THEN amount END AS last, CASE WHEN rk = 2 THEN amount END AS prev
  FROM (SELECT *, row_number() OVER (PARTITION BY organization_id, service ORDER BY ds DESC) AS rk FROM service_daily)
  WHERE rk <= 2) GROUP BY ALL""", "service_daily")
def latest_change(spark, sf):
    keys = [*ORG, "service"]
    return c.latest_change(c.daily_totals(scoped(spark, sf), keys), keys)


@query("organization_id:s ds:d amount:m", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY ds DESC) AS rk FROM org_daily)
WHERE rk <= 6""", "org_daily")
def tail_days(spark, sf):
    return c.tail_days(c.daily_totals(scoped(spark, sf), ORG), 6, ORG)


@query("organization_id:s service:s total_cost:m", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY total_cost DESC, service) AS rk
  FROM (SELECT organization_id, service, sum(amount) AS total_cost FROM costs WHERE service <> '' GROUP BY ALL))
WHERE rk <= 7""", "costs")
def head_services(spark, sf):
    return c.head_n(c.cost_by_service(scoped(spark, sf), ORG), 7, ORG)


@query("organization_id:s service:s current_cost:m previous_cost:m growth_percent:m", """
SELECT *, CASE WHEN previous_cost > 0 THEN (current_cost - previous_cost) / previous_cost * 100 END AS growth_percent
FROM (SELECT organization_id, service,
    CAST(coalesce(sum(amount) FILTER (WHERE ds >= DATE '1999-01-01'), 0) AS DOUBLE) AS current_cost,
    CAST(coalesce(sum(amount) FILTER (WHERE ds < DATE '1999-01-01'), 0) AS DOUBLE) AS previous_cost
  FROM costs WHERE ds >= DATE '1996-01-01' GROUP BY ALL)""", "costs")
def growth_by_service(spark, sf):
    return c.growth_by_service(scoped(spark, sf), AS_OF, 1096, ORG)


# ---- what-if ---------------------------------------------------------------------------------


@query("organization_id:s ds:d amount:m simulated:m", """
SELECT organization_id, ds, CAST(amount AS DOUBLE) AS amount, greatest(0, CAST(amount AS DOUBLE)
  - CAST(amount AS DOUBLE) * (0.4 * 0.5 * 0.6 + 0.8 * 0.3 * 0.3 + 0.1)) AS simulated FROM org_daily""",
       "org_daily")
def what_if(spark, sf):
    return whatif.what_if(c.daily_totals(scoped(spark, sf), ORG), spot=50, reserved=30, usage=10)


@query("name:s amount:m simulated:m saving:m", """
SELECT name, sum(amount) AS amount, sum(simulated) AS simulated, sum(amount) - sum(simulated) AS saving
FROM (SELECT name, a.amount, greatest(0, a.amount - a.amount * (0.4 * spot / 100 * 0.6 + 0.8 * reserved / 100 * 0.3 + usage / 100)) AS simulated
  FROM (SELECT CAST(sum(amount) AS DOUBLE) AS amount FROM costs GROUP BY organization_id, service, ds) a
  CROSS JOIN (VALUES ('none', 0.0, 0.0, 0.0), ('spot', 60.0, 0.0, 0.0), ('mixed', 40.0, 50.0, 10.0),
    ('beyond', 100.0, 100.0, 100.0)) AS s(name, spot, reserved, usage)) GROUP BY name""", "costs")
def what_if_grid(spark, sf):
    rows = [("none", 0.0, 0.0, 0.0), ("spot", 60.0, 0.0, 0.0), ("mixed", 40.0, 50.0, 10.0),
            ("beyond", 100.0, 100.0, 100.0)]
    scenarios = spark.createDataFrame(rows, "name string, spot double, reserved double, usage double")
    return whatif.what_if_grid(c.daily_totals(scoped(spark, sf), [*ORG, "service"]), scenarios)


# ---- scalar functions over columns -----------------------------------------------------------


@query("token:s days:n users:n", """
SELECT token, CASE token WHEN 'last_7_days' THEN 7 WHEN 'last_30_days' THEN 30 WHEN 'last_90_days' THEN 90 ELSE 30 END AS days,
  count(*) AS users
FROM (SELECT CASE user_id % 4 WHEN 0 THEN 'last_7_days' WHEN 1 THEN 'last_30_days' WHEN 2 THEN 'last_90_days'
  ELSE 'ever' END AS token FROM events) GROUP BY token""")
def time_range(spark, sf):
    token = retail.pick(("last_7_days", "last_30_days", "last_90_days", "ever"), F.col("user_id"))
    events = retail.table(spark, sf, "events").select(token.alias("token"))
    return events.groupBy("token", dates.time_range_days("token").alias("days")).agg(F.count("*").alias("users"))


@query("resource_id:s masked:s", """
SELECT resource_id, CASE WHEN resource_id IS NULL OR resource_id = '' THEN 'all' WHEN length(resource_id) <= 6 THEN '***'
  ELSE resource_id[1:2] || '***' || resource_id[-4:] END AS masked FROM cost_records""", "cost_records")
def mask_identifier(spark, sf):
    return retail.cost_records(spark, sf).select(
        "resource_id", text.mask_identifier("resource_id").alias("masked"))


@query("service:s bucket:s slug:s short_name:s records:n", """
SELECT service, CASE WHEN contains(l, 'lambda') OR contains(l, 'function') THEN 'serverless'
    WHEN contains(l, 'sql') OR contains(l, 'rds') OR contains(l, 'database') THEN 'database'
    WHEN contains(l, 'storage') OR contains(l, 's3') OR contains(l, 'blob') THEN 'storage'
    WHEN contains(l, 'cdn') OR contains(l, 'cloudfront') THEN 'delivery' ELSE 'compute' END AS bucket,
  trim(regexp_replace(l, '[^a-z0-9]+', '-', 'g'), '-') AS slug,
  array_to_string(string_split(service, ' ')[1:2], ' ') AS short_name, count(*) AS records
FROM (SELECT service, lower(service) AS l FROM cost_records) GROUP BY ALL""", "cost_records")
def service_names(spark, sf):
    return retail.cost_records(spark, sf).groupBy("service").agg(F.count("*").alias("records")).select(
        "service", text.service_bucket("service").alias("bucket"),
        text.service_slug("service").alias("slug"),
        text.short_service_name("service").alias("short_name"), "records")


@query("step:s hours:m parts:n", """
SELECT step, CASE WHEN unit = 'h' THEN CAST(p_size AS DOUBLE) WHEN unit = 'd' THEN p_size * 24.0 ELSE 24.0 END AS hours,
  count(*) AS parts
FROM (SELECT p_size, unit, CAST(p_size AS VARCHAR) || unit AS step FROM (
  SELECT p_size, CASE p_partkey % 3 WHEN 0 THEN 'h' WHEN 1 THEN 'd' ELSE 'w' END AS unit FROM part)) GROUP BY ALL""")
def window_hours(spark, sf):
    unit = retail.pick(("h", "d", "w"), F.col("p_partkey"))
    steps = retail.table(spark, sf, "part").select(F.concat(F.col("p_size").cast("string"), unit).alias("step"))
    return steps.groupBy("step", dates.window_to_hours("step").alias("hours")).agg(F.count("*").alias("parts"))


@query("resource_id:s environment:s owner:s workload:s cost_center:s", """
SELECT resource_id, 'demo' AS environment, CASE WHEN untagged OR ownerless THEN 'platform' ELSE tag_owner END AS owner,
  CASE WHEN untagged THEN cloud_account_id ELSE tag_workload END AS workload, 'shared' AS cost_center
FROM cost_records""", "cost_records")
def default_tags(spark, sf):
    filled = tags.default_tags("tags", {
        "environment": "demo", "owner": "platform", "cost_center": "shared",
        "workload": F.col("cloud_account_id")})
    rows = retail.cost_records(spark, sf).select("resource_id", filled.alias("t"))
    return rows.select("resource_id", *[F.col("t")[k].alias(k) for k in
                                        ("environment", "owner", "workload", "cost_center")])


@query("organization_id:s tag_gap:s records:n amount:m", """
SELECT organization_id, CASE WHEN untagged THEN 'untagged' WHEN ownerless THEN 'missing_owner' ELSE 'none' END AS tag_gap,
  count(*) AS records, sum(amount) AS amount FROM costs GROUP BY ALL""", "costs")
def tag_gap(spark, sf):
    return tags.tag_gap_report(scoped(spark, sf), ORG)


@query("value:s", "SELECT DISTINCT trim(service) AS value FROM cost_records WHERE trim(service) <> ''",
       "cost_records")
def facet_values(spark, sf):
    return text.facet_values(retail.cost_records(spark, sf), "service")


@query("amount_text:s percent_text:s rows:n", """
SELECT CASE WHEN amount < 0 THEN '-$' ELSE '$' END || format('{:,.2f}', abs(amount)) AS amount_text,
  printf('%+.2f%%', percent) AS percent_text, count(*) AS rows
FROM (SELECT CASE WHEN l_linenumber = 7 THEN -l_quantity ELSE l_extendedprice END AS amount,
  (l_discount - l_tax) * 100.0 AS percent FROM lineitem) GROUP BY ALL""")
def format_money(spark, sf):
    lines = retail.table(spark, sf, "lineitem")
    amount = F.when(F.col("l_linenumber") == 7, -F.col("l_quantity")).otherwise(F.col("l_extendedprice"))
    return lines.groupBy(
        text.format_currency(amount).alias("amount_text"),
        text.format_percent((F.col("l_discount") - F.col("l_tax")) * 100.0).alias("percent_text"),
    ).agg(F.count("*").alias("rows"))


@query("severity:s color:s events:n", """
SELECT severity, CASE severity WHEN 'critical' THEN '#e74c3c' WHEN 'high' THEN '#e67e22' WHEN 'medium' THEN '#f1c40f'
  WHEN 'low' THEN '#3498db' WHEN 'info' THEN '#2ecc71' ELSE '#95a5a6' END AS color, count(*) AS events
FROM (SELECT CASE user_id % 6 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low'
  WHEN 4 THEN 'info' ELSE 'other' END AS severity FROM events) GROUP BY ALL""")
def severity_color(spark, sf):
    names = ("critical", "high", "medium", "low", "info", "other")
    events = retail.table(spark, sf, "events").select(retail.pick(names, F.col("user_id")).alias("severity"))
    return events.groupBy("severity", text.severity_color("severity").alias("color")).agg(
        F.count("*").alias("events"))


def _redaction(column: str) -> str:
    for pattern in text.CREDENTIAL_PATTERNS:
        column = f"regexp_replace({column}, '{pattern.replace('(?iu)', '(?i)')}', '{text.REDACTED}', 'g')"
    return column


@query("doc_id:n redacted:s", f"""
SELECT doc_id, CASE WHEN length(t) > 500 THEN substring(t, 1, 500) || '…' ELSE t END AS redacted
FROM (SELECT doc_id, {_redaction("text")} AS t FROM documents)""")
def redact_text(spark, sf):
    documents = retail.spread(retail.table(spark, sf, "documents"), "doc_id")
    return documents.select(
        "doc_id", text.redact_text("text").alias("redacted"))
