import datetime as dt
from decimal import Decimal

import pytest
from conftest import NOW
from pyspark.sql import functions as F

from costlake.functions.dates import resolve_window
from costlake.operators import costs as c, logs, sync
from costlake.sources import tables


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_window_bounds():
    start, end = resolve_window(NOW, 7)
    assert (start, end) == (dt.datetime(2026, 3, 9), NOW)
    assert resolve_window(NOW, 1)[0] == dt.datetime(2026, 3, 15)


def test_total_and_tenant_scope(records, accounts):
    scoped = c.cost_filters(records, accounts, "org", *resolve_window(NOW, 30), business_unit="platform")
    assert rows(c.total_cost(scoped)) == [(Decimal("225.00000000"),)]
    assert scoped.count() == 3
    assert c.cost_filters(records, accounts, "org").count() == 4
    assert c.cost_filters(records, accounts, None).count() == 5


def test_total_of_nothing_is_zero(records, accounts):
    none = c.cost_filters(records, accounts, "org", service="nothing")
    assert rows(c.total_cost(none)) == [(Decimal(0),)]


def test_unknown_filter_is_refused(records, accounts):
    with pytest.raises(ValueError):
        c.cost_filters(records, accounts, "org", colour="red")


def test_context_filters_ignore_all(records, accounts):
    keys = {"provider": "AWS", "service": "ALL", "region": "", "environment": None}
    assert c.context_filters(records, accounts, "org", keys).count() == 3


def test_open_ended_dates(records, accounts):
    assert c.records_filter(records, accounts, "org", start_date=NOW - dt.timedelta(days=1)).count() == 3
    assert c.records_filter(records, accounts, "org", end_date=NOW - dt.timedelta(days=2)).count() == 1


def test_sparse_trend(make_costs, accounts):
    costs = c.with_accounts(make_costs(("a1", 2, "EC2", "r", "40.00"), ("a1", 0, "EC2", "r", "60.00")), accounts)
    trend = rows(c.cost_trend(costs, NOW, 7).orderBy("ds"))
    assert [float(r[1]) for r in trend] == [0, 0, 0, 0, 40, 0, 60]
    # null on the first day, after zero days, and -100 after the 40
    assert [r[2] for r in trend] == [None, None, None, None, None, -100.0, None]
    with pytest.raises(ValueError):
        c.cost_trend(costs, NOW, 6)


def test_dense_days_per_key(records, accounts):
    costs = c.cost_filters(records, accounts, None)
    daily = c.cost_by_day(costs, NOW, 10, ["organization_id"])
    assert daily.groupBy("organization_id").count().filter("count != 10").count() == 0
    assert rows(daily.agg(F.sum("amount"))) == [(Decimal("1229.00000000"),)]


def test_summary_matches_the_single_queries(records, accounts):
    costs = c.cost_filters(records, accounts, "org")
    summary = c.cost_summary(costs, NOW, 30)
    found = {(r.section, r.item): r.amount for r in summary.collect()}
    assert found[("total", None)] == Decimal(1224)
    assert found[("service", "Amazon EC2")] == 175 and found[("region", "us-east-1")] == 175
    assert sum(1 for s, _ in found if s == "day") == 30
    assert ("region", None) not in found
    empty = c.cost_summary(costs.filter("false"), NOW, 7).collect()
    assert sorted({r.section for r in empty}) == ["day", "total"] and len(empty) == 8


def test_breakdowns_and_top(records, accounts):
    costs = c.cost_filters(records, accounts, "org")
    assert rows(c.cost_by_service(costs))[0] == ("Compute", Decimal(999))
    assert [r[0] for r in rows(c.cost_by_region(costs))] == ["us-east-1", "us-west-2"]
    assert rows(c.top_services(costs, 2)) == [("Compute", Decimal(999), 1), ("Amazon EC2", Decimal(175), 2)]
    shares = {r[0]: r[-1] for r in rows(c.share_of_total(c.cost_by_service(costs)))}
    assert shares == {"Compute": 81.6, "Amazon EC2": 14.3, "Amazon S3": 4.1}
    with pytest.raises(ValueError):
        c.top_services(costs, 51)


def test_pages_cover_everything_once(records, accounts):
    costs = c.cost_filters(records, accounts, None)
    pages = [rows(c.list_records(costs, p, 2).select("id")) for p in (1, 2, 3)]
    flat = [r[0] for page in pages for r in page]
    assert len(flat) == 5 and len(set(flat)) == 5
    assert rows(c.page_info(costs, 2)) == [(5, 3)]


def test_latest_change(spark):
    series = spark.sql("SELECT * FROM VALUES (DATE'2026-01-01', 50.0), (DATE'2026-01-02', 75.0) AS t(ds, amount)")
    assert rows(c.latest_change(series)) == [(50.0,)]
    zero = spark.sql("SELECT * FROM VALUES (DATE'2026-01-01', 0.0), (DATE'2026-01-02', 75.0) AS t(ds, amount)")
    assert rows(c.latest_change(zero)) == [(0.0,)]


def test_reconciliation(records, make_costs):
    provider = make_costs(("a1", 2, "x", None, "100"), ("a1", 1, "x", None, "50"), ("a1", 0, "x", None, "75"),
                          ("a2", 1, "x", None, "900"))
    found = {r.cloud_account_id: r for r in c.reconcile(records, provider, NOW, 30).collect()}
    assert found["a1"].status == "matched" and found["a1"].imported_total == Decimal("225.00")
    assert found["a2"].status == "drift" and found["a2"].variance_percent == Decimal("11.00")
    # nothing billed: percent is 0 and the tolerance is one unit
    assert found["a3"].variance_percent == 0 and found["a3"].status == "drift"


def test_reconciliation_rounds_half_even(make_costs):
    imported = make_costs(("a1", 0, "x", None, "0.125"))
    provider = make_costs(("a1", 0, "x", None, "0.135"))
    row = c.reconcile(imported, provider).first()
    assert (row.imported_total, row.provider_total) == (Decimal("0.12"), Decimal("0.14"))


def test_coverage(records, accounts):
    found = {r.account_id: r for r in c.account_coverage(records.filter("cloud_account_id != 'a2'"), accounts).collect()}
    assert (found["a1"].total_records, found["a1"].services_detected) == (3, 2)
    assert found["a2"].total_records == 0 and found["a2"].coverage_start is None


def test_context_summary(records, accounts):
    row = c.context_summary(records, accounts, "org", {"account_id": "a1", "provider": None}, NOW).first()
    assert row.account_name == "Test AWS Account" and row.account_scope == "***"
    assert row.total_cost == 225.0 and row.records_found == 3 and not row.no_records
    assert [s.service for s in row.top_services] == ["Amazon EC2", "Amazon S3"]
    assert [d.amount for d in row.daily_trend] == [100.0, 50.0, 75.0]
    nothing = c.context_summary(records, accounts, "org", {"service": "none"}, NOW).first()
    assert nothing.no_records and nothing.total_cost == 0


def test_growth(make_costs, accounts):
    costs = make_costs(("a1", 0, "up", None, "30"), ("a1", 7, "up", None, "10"), ("a1", 8, "gone", None, "10"),
                       ("a1", 1, "new", None, "1"))
    found = {r.service: r.growth_percent for r in c.growth_by_service(costs, NOW, 7).collect()}
    assert found == {"up": 200.0, "gone": -100.0, "new": None}


def test_export(records, accounts, tmp_path):
    out = c.export_costs(c.cost_filters(records, accounts, "org"))
    assert tuple(out.columns) == c.EXPORT_COLUMNS
    first = rows(out)[0]
    assert first == ("2026-03-15T18:30:00Z", "aws", "Test AWS Account", "123456789012", "platform", "prod", "",
                     "Amazon EC2", "us-east-1", "75.00000000", "USD")
    path = str(tmp_path / "csv")
    tables.write_csv(out.coalesce(1), path)
    lines = [l for p in (tmp_path / "csv").glob("*.csv") for l in p.read_text().splitlines()]
    assert lines[0].startswith("date,provider,account_name") and len(lines) == 5
    assert ",,Amazon EC2" in lines[1]


def test_replace_window_keeps_the_rest(make_costs):
    existing = make_costs(
        ("a1", 1, "old", None, "1"), ("a1", 1, "monthly", None, "2", "monthly"), ("a1", 40, "early", None, "3"),
        ("a2", 1, "other", None, "4"))
    incoming = make_costs(("ignored", 1, "new", None, "9")).select("date", "service", "amount", "currency")
    start, end = resolve_window(NOW, 30)
    after = sync.replace_window(existing, incoming, "a1", start, end)
    assert sorted(r.service for r in after.collect()) == ["early", "monthly", "new", "other"]
    new = after.filter("service = 'new'").first()
    assert (new.cloud_account_id, new.granularity) == ("a1", "daily")
    same = sync.replace_window(existing, incoming.filter("false"), "a1", start, end)
    assert sorted(r.service for r in same.collect()) == ["early", "monthly", "old", "other"]
    many = sync.replace_windows(existing, make_costs(("a1", 1, "new", None, "9")), start, end)
    assert sorted(r.service for r in many.collect()) == ["early", "monthly", "new", "other"]


def test_replace_windows_works_a_pull_out_once(spark, make_costs):
    start, end = resolve_window(NOW, 30)
    seen = spark.sparkContext.accumulator(0)

    def noted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    pulled = make_costs(("a1", 1, "new", None, "9"), ("a1", 2, "new", None, "8")).select(
        "cloud_account_id", "date", "service", "amount", "currency")
    pulled = pulled.mapInPandas(noted, pulled.schema)
    after = sync.replace_windows(make_costs(("a1", 1, "old", None, "1"), ("a2", 1, "kept", None, "1")), pulled, start, end)
    assert sorted(r.service for r in after.collect()) == ["kept", "new", "new"]
    assert seen.value == 2


def test_import_window_rewrites_only_its_days(spark, make_costs, tmp_path):
    path = str(tmp_path / "costs")
    tables.write_costs(make_costs(
        ("a1", 1, "stale", None, "1"), ("a1", 3, "vanishes", None, "1"), ("a2", 1, "stays", None, "2"),
        ("a1", 50, "early", None, "3")), path)
    untouched = sorted(p.name for p in (tmp_path / "costs").glob("usage_date=2026-01-24/*.parquet"))
    incoming = make_costs(("a1", 1, "fresh", None, "7")).select("date", "service", "amount", "currency")
    start, end = resolve_window(NOW, 7)
    assert sync.import_window(spark, path, incoming, "a1", start, end) == 1
    left = tables.read_costs(spark, path)
    assert sorted(r.service for r in left.collect()) == ["early", "fresh", "stays"]
    assert sorted(p.name for p in (tmp_path / "costs").glob("usage_date=2026-01-24/*.parquet")) == untouched
    assert sync.import_window(spark, path, incoming.filter("false"), "a1", start, end) == 0
    assert tables.read_costs(spark, path).count() == 3
    pruned = c.total_cost(c.in_window(left, start, end))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(usage_date" in pruned and "PushedFilters: [IsNotNull(date)" in pruned


def test_sync_state(spark, accounts):
    at = dt.datetime(2026, 1, 1)
    results = spark.createDataFrame(
        [("a1", at, "error", None, "boom"), ("a1", at + dt.timedelta(hours=1), "ready", 7, None),
         ("a2", at, "error", 3, "boom")],
        "cloud_account_id string, finished_at timestamp, status string, records_imported long, error string")
    found = {r.account_id: r for r in sync.sync_telemetry(accounts, results).collect()}
    assert (found["a1"].last_sync_status, found["a1"].last_sync_records_imported) == ("ready", 7)
    assert (found["a2"].last_sync_error, found["a2"].last_sync_records_imported) == ("boom", 0)
    assert found["a3"].last_sync_status == "never_synced"
    assert [r.id for r in sync.select_sync_accounts(accounts, "org").orderBy("id").collect()] == ["a1", "a2"]


def test_account_listing(spark, accounts):
    assert logs.list_accounts(accounts, "org", provider="gcp").first().id == "a2"
    assert rows(logs.account_pages(accounts, "org", page_size=1)) == [(2, 2)]
    assert logs.duplicate_accounts(accounts.union(accounts.filter("id = 'a1'"))).first().copies == 2


def test_conversations(spark):
    at = dt.datetime(2026, 1, 1)
    messages = spark.createDataFrame(
        [("c1", "u", "user" if i % 2 == 0 else "assistant", f"m{i:02d}", at + dt.timedelta(minutes=i)) for i in range(30)]
        + [("c2", "u", "user", "zz first", at), ("c2", "u", "user", "aa later", at + dt.timedelta(days=1)),
           ("c2", "v", "user", "not mine", at)],
        "conversation_id string, user_id string, role string, content string, created_at timestamp")
    history = [r.content for r in logs.conversation_history(messages, "c1", "u").collect()]
    assert history == [f"m{i:02d}" for i in range(10, 30)]
    listed = logs.conversation_list(messages, "u").collect()
    # the preview is the alphabetically first message, and the latest conversation leads
    assert [(r.conversation_id, r.message_count, r.preview) for r in listed] == [("c2", 2, "aa later"), ("c1", 15, "m00")]
    prompt = logs.prompt_history(messages.filter("conversation_id = 'c1'")).first().history.split("\n")
    assert prompt[0] == "User: m20" and prompt[-1] == "Assistant: m29" and len(prompt) == 10
    assert logs.delete_conversation(messages, "c2", "u").count() == 31


def test_audit_log(spark, tmp_path):
    path = str(tmp_path / "audit")
    event = spark.createDataFrame([("o", "SYNC", "cloud_account", NOW)],
                                  "organization_id string, action string, resource_type string, created_at timestamp")
    tables.write_audit(event, path)
    tables.write_audit(event.withColumn("created_at", F.lit(NOW + dt.timedelta(days=1))), path)
    page = logs.audit_page(tables.read_audit(spark, path), "o", "SYNC", limit=1).collect()
    assert len(page) == 1 and page[0].created_at == NOW + dt.timedelta(days=1)


def test_bucketed_tables_join_without_moving_the_charges(spark, records, accounts, tmp_path):
    from costlake.operators.joins import bucketed, join_dimension

    fact = bucketed(records, "charges_in_buckets", str(tmp_path / "c"), "cloud_account_id", 8)
    side = bucketed(accounts.select(F.col("id").alias("cloud_account_id"), "provider"), "accounts_in_buckets",
                    str(tmp_path / "a"), "cloud_account_id", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        totals = join_dimension(fact, side, "cloud_account_id").groupBy("cloud_account_id", "provider").agg(F.sum("amount"))
        plan = totals._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert {r[0]: float(r[2]) for r in totals.collect()} == {"a1": 225.0, "a2": 999.0, "a3": 5.0}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE charges_in_buckets")
        spark.sql("DROP TABLE accounts_in_buckets")
