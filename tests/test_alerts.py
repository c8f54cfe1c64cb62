import datetime as dt
import json
from decimal import Decimal

import pytest
from conftest import NOW
from pyspark.sql import functions as F

from costlake import schemas
from costlake.operators import alerts, costs as c


@pytest.fixture(scope="module")
def budgets(spark):
    return spark.createDataFrame([
        ("b1", "org", "Monthly Prod", Decimal("1000"), "monthly", {"service": "EC2"}, None, True),
        ("b2", "org", "Quarterly", Decimal("1000"), "quarterly", None, [100], True),
        ("b3", "other", "Empty", Decimal("10"), "yearly", None, None, True),
        ("b4", "org", "Off", Decimal("1"), "monthly", None, None, False),
        ("b5", "org", "Tagged", Decimal("100"), "yearly", {"team": "x"}, None, True),
    ], schemas.BUDGETS)


@pytest.fixture(scope="module")
def status(make_costs, accounts, budgets):
    costs = c.with_accounts(make_costs(
        ("a1", 0, "EC2", "r", "850"), ("a1", 1, "S3", "r", "20", "daily", {"team": "x"}),
        ("a2", 30, "S3", None, "150"), ("a1", 100, "S3", None, "7", "daily", {"team": "x"}), ("a3", 500, "S3", None, "9")),
        accounts)
    return alerts.budget_status(budgets, costs, NOW, tag_keys=["team"])


def test_budget_status(status):
    got = {r.id: r for r in status.collect()}
    assert set(got) == {"b1", "b2", "b3", "b5"}
    assert (got["b1"].current_spend, got["b1"].usage_percent, got["b1"].alerts_triggered) == (850, 85.0, [50, 80])
    assert (got["b2"].current_spend, got["b2"].alerts_triggered, got["b2"].remaining) == (1020, [100], -20)
    assert got["b3"].current_spend == 0 and got["b3"].alerts_triggered == []
    assert got["b5"].current_spend == 20


def test_amounts_below_zero_keep_the_dollar_in_front(spark):
    found = spark.createDataFrame(
        [("o", "low", "EC2", "acct", -1234.5, 10.0, -5.0)],
        "organization_id string, severity string, service string, account_name string, actual_cost double, "
        "expected_cost double, deviation_percent double")
    fields = {f.label: f.value for f in alerts.anomaly_alerts(found).first().fields}
    assert fields["Actual Cost"] == "$-1,234.50" and fields["Expected Cost"] == "$10.00"


def test_unnamed_tag_filters_are_refused(make_costs, accounts, budgets):
    costs = c.with_accounts(make_costs(("a1", 0, "EC2", "r", "1")), accounts)
    with pytest.raises(Exception, match="tag_keys"):
        alerts.budget_status(budgets, costs, NOW).collect()


def test_budget_alerts(status):
    got = alerts.budget_alerts(status.filter("id IN ('b1', 'b2')")).collect()
    assert sorted(r.severity for r in got) == ["critical", "high", "medium"]
    high = next(r for r in got if r.severity == "high")
    assert high.title == "Budget Alert — Monthly Prod" and "85%" in high.message
    assert {f.label: f.value for f in high.fields} == {
        "Budget": "Monthly Prod", "Current Spend": "$850.00", "Budget Limit": "$1,000.00", "Usage": "85.0%",
        "Threshold Crossed": "80%"}


def test_budget_forecast(make_costs, accounts, budgets):
    days = [("a1", back, "EC2", "r", "10") for back in range(0, 90)]
    costs = c.with_accounts(make_costs(*days), accounts)
    state = alerts.budget_status(budgets, costs, NOW, tag_keys=["team"])
    got = {r.id: r for r in alerts.budget_forecast(state, costs, NOW).collect()}
    # 15 days of the month so far, 16 to come
    assert (float(got["b1"].current_spend), got["b1"].forecast_end_of_period) == (150.0, 310.0)
    assert got["b3"].forecast_end_of_period == 0


def test_anomaly_alert_falls_back(spark):
    rows = [("o", "acc", "EC2", "high", 500.0, 100.0, 0.0, 1.0, 400.0), ("o", "", "EC2", "low", 0.0, None, 7.0, 8.0, None)]
    df = spark.createDataFrame(rows, "organization_id string, account_name string, service string, severity string, "
                               "actual_amount double, expected_amount double, actual_cost double, expected_cost double, "
                               "deviation_percent double")
    first, second = alerts.anomaly_alerts(df).collect()
    fields = {f.label: f.value for f in first.fields}
    assert first.title == "Cost Anomaly Detected — HIGH"
    assert (fields["Actual Cost"], fields["Expected Cost"], fields["Deviation"], fields["Severity"]) == (
        "$500.00", "$100.00", "+400.0%", "High")
    fields = {f.label: f.value for f in second.fields}
    assert (fields["Actual Cost"], fields["Expected Cost"], fields["Account"]) == ("$7.00", "$8.00", "N/A")


def test_routing(spark):
    failures = spark.createDataFrame([("o", 'my "acc"', "aws", "e" * 300), ("p", "x", "gcp", "e"), ("o", "fine", "aws", None)],
                                     "organization_id string, account_name string, provider string, error string")
    channels = spark.createDataFrame([
        ("c1", "o", "slack", ["sync_failure"], True), ("c2", "o", "teams", ["sync_failure"], True),
        ("c3", "o", "webhook", ["sync_failure", "anomaly"], True), ("c4", "o", "slack", ["anomaly"], True),
        ("c5", "o", "slack", ["sync_failure"], False)], schemas.NOTIFICATION_CHANNELS)
    alert = alerts.sync_failure_alerts(failures)
    assert alert.count() == 2
    got = {r.channel_id: json.loads(r.body) for r in alerts.route_alerts(alert, channels, dt.datetime(2026, 1, 1, 9, 30)).collect()}
    assert set(got) == {"c1", "c2", "c3"}
    slack = got["c1"]
    assert [b["type"] for b in slack["blocks"]] == ["header", "section", "section", "context"]
    assert slack["blocks"][0]["text"]["text"] == '⚡ Sync Failed — my "acc"'
    assert slack["blocks"][2]["fields"][2]["text"] == "*Error*\n" + "e" * 200
    assert slack["attachments"] == [{"color": "#e67e22", "blocks": []}]
    card = got["c2"]["attachments"][0]["content"]
    assert card["$schema"].startswith("http://adaptivecards.io") and card["body"][2]["facts"][1] == {"title": "Provider", "value": "aws"}
    assert got["c3"]["fields"]["Provider"] == "aws" and got["c3"]["timestamp"] == "2026-01-01T09:30:00+00:00"


def test_slack_shows_ten_fields(spark):
    df = spark.range(1).select(
        F.lit("e").alias("event"), F.lit("t").alias("title"), F.lit("m").alias("message"), F.lit("info").alias("severity"),
        F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.struct(
            i.cast("string").alias("label"), F.lit("v").alias("value"))).alias("fields"))
    body = json.loads(df.select(alerts.slack_body(F.lit(NOW))).first()[0])
    assert len(body["blocks"][2]["fields"]) == 10
    bare = json.loads(df.withColumn("fields", F.slice("fields", 1, 0)).select(alerts.slack_body(F.lit(NOW))).first()[0])
    assert [b["type"] for b in bare["blocks"]] == ["header", "section", "context"]
