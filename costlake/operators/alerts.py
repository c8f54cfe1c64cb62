"""Budgets, and alerts on their way to notification channels."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from costlake.functions.dates import in_window, resolve_window
from costlake.functions.text import severity_color
from costlake.operators.forecast import seasonal_forecast
from costlake.operators.joins import densify, join_dimension

#: Thresholds of a budget that names none, and the periods a budget can have.
DEFAULT_THRESHOLDS = (50, 80, 100)
PERIODS = ("monthly", "quarterly", "yearly")
SLACK_FIELD_LIMIT = 10
ERROR_LENGTH = 200
PRODUCT = "Costlake"

#: Alert rows: event, organization_id, title, message, severity, fields (ordered label/value pairs).
ALERT_COLUMNS = ("event", "organization_id", "title", "message", "severity", "fields")


def _period_start(period: Column, as_of: dt.datetime) -> Column:
    at = F.lit(as_of).cast("timestamp")
    return (
        F.when(period == "monthly", F.date_trunc("month", at))
        .when(period == "quarterly", F.date_trunc("quarter", at))
        .when(period == "yearly", F.date_trunc("year", at))
    ).cast("date")


def _period_end(period: Column, as_of: dt.datetime) -> Column:
    start = _period_start(period, as_of)
    months = F.when(period == "monthly", 1).when(period == "quarterly", 3).otherwise(12)
    return F.date_sub(F.add_months(start, months), 1)


def budget_status(
    budgets: DataFrame, costs: DataFrame, as_of: dt.datetime, tag_keys: Sequence[str] = ()
) -> DataFrame:
    """Spend of each active budget since the start of its period, and the thresholds it crossed.

    ``costs`` carry ``organization_id``.  Charges are first summed per tenant, day, service, region and the
    tag keys budgets may filter on, so that raw charges are neither moved nor multiplied by the
    number of budgets.
    """
    year_start = dt.datetime(as_of.year, 1, 1)
    tags = {f"tag:{k}": F.element_at("tags", k) for k in tag_keys}
    charges = in_window(costs, year_start, as_of).select(
        F.col("organization_id").alias("_org"), F.to_date("date").alias("_ds"),
        F.col("service").alias("_service"), F.col("region").alias("_region"),
        *[c.alias(k) for k, c in tags.items()], F.col("amount").alias("_amount"),
    )
    known = F.array(*[F.lit(k) for k in ("service", "region", *tag_keys)])
    foreign = F.size(F.array_except(F.map_keys("filters"), known)) > 0
    refusal = F.raise_error(F.concat(F.lit("name the tag keys of budget "), "id", F.lit(" in tag_keys")))
    start = F.when(foreign, refusal.cast("date")).otherwise(_period_start(F.col("period"), as_of))
    active = budgets.filter("is_active").withColumn("period_start", start)

    def allows(key: str, column: Column) -> Column:
        wanted = F.element_at("filters", key)
        return wanted.isNull() | F.coalesce(wanted == column, F.lit(False))

    matches = (
        (F.col("organization_id") == F.col("_org")) & (F.col("_ds") >= F.col("period_start"))
        & allows("service", F.col("_service")) & allows("region", F.col("_region"))
    )
    for key in tag_keys:
        matches = matches & allows(key, F.col(f"`tag:{key}`"))
    cells = [f"`{c}`" for c in charges.columns if c != "_amount"]
    matched = charges.groupBy(*cells).agg(F.sum("_amount").alias("_amount")).join(active, matches)
    spend = matched.groupBy("id").agg(F.sum("_amount").alias("_spend"))
    current = F.coalesce("_spend", F.lit(0)).cast("decimal(28,8)")
    with_spend = active.join(spend, "id", "left").select(
        *budgets.columns, "period_start", current.alias("current_spend")
    )
    percent = F.try_divide(F.col("current_spend").cast("double") * 100, F.col("amount").cast("double"))
    thresholds = F.coalesce("alert_thresholds", F.array(*[F.lit(t) for t in DEFAULT_THRESHOLDS]))
    return with_spend.withColumn("usage_percent", percent).withColumn(
        "remaining", F.col("amount") - F.col("current_spend")
    ).withColumn(
        "alerts_triggered", F.filter(thresholds, lambda t: t <= F.col("usage_percent"))
    )


def budget_forecast(
    status: DataFrame, costs: DataFrame, as_of: dt.datetime, history_days: int = 90
) -> DataFrame:
    """Add ``forecast_end_of_period``: spend so far plus the forecast to the end of the period."""
    start, end = resolve_window(as_of, history_days)
    daily = in_window(costs, start, end).groupBy(
        "organization_id", F.to_date("date").alias("ds")
    ).agg(F.sum("amount").cast("double").alias("amount"))
    # the days up to as_of count as known, with 0 where nothing was charged
    series = densify(daily, start, end, ["organization_id"])
    # the end of a period depends on its kind alone: three sums per tenant serve all its budgets
    today = F.lit(as_of).cast("date")
    ahead = seasonal_forecast(series, 366, ["organization_id"]).filter(F.col("ds") > today)
    rest = ahead.groupBy("organization_id").agg(*[
        F.sum(F.when(F.col("ds") <= _period_end(F.lit(p), as_of), F.col("predicted_cost"))).alias(f"_{p}")
        for p in PERIODS
    ])
    expected = F.coalesce(*[F.when(F.col("period") == p, F.col(f"_{p}")) for p in PERIODS], F.lit(0.0))
    return status.join(rest, "organization_id", "left").select(
        *status.columns,
        (F.col("current_spend").cast("double") + expected).alias("forecast_end_of_period"),
    )


# ---- alert payloads --------------------------------------------------------------------------


def _dollars(amount: Column) -> Column:
    """``$1,234.50``; in alerts the minus sign follows the dollar sign: ``$-1,234.50``."""
    return F.concat(F.lit("$"), F.format_number(amount.cast("double"), 2))


def _fields(*pairs: tuple[str, Column]) -> Column:
    """Ordered label/value list of an alert."""
    return F.array(*[
        F.struct(F.lit(name).alias("label"), value.cast("string").alias("value"))
        for name, value in pairs
    ])


def budget_alerts(status: DataFrame) -> DataFrame:
    """One alert per crossed threshold of each budget."""
    crossed = status.withColumn("threshold", F.explode("alerts_triggered"))
    percent = F.col("usage_percent")
    name = F.col("name")
    severity = F.when(F.col("threshold") >= 100, "critical").when(
        F.col("threshold") >= 80, "high").otherwise("medium")
    return crossed.select(
        F.lit("budget").alias("event"), "organization_id",
        F.concat(F.lit("Budget Alert — "), name).alias("title"),
        F.concat(F.lit("Budget *"), name, F.lit("* has reached *"),
                 F.format_string("%.0f", F.bround(percent, 0)), F.lit("%* of its limit."))
        .alias("message"),
        severity.alias("severity"),
        _fields(
            ("Budget", name),
            ("Current Spend", _dollars(F.col("current_spend"))),
            ("Budget Limit", _dollars(F.col("amount"))),
            ("Usage", F.format_string("%.1f%%", F.round(percent, 1))),
            ("Threshold Crossed", F.concat(F.col("threshold").cast("string"), F.lit("%"))),
        ).alias("fields"),
    )


def anomaly_alerts(anomalies: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One alert per anomaly, with the columns of ``keep``; an ``*_amount`` that is missing *or 0* falls back to
    ``*_cost``."""
    def figure(name: str) -> Column:
        parts = [F.nullif(F.col(f"{name}_amount").cast("double"), F.lit(0.0))
                 if f"{name}_amount" in anomalies.columns else F.lit(None).cast("double"),
                 F.col(f"{name}_cost").cast("double")
                 if f"{name}_cost" in anomalies.columns else F.lit(None).cast("double"),
                 F.lit(0.0)]
        return F.coalesce(*parts)

    severity = F.coalesce("severity", F.lit("medium"))
    service = F.coalesce("service", F.lit("Unknown"))
    account = F.coalesce("account_name", F.lit(""))
    return anomalies.select(
        F.lit("anomaly").alias("event"), "organization_id",
        F.concat(F.lit("Cost Anomaly Detected — "), F.upper(severity)).alias("title"),
        F.concat(F.lit("Unusual spending detected on *"), service, F.lit("* in account *"),
                 account, F.lit("*.")).alias("message"),
        severity.alias("severity"),
        _fields(
            ("Service", service), ("Account", F.coalesce(F.nullif(account, F.lit("")), F.lit("N/A"))),
            ("Actual Cost", _dollars(figure("actual"))),
            ("Expected Cost", _dollars(figure("expected"))),
            ("Deviation", F.format_string("%+.1f%%", F.round(F.coalesce("deviation_percent", F.lit(0.0)), 1))),
            ("Severity", F.initcap(severity)),
        ).alias("fields"), *keep,
    )


def sync_failure_alerts(results: DataFrame) -> DataFrame:
    """One alert per failed sync (organization_id, account_name, provider, error)."""
    return results.filter(F.col("error").isNotNull()).select(
        F.lit("sync_failure").alias("event"), "organization_id",
        F.concat(F.lit("Sync Failed — "), "account_name").alias("title"),
        F.concat(F.lit("Cost sync for *"), "account_name", F.lit("* ("), "provider",
                 F.lit(") failed.")).alias("message"),
        F.lit("high").alias("severity"),
        _fields(
            ("Account", F.col("account_name")), ("Provider", F.col("provider")),
            ("Error", F.substring("error", 1, ERROR_LENGTH)),
        ).alias("fields"),
    )


# ---- fan-out ---------------------------------------------------------------------------------


def subscribed(alerts: DataFrame, channels: DataFrame) -> DataFrame:
    """Alerts times the active channels of their tenant that subscribe to the event."""
    live = channels.filter("is_active").select(
        F.col("id").alias("channel_id"), "organization_id", "channel_type", "events"
    )
    return join_dimension(alerts, live, "organization_id").filter(
        F.array_contains("events", F.col("event"))
    ).drop("events")


def _text(kind: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), text.alias("text"))


def slack_body(sent_at: Column) -> Column:
    """Block message; at most ten fields, as the receiving API allows."""
    header = F.struct(
        F.lit("header").alias("type"),
        F.struct(F.lit("plain_text").alias("type"), F.concat(F.lit("⚡ "), F.col("title")).alias("text"),
                 F.lit(True).alias("emoji")).alias("text"),
    )
    section = F.struct(F.lit("section").alias("type"),
                       _text("mrkdwn", F.col("message")).alias("text"))
    details = F.struct(
        F.lit("section").alias("type"),
        F.transform(
            F.slice("fields", 1, SLACK_FIELD_LIMIT),
            lambda f: _text("mrkdwn", F.concat(F.lit("*"), f["label"], F.lit("*\n"), f["value"])),
        ).alias("fields"),
    )
    context = F.struct(F.lit("context").alias("type"),
                       F.array(_text("mrkdwn", _footer(sent_at))).alias("elements"))
    # blocks differ in shape, so each is rendered on its own
    blocks = [F.to_json(b) for b in (header, section)]
    blocks += [F.when(F.size("fields") > 0, F.to_json(details)), F.to_json(context)]
    attachments = F.to_json(F.array(F.struct(
        severity_color("severity").alias("color"), F.array().cast("array<string>").alias("blocks")
    )))
    return F.concat(F.lit('{"blocks":['), F.concat_ws(",", *blocks),
                    F.lit('],"attachments":'), attachments, F.lit("}"))


def teams_body(sent_at: Column) -> Column:
    """Adaptive card with the fields as facts."""
    color = F.when(severity_color("severity") == "#e74c3c", "Attention").otherwise("Default")
    block = F.lit("TextBlock").alias("type")
    title = F.struct(block, F.lit("Large").alias("size"), F.lit("Bolder").alias("weight"),
                     F.concat(F.lit("⚡ "), F.col("title")).alias("text"), color.alias("color"))
    message = F.struct(block, F.col("message").alias("text"), F.lit(True).alias("wrap"))
    facts = F.struct(
        F.lit("FactSet").alias("type"),
        F.transform("fields", lambda f: F.struct(f["label"].alias("title"), f["value"].alias("value")))
        .alias("facts"),
    )
    footer = F.struct(block, _footer(sent_at).alias("text"), F.lit("Small").alias("size"),
                      F.lit(True).alias("isSubtle"))
    body = F.concat_ws(",", F.to_json(title), F.to_json(message),
                       F.when(F.size("fields") > 0, F.to_json(facts)), F.to_json(footer))
    return F.concat(
        F.lit('{"type":"message","attachments":[{'
              '"contentType":"application/vnd.microsoft.card.adaptive","content":{'
              '"$schema":"http://adaptivecards.io/schemas/adaptive-card.json",'
              '"type":"AdaptiveCard","version":"1.4","body":['),
        body, F.lit("]}}]}"),
    )


def webhook_body(sent_at: Column) -> Column:
    """Flat event with the fields as an object."""
    return F.to_json(F.struct(
        F.col("event"), F.date_format(sent_at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp"),
        "title", "message", "severity", F.map_from_entries("fields").alias("fields"),
    ))


def _footer(sent_at: Column) -> Column:
    return F.concat(F.lit(f"{PRODUCT} • "), F.col("event"), F.lit(" • "),
                    F.date_format(sent_at, "yyyy-MM-dd HH:mm"), F.lit(" UTC"))


def route_alerts(
    alerts: DataFrame, channels: DataFrame, sent_at: dt.datetime, keep: Sequence[str] = ()
) -> DataFrame:
    """Messages ready for delivery: channel, type and JSON body, and the columns of ``keep``."""
    at = F.lit(sent_at).cast("timestamp")
    body = (
        F.when(F.col("channel_type") == "slack", slack_body(at))
        .when(F.col("channel_type") == "teams", teams_body(at))
        .otherwise(webhook_body(at))
    )
    return subscribed(alerts, channels).select(
        "channel_id", "channel_type", "organization_id", "event", "severity", body.alias("body"), *keep
    )


def outbox(routed: DataFrame, alert_key: Sequence[str]) -> DataFrame:
    """Routed messages with ``delivery_id``: a stable key of the alert (its ``alert_key`` columns) and the channel.

    A receiver or a table keyed by it can take a message twice and hold it once.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in alert_key]
    return routed.withColumn("delivery_id", F.sha2(F.to_json(F.array(*parts, F.col("channel_id"))), 256))


def stream_outbox(
    alerts: DataFrame, channels: DataFrame, alert_key: Sequence[str], ts: str, sent_at: dt.datetime,
    lateness: str = "1 day",
) -> DataFrame:
    """Messages of a stream of alerts, one per alert and channel while ``lateness`` lasts.

    The dedup state is part of the stream's checkpoint: a restart neither repeats nor loses a message.
    """
    routed = route_alerts(alerts, channels, sent_at, keep=[*alert_key, ts])
    return outbox(routed, alert_key).withWatermark(ts, lateness).dropDuplicatesWithinWatermark(["delivery_id"])
