"""The cost model seen in a retail star schema plus event stream.

The tables at hand are order lines, suppliers and events.  Each view below is a projection of one of
them (accounts: of suppliers and the 25 nations), so it adds no shuffle and its filters and column
selection reach the Parquet scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from costlake.schemas import MONEY

#: The period the order lines cover, and the end of the event stream.
AS_OF = dt.datetime(2001, 12, 31, 23, 59, 59)
ALL_DAYS = 2557
EVENTS_AS_OF = dt.datetime(2024, 1, 31)
EVENT_HOURS = 30 * 24

SERVICES = (
    "AWS Lambda", "Amazon RDS", "Amazon S3", "Amazon CloudFront", "Amazon EC2", "Azure Functions",
    "SQL Database", "Blob Storage", "Azure CDN", "Virtual Machines", "Kubernetes Engine", "",
)
INSTANCE_SIZES = ("t3.micro", "t3.large", "m5.large", "x9.unknown", "zones/a/r5.large")

_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, "
              "props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table under its written schema; time stamps are UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Deal rows out over the cores if the scan alone would leave most of them idle.

    For heavy per-row work, such as JSON: a file with one row group is read by one task, however
    many cores there are.  A table of many splits comes back unchanged, without a shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() * 2 > cores else rows.repartition(cores, key)


def pick(values: tuple[str, ...], number: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (number % len(values)).cast("int"))


def _daily_running(
    events: DataFrame, keys: list[str], values: dict[str, Column]
) -> DataFrame:
    """Running sums since midnight per key, in the order of time and event.

    Ten-minute slices are summed on their own and then offset by the slices before them, so that a
    busy key's day is shared by many tasks.
    """
    names = list(values)
    rows = events.withColumns({
        **values, "_day": F.to_date("ts"), "_slice": F.floor(F.unix_seconds("ts") / 600),
    })
    slice_ = [*keys, "_day", "_slice"]
    ordered = Window.partitionBy(*slice_).orderBy("ts", "event_id")
    before = Window.partitionBy(*keys, "_day").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*slice_).agg(*[F.sum(n).alias(n) for n in names]).select(
        *slice_, *[F.coalesce(F.sum(n).over(before), F.lit(0.0)).alias(f"_{n}") for n in names]
    )
    summed = rows.withColumns({n: F.sum(n).over(ordered) for n in names})
    return summed.join(offsets, slice_).withColumns(
        {n: F.col(n) + F.col(f"_{n}") for n in names}
    ).drop("_day", "_slice", *[f"_{n}" for n in names])


def organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("name")
    )


def cloud_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # nation holds 25 rows at any scale
    nation = F.broadcast(table(spark, sf_dir, "nation"))
    key = F.col("s_suppkey")
    joined = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select(
        key.cast("string").alias("id"),
        F.col("n_regionkey").cast("string").alias("organization_id"),
        pick(("demo", "aws", "gcp", "azure"), key).alias("provider"),
        F.concat(F.lit("acct-"), F.lpad(key.cast("string"), 9, "0")).alias("account_id"),
        F.col("s_name").alias("account_name"),
        F.col("n_name").alias("business_unit"),
        F.when(key % 3 == 0, "prod").when(key % 3 == 1, "staging").alias("environment"),
        F.concat(F.lit("cc-"), (F.col("s_nationkey") % 5).cast("string")).alias("cost_center"),
        (F.col("s_acctbal") > 0).alias("is_active"),
        F.date_add(F.lit("1994-01-01").cast("date"), (key % 365).cast("int")).cast("timestamp")
        .alias("created_at"),
    )


def cost_records(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Charges; ``lines`` may be the order lines as a stream."""
    if lines is None:
        lines = table(spark, sf_dir, "lineitem")
    line = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    owner = F.map_from_arrays(
        F.array(F.lit("workload"), F.lit("owner")),
        F.array(F.concat(F.lit("w-"), (F.col("l_orderkey") % 9).cast("string")),
                F.concat(F.lit("team-"), (F.col("l_partkey") % 7).cast("string"))),
    )
    ownerless = F.create_map(F.lit("workload"), F.concat(F.lit("w-"), (F.col("l_orderkey") % 9).cast("string")))
    return lines.select(
        line.alias("id"),
        F.col("l_suppkey").cast("string").alias("cloud_account_id"),
        F.col("l_shipdate").alias("date"),
        F.when(F.col("l_linenumber") == 6, "monthly").otherwise("daily").alias("granularity"),
        pick(SERVICES, F.col("l_partkey")).alias("service"),
        F.when(F.col("l_returnflag") != "N", F.concat("l_returnflag", "l_linestatus")).alias("region"),
        line.alias("resource_id"),
        F.when(F.col("l_linenumber") == 7, -F.col("l_quantity"))
        .otherwise(F.col("l_extendedprice")).cast(MONEY).alias("amount"),
        F.lit("USD").alias("currency"),
        F.when(F.col("l_tax") == 0, F.lit(None)).when(F.col("l_discount") == 0, ownerless)
        .otherwise(owner).alias("tags"),
        F.lit(None).cast("map<string,string>").alias("record_metadata"),
    )


def aws_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One billing response per order line: a cost group and a tax group.

    Some pages are cut off, and some costs are no number.
    """
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    tax = (F.col("l_tax") * 100).cast("decimal(18,2)").cast("string")

    def money(amount: Column, unit: Column) -> Column:
        return F.struct(amount.alias("Amount"), unit.alias("Unit"))

    cost_group = F.struct(
        F.when(F.col("l_linenumber") == 3, F.array().cast("array<string>"))
        .otherwise(F.array(pick(SERVICES, F.col("l_partkey")))).alias("Keys"),
        F.struct(
            money(F.when(F.col("l_orderkey") % 89 == 0, "n/a").when(F.col("l_discount") != 0, price), F.when(F.col("l_linenumber") != 2, F.lit("EUR")))
            .alias("UnblendedCost"),
            F.when(F.col("l_linenumber") != 4,
                   money(F.col("l_quantity").cast("decimal(18,2)").cast("string"), F.lit("N/A")))
            .alias("UsageQuantity"),
        ).alias("Metrics"),
    )
    tax_group = F.struct(
        F.array(F.lit("Tax")).alias("Keys"),
        F.struct(money(tax, F.lit("USD")).alias("UnblendedCost"),
                 F.lit(None).cast("struct<Amount:string,Unit:string>").alias("UsageQuantity"))
        .alias("Metrics"),
    )
    period = F.struct(
        F.struct(F.date_format("l_shipdate", "yyyy-MM-dd").alias("Start"),
                 F.date_format(F.date_add("l_shipdate", 1), "yyyy-MM-dd").alias("End"))
        .alias("TimePeriod"),
        F.array(cost_group, tax_group).alias("Groups"),
    )
    page = F.to_json(F.struct(F.array(period).alias("ResultsByTime")))
    return spread(table(spark, sf_dir, "lineitem"), "l_orderkey").select(
        F.col("l_suppkey").cast("string").alias("cloud_account_id"),
        F.when(F.col("l_orderkey") % 97 == 0, F.substring(page, 1, 15)).otherwise(page).alias("payload"),
    )


def gcp_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested export rows from orders; every ninth order is a credit, every thirteenth has no cost."""
    priority, key = F.col("o_orderpriority"), F.col("o_orderkey")
    cents = F.col("o_totalprice").cast("decimal(18,2)").cast(MONEY)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").alias("usage_start_time"),
        F.struct(F.when(key % 10 != 0, priority).alias("description")).alias("service"),
        F.struct(
            F.when(key % 4 == 0, F.lit("us-central1")).alias("region"),
            F.when(key % 4 == 1, F.lit("eu")).alias("location"),
            F.when(key % 4 == 2, F.lit("asia-a")).alias("zone"),
        ).alias("location"),
        F.when(key % 13 == 0, F.lit(None)).when(key % 9 == 0, -cents).when(key % 7 == 0, F.lit(0).cast(MONEY)).otherwise(cents)
        .alias("cost"),
        F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(F.lit("USD")).alias("currency"),
    )


def azure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positional rows of 3 to 5 cells from order lines; some with a cost that is no number."""
    cost = F.when(F.col("l_linenumber") == 5, F.lit("n/a")).otherwise(
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))
    full = F.array(cost, F.date_format("l_shipdate", "yyyy-MM-dd"),
                   pick(SERVICES, F.col("l_partkey")),
                   F.coalesce("l_returnflag", F.lit("")), F.lit("EUR"))
    cells = F.when(F.col("l_linenumber") == 1, 3).when(F.col("l_linenumber") == 2, 4).otherwise(5)
    return spread(table(spark, sf_dir, "lineitem"), "l_orderkey").select(
        F.col("l_suppkey").cast("string").alias("cloud_account_id"), F.slice(full, F.lit(1), cells).alias("row")
    )


def metric_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container metrics from events.

    A user is a pod.  Clicks, purchases and sign-ups drive counters that restart every day; views
    are memory gauges; network counters are in units of a MB.  Namespace 10 has memory only, 9 network only (their
    other events have metrics of their own, as errors do), and 11 has no name.
    """
    events = table(spark, sf_dir, "events")
    user, kind = F.col("user_id"), F.col("event_type")
    group = user % 12
    metric = (
        F.when(kind == "click", "container_cpu_usage_seconds_total")
        .when(kind == "view", "container_memory_working_set_bytes")
        .when(kind == "purchase", "container_network_receive_bytes_total")
        .when(kind == "error", "container_errors_total")
        .otherwise("container_network_transmit_bytes_total")
    )
    hidden = ((group == 10) & (kind != "view")) | ((group == 9) & kind.isin("click", "view"))
    namespace = F.when(group == 11, F.lit("")).otherwise(F.concat(F.lit("ns-"), group.cast("string")))
    app = F.when(user % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("app-"), (user % 7).cast("string")))
    labels = F.map_from_arrays(
        F.array(F.lit("namespace"), F.lit("pod"), F.lit("app")),
        F.array(namespace, F.concat(F.lit("pod-"), user.cast("string")), app),
    )
    counted = _daily_running(events, ["user_id", "event_type"], {"running": F.col("value")})
    return counted.select(
        "ts", F.when(hidden, F.concat(F.lit("unscheduled_"), metric)).otherwise(metric).alias("metric"),
        labels.alias("labels"),
        F.when(kind == "view", F.col("value") * 1024 * 1024)
        .when(kind.isin("purchase", "signup"), F.col("running") * 1048576).otherwise(F.col("running")).alias("value"),
    )


HISTOGRAM_BOUNDS = (10.0, 50.0, 100.0, 200.0)


def request_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request counter, duration buckets and ``up`` samples of each user's process, from events."""
    one = {f"upto_{i}": F.when(F.col("value") <= b, 1.0).otherwise(0.0)
           for i, b in enumerate(HISTOGRAM_BOUNDS)}
    counted = _daily_running(
        table(spark, sf_dir, "events"), ["user_id"], {**one, "upto_all": F.lit(1.0)}
    )
    bucket, total = F.lit("http_request_duration_seconds_bucket"), F.col("upto_all")

    def entry(metric: Column, le: str, value: Column) -> Column:
        return F.struct(metric.alias("metric"), F.lit(le).alias("le"), value.alias("value"))

    counted = counted.select(
        "ts", "user_id",
        F.array(
            *[entry(bucket, str(b), F.col(f"upto_{i}")) for i, b in enumerate(HISTOGRAM_BOUNDS)],
            entry(bucket, "+Inf", total), entry(F.lit("http_requests_total"), "", total),
            entry(F.lit("up"), "", F.when(F.col("event_type") == "error", 0.0).otherwise(1.0)),
        ).alias("samples"),
    )
    return counted.select("ts", "user_id", F.explode("samples").alias("s")).select(
        "ts", F.col("s.metric").alias("metric"),
        F.map_from_arrays(
            F.array(F.lit("job"), F.lit("user"), F.lit("le")),
            F.array(F.concat(F.lit("job-"), (F.col("user_id") % 4).cast("string")),
                    F.col("user_id").cast("string"), F.col("s.le")),
        ).alias("labels"),
        F.col("s.value").alias("value"),
    )


def requests(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Requests; ``events`` may be the events as a stream."""
    if events is None:
        events = table(spark, sf_dir, "events")
    return events.select(
        "ts", F.col("user_id").cast("string").alias("key"),
        pick(("demo", "aws", "gcp", "azure"), F.col("user_id")).alias("provider"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        F.col("value").alias("seconds"), "event_id",
    )


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One plan document per order line: an instance, a database or unsupported role, a bucket."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    actions = (
        F.when(flag == "A", F.array(F.lit("create"))).when(flag == "R", F.array(F.lit("delete")))
        .when(status == "F", F.array(F.lit("update")))
        .when(F.col("l_linenumber") == 1, F.array(F.lit("delete"), F.lit("create")))
        .otherwise(F.array(F.lit("no-op")))
    )
    before = F.create_map(F.lit("instance_type"), pick(INSTANCE_SIZES, F.col("l_partkey")))
    after = F.create_map(F.lit("instance_type"), pick(INSTANCE_SIZES, F.col("l_partkey") + F.col("l_linenumber")))
    none = F.lit(None).cast("map<string,string>")

    def change(kind: Column, actions: Column, before: Column, after: Column) -> Column:
        return F.struct(
            kind.alias("type"), F.lit("main").alias("name"),
            F.struct(actions.alias("actions"), before.alias("before"), after.alias("after")).alias("change"),
        )

    second = F.when(F.col("l_linenumber") % 3 == 0, "aws_iam_role").otherwise("aws_db_instance")
    changes = F.array(
        change(F.lit("aws_instance"), actions, before, after),
        change(second, F.array(F.lit("create")), none, none),
        change(F.lit("aws_s3_bucket"), F.array(F.when(F.col("l_tax") == 0, "read").otherwise("no-op")), none, none),
    )
    return spread(table(spark, sf_dir, "lineitem"), "l_orderkey").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("plan_id"),
        F.col("l_suppkey").cast("string").alias("cloud_account_id"),
        F.to_json(F.struct(changes.alias("resource_changes"))).alias("document"),
    )


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("conversation_id"),
        (F.col("conv_id") % 10).cast("string").alias("user_id"),
        "role", F.col("text").alias("content"),
        F.timestamp_seconds(start + F.col("turn") * 60 + F.col("conv_id") * 3600).alias("created_at"),
    )


def audit_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).cast("string").alias("organization_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("event_type").alias("action"), F.lit("event").alias("resource_type"),
        F.col("event_id").cast("string").alias("resource_id"),
        F.create_map(F.lit("props"), F.col("props")).alias("details"),
        F.lit(None).cast("string").alias("ip_address"), F.col("ts").alias("created_at"),
    )


def sync_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sync outcomes from events: an account's number is that of its user."""
    kind = F.col("event_type")
    status = F.when(kind == "click", "queued").when(kind == "view", "syncing").when(
        kind == "error", "error").otherwise("ready")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("cloud_account_id"), F.col("ts").alias("finished_at"),
        status.alias("status"), F.floor("value").cast("bigint").alias("records_imported"),
        F.when(kind == "error", F.concat(F.lit("token="), "props")).alias("error"),
    )


def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three budgets per tenant: monthly for storage, quarterly for one region, yearly for all."""
    org = F.col("id")
    amounts = [("monthly", 4_000_000.0, F.create_map(F.lit("service"), F.lit("Amazon S3"))),
               ("quarterly", 30_000_000.0, F.create_map(F.lit("region"), F.lit("AF"))),
               ("yearly", 200_000_000.0, F.lit(None).cast("map<string,string>"))]
    rows = F.array(*[
        F.struct(F.lit(p).alias("period"), F.lit(a).cast("decimal(18,2)").alias("amount"), f.alias("filters"))
        for p, a, f in amounts
    ])
    return organizations(spark, sf_dir).select(org.alias("organization_id"), F.explode(rows).alias("b")).select(
        F.concat_ws("-", "organization_id", "b.period").alias("id"), "organization_id",
        F.initcap("b.period").alias("name"), F.col("b.amount").alias("amount"),
        F.col("b.period").alias("period"), F.col("b.filters").alias("filters"),
        F.when(F.col("organization_id") != "0", F.array(F.lit(10), F.lit(50), F.lit(80), F.lit(100)))
        .alias("alert_thresholds"),
        (F.col("organization_id") != "4").alias("is_active"),
    )


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Slack, a Teams and a webhook channel per tenant; tenant 3 has switched Slack off."""
    events = {"slack": ("anomaly", "budget"), "teams": ("anomaly", "sync_failure"),
              "webhook": ("budget", "sync_failure", "anomaly")}
    kinds = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.array(*[F.lit(e) for e in v]).alias("events"))
        for k, v in events.items()
    ])
    return organizations(spark, sf_dir).select(F.col("id").alias("organization_id"), F.explode(kinds).alias("c")).select(
        F.concat_ws("-", "organization_id", "c.kind").alias("id"), "organization_id",
        F.col("c.kind").alias("channel_type"), F.col("c.events").alias("events"),
        ((F.col("organization_id") != "3") | (F.col("c.kind") != "slack")).alias("is_active"),
    )
