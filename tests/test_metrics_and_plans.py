import datetime as dt
import json

import pytest

from costlake import schemas
from costlake.operators import infra, k8s, metrics

T0 = dt.datetime(2026, 1, 1)


def sample(minutes, metric, value, **labels):
    return (T0 + dt.timedelta(minutes=minutes), metric, labels, float(value))


@pytest.fixture(scope="module")
def samples(spark):
    rows = []
    # cpu: 0, 3600, restart at 1200, 2400 -> increase 3600 + 1200 + 1200 over hours that are stitched
    for m, v in ((30, 0), (90, 3600), (100, 1200), (1400, 2400)):
        rows.append(sample(m, k8s.CPU, v, namespace="web", pod="w1", app="shop"))
    rows += [sample(m, k8s.CPU, v, namespace="web", pod="w2") for m, v in ((30, 0), (1430, 7200))]
    rows += [sample(m, k8s.MEMORY, v * k8s.GB, namespace="web", pod="w1", app="shop") for m, v in ((10, 2), (20, 4))]
    rows += [sample(10, k8s.MEMORY, k8s.GB, namespace="cache", pod="c1", app="")]
    rows += [sample(m, k8s.RECEIVED, v, namespace="ghost", pod="g") for m, v in ((10, 0), (20, 10**9))]
    rows += [sample(m, k8s.RECEIVED, v, namespace="web", pod="w1") for m, v in ((10, 0), (1300, k8s.GB))]
    rows += [sample(10, k8s.MEMORY, k8s.GB, namespace="", pod="")]
    rows += [sample(-5, k8s.MEMORY, 99 * k8s.GB, namespace="web", pod="w1", app="shop")]
    return spark.createDataFrame(rows, schemas.METRIC_SAMPLES)


END = T0 + dt.timedelta(days=1)


def test_rates_survive_resets_and_slices(samples):
    rate = metrics.counter_rate(samples, k8s.CPU, END, 24, {"pod": metrics.label("pod")})
    got = {r.pod: r.value * 86400 for r in rate.collect()}
    assert got == pytest.approx({"w1": 6000, "w2": 7200})


def test_rate_equals_a_plain_scan(spark):
    values = [(i * 7919) % 1000 for i in range(500)]
    rows = [sample(i * 13, "m", v, s="x") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, schemas.METRIC_SAMPLES)
    plain = sum(b if b < a else b - a for a, b in zip(values, values[1:]))
    hours = 500 * 13 / 60 + 1
    got = metrics.counter_rate(df, "m", T0 + dt.timedelta(hours=hours - 1), hours, {"s": metrics.label("s")}).first()
    assert got.value * hours * 3600 == pytest.approx(plain)


def test_label_order_does_not_split_series(spark):
    rows = [(T0, "g", {"a": "1", "b": "2"}, 1.0), (T0, "g", {"b": "2", "a": "1"}, 3.0)]
    df = spark.createDataFrame(rows, schemas.METRIC_SAMPLES)
    assert metrics.gauge_avg(df, "g", T0, 1, {"a": metrics.label("a")}).first().value == 2.0


def test_namespace_costs(samples):
    got = k8s.namespace_costs(samples, END, "24h").collect()
    # network-only and blank namespaces are gone, memory-only ones stay
    assert [r.namespace for r in got] == ["web", "cache"]
    web = got[0]
    cores = 13200 / 86400
    assert web.cpu_cores == round(cores, 4) and web.memory_gb == 3.0
    assert web.network_gb == 1.0 and web.network_cost == 0.01
    assert web.cost == round(cores * 0.04 * 24 + 3 * 0.004 * 24 + 0.01, 4)
    assert got[1].cpu_cost == 0 and got[1].cost == round(0.004 * 24, 4)
    totals = k8s.k8s_totals(k8s.namespace_costs(samples, END)).first()
    assert totals.memory_gb == 4.0


def test_one_pass_equals_merged_queries(samples):
    from costlake.operators.joins import merge_metrics

    by_ns = {"namespace": metrics.label("namespace")}
    named = samples.filter(metrics.label("namespace") != "")
    merged = merge_metrics(
        metrics.counter_rate(named, k8s.CPU, END, 24, by_ns), metrics.gauge_avg(named, k8s.MEMORY, END, 24, by_ns),
        metrics.counter_rate(named, k8s.RECEIVED, END, 24, by_ns), metrics.counter_rate(named, k8s.SENT, END, 24, by_ns),
        ["namespace"])
    apart = {r.namespace: (r.cpu, r.memory / k8s.GB, r.received + r.sent) for r in merged.collect()}
    single = {r.namespace: (r.cores, r.gb, r.net_rate)
              for r in k8s.usage(named, END, 24, by_ns, network=True).collect()}
    assert set(apart) == set(single) == {"web", "cache"}
    for key in apart:
        assert apart[key] == pytest.approx(single[key])


def test_pods_and_labels(samples):
    pods = {r.pod: r for r in k8s.pod_costs(samples, "web", END).collect()}
    assert set(pods) == {"w1", "w2"} and pods["w1"].memory_gb == 3.0
    labels = {r.value: r for r in k8s.label_costs(samples, END, "app").collect()}
    assert set(labels) == {"shop", "unlabeled"} and labels["unlabeled"].memory_gb == 2.0


def test_trend_looks_back_one_hour(spark):
    rows = [
        sample(-30, k8s.CPU, 0, namespace="a"), sample(0, k8s.CPU, 360, namespace="a"),  # step 0
        sample(1400, k8s.CPU, 360, namespace="a"), sample(1440, k8s.CPU, 720, namespace="a"),  # step 1
        sample(700, k8s.CPU, 500, namespace="a"),  # in no look-back
        sample(1440 - 60, k8s.MEMORY, k8s.GB, namespace="a"),  # exactly an hour before: out
        sample(1439, k8s.MEMORY, 2 * k8s.GB),
    ]
    df = spark.createDataFrame(rows, schemas.METRIC_SAMPLES)
    got = [(r.ts, r.namespace, r.cpu_cost, r.memory_cost) for r in k8s.namespace_trend(df, END, 1).collect()]
    assert got == [(T0, "a", round(0.1 * 0.96, 4), 0.0), (END, "a", round(0.1 * 0.96, 4), 0.0),
                   (END, "unknown", 0.0, round(2 * 0.096, 4))]
    pivot = k8s.trend_pivot(k8s.namespace_trend(df, END, 1), ["a", "unknown"]).orderBy("date").collect()
    assert [r.unknown for r in pivot] == [None, 0.192]


def test_quantile_inside_buckets(spark):
    rows = []
    for le, count in (("1", 10), ("5", 90), ("10", 95), ("+Inf", 100)):
        rows += [sample(0, "h", 0, le=le, k="x"), sample(5, "h", count, le=le, k="x")]
    df = spark.createDataFrame(rows, schemas.METRIC_SAMPLES)

    def at(q):
        return metrics.bucket_quantile(df, q, T0 + dt.timedelta(minutes=6), 0.2, {"k": metrics.label("k")}, "h").first().quantile

    assert at(0.5) == pytest.approx(1 + 4 * 40 / 80)
    assert at(0.05) == pytest.approx(0.5)
    assert at(0.99) == 10.0


def test_up(spark):
    df = spark.createDataFrame([sample(0, "up", 1, job="a"), sample(1, "up", 0, job="a"), sample(0, "up", 1, job="b")],
                               schemas.METRIC_SAMPLES)
    assert {r.job: r.up for r in metrics.target_up(df).collect()} == {"a": 0.0, "b": 1.0}
    assert {r.job: r.up for r in metrics.target_up(df, T0).collect()} == {"a": 1.0, "b": 1.0}


# ---- plans -----------------------------------------------------------------------------------


def change(kind, actions, before=None, after=None, **extra):
    return {"type": kind, "name": "x", "change": {"actions": actions, "before": before, "after": after}, **extra}


@pytest.fixture(scope="module")
def price(spark):
    def run(*changes, **options):
        df = spark.createDataFrame([("p", json.dumps({"resource_changes": changes}))], "plan_id string, document string")
        rates = infra.rate_table(spark)
        estimates = infra.plan_estimates(infra.explode_plans(df), rates, **options)
        summary = infra.plan_summary(df, rates, **options).first()
        grouped = infra.estimate_totals(estimates, ["plan_id"]).first()
        if grouped is not None:  # pricing inside the row and after exploding agree
            assert all(summary[c] == grouped[c] for c in grouped.asDict())
        return estimates.collect(), summary
    return run


MICRO, LARGE = {"instance_type": "t3.micro"}, {"instance_type": "t3.large"}


def test_created(price):
    rows, total = price(change("aws_instance", ["create"], after=MICRO), change("aws_s3_bucket", ["create"], after={}))
    assert (total.total_resources, total.estimated_monthly_increase, total.estimated_monthly_decrease) == (2, 9.89, 0)
    assert rows[0].address == "aws_instance.x"


def test_deleted(price):
    _, total = price(change("aws_instance", ["delete"], before={"instance_type": "m5.large"}))
    assert (total.estimated_monthly_decrease, total.net_monthly_delta) == (69.12, -69.12)


def test_updated(price):
    rows, total = price(change("aws_instance", ["update"], MICRO, LARGE))
    assert (rows[0].previous_cost, rows[0].monthly_cost) == (7.59, 60.74)
    assert total.estimated_monthly_increase == 53.15


def test_no_op_and_empty(price):
    rows, total = price(change("aws_instance", ["no-op"], MICRO, MICRO))
    assert rows == [] and total.total_resources == 0 and total.unsupported_resources == []


def test_unsupported(price):
    rows, total = price(change("aws_iam_role", ["create"], after={}, address="role.one"), change("aws_lb", ["read"]))
    assert (rows[0].monthly_cost, rows[0].unsupported) == (0.0, True)
    assert rows[1].monthly_cost is None and not rows[1].unsupported
    assert total.total_resources == 2 and total.unsupported_count == 1 and total.unsupported_resources == ["role.one"]


def test_replacement(price):
    rows, total = price(change("aws_instance", ["delete", "create"], LARGE, MICRO))
    assert rows[0].action == "delete+create" and rows[0].previous_cost == 0
    assert (total.estimated_monthly_increase, total.estimated_monthly_decrease) == (7.59, 0)
    _, delta = price(change("aws_instance", ["delete", "create"], LARGE, MICRO), replace_mode="delta")
    assert delta.net_monthly_delta == round(7.59 - 60.74, 2)


def test_actions_are_searched_once_per_change(spark, price):
    df = spark.createDataFrame([("p", "{}")], "plan_id string, document string")
    text = infra.plan_summary(df, infra.rate_table(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count(", create)") + text.count(", delete)") + text.count(", update)") == 3
    # deletes and creates in either order, with nulls among them, cost what they did
    for mode, gone in (("create", 0.0), ("delta", 60.74)):
        for actions in (["delete", "create"], ["create", "delete"], ["create", "update", "delete"]):
            assert price(change("aws_instance", actions, LARGE, MICRO), replace_mode=mode)[1].net_monthly_delta == round(7.59 - gone, 2)
    assert price(change("aws_instance", ["create", None], LARGE, MICRO))[1].net_monthly_delta == 7.59
    assert price(change("aws_instance", [None], LARGE, MICRO))[1].net_monthly_delta == 0
    with pytest.raises(ValueError):
        infra.plan_summary(df, infra.rate_table(spark), replace_mode="other")


def test_sizes(spark):
    rows = [("aws_instance", MICRO), ("aws_instance", {"instance_type": "huge"}), ("aws_instance", {}),
            ("google_compute_instance", {"machine_type": "zones/us/machineTypes/e2-micro"}), ("aws_iam_role", {})]
    df = spark.createDataFrame(rows, "type string, after map<string,string>")
    got = infra.resource_cost(df, infra.rate_table(spark)).collect()
    assert [r.monthly_cost for r in got] == [7.59, 30.0, 30.0, 6.11, None]


def test_price_list(spark):
    listed = infra.supported_resources(infra.rate_table(spark)).collect()
    assert len(listed) == 15 and sum(r.has_size_rates for r in listed) == 6
