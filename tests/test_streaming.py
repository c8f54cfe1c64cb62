import datetime as dt
import random
from collections import deque

import pandas as pd
import pytest
from pyspark.sql import functions as F

from costlake.functions.dates import resolve_window
from costlake.operators import anomaly, metrics, sync
from costlake.sources import tables
from costlake.streaming import alerting, ingest, limits, ordered

T0 = dt.datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def stream_of(spark, tmp_path_factory):
    """A frame as a stream of several files, one per micro-batch, in the order given."""
    def make(df, order, files=3):
        path = str(tmp_path_factory.mktemp("stream") / "in")
        rows = df.orderBy(order).collect()
        size = max(1, -(-len(rows) // files))
        for i in range(0, len(rows), size):
            spark.createDataFrame(rows[i:i + size], df.schema).coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return make


def same(a, b):
    return sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


@pytest.fixture(scope="module")
def requests(spark):
    rng = random.Random(7)
    rows = [(T0 + dt.timedelta(seconds=rng.randrange(3600)), f"k{rng.randrange(3)}",
             500 if rng.random() < 0.1 else 200, rng.random() * 100) for _ in range(600)]
    return spark.createDataFrame(rows, "ts timestamp, key string, status int, seconds double")


def test_error_ratio_stream_equals_batch(requests, stream_of):
    batch = alerting.error_ratio(requests, ["key"])
    live = ingest.run_to_table(alerting.error_ratio(stream_of(requests, "ts"), ["key"]), ["key", "window_start", "window_end"])
    assert same(batch, live)


def test_error_ratio_value(spark):
    df = spark.createDataFrame([(T0, 200), (T0, 503), (T0 + dt.timedelta(minutes=4), 200)], "ts timestamp, status int")
    got = {r.window_end: r for r in alerting.error_ratio(df).collect()}
    row = got[T0 + dt.timedelta(minutes=5)]
    assert row.error_ratio == pytest.approx((1 / 300) / (3 / 300)) and row.firing
    assert len(got) == 9


def test_latency_stream_is_close_to_batch(requests, stream_of):
    batch = {(r.key, r.window_start): r.p95 for r in alerting.latency_p95(requests, ["key"]).collect()}
    live = ingest.run_to_table(alerting.latency_p95(stream_of(requests, "ts"), ["key"]), ["key", "window_start", "window_end"])
    found = {(r.key, r.window_start): r.p95 for r in live.collect()}
    assert set(found) == set(batch)
    # the sketch returns an observed value near the interpolated one
    assert all(abs(found[k] - batch[k]) < 40 for k in batch)


def test_sustained(spark):
    def windows(flags):
        rows = [(T0 + dt.timedelta(minutes=i), f) for i, f in enumerate(flags)]
        return spark.createDataFrame(rows, "window_end timestamp, firing boolean")

    assert alerting.sustained(windows([True] * 5)).count() == 0
    row = alerting.sustained(windows([False] + [True] * 6 + [False] + [True] * 3)).first()
    assert (row.firing_from, row.firing_to, row.evaluations) == (T0 + dt.timedelta(minutes=1), T0 + dt.timedelta(minutes=6), 6)


def test_costs_stream_equals_batch(make_costs, accounts, stream_of):
    records = make_costs(*[(f"a{1 + i % 3}", i % 5, f"s{i % 2}", None, str(i)) for i in range(40)])
    batch = ingest.stream_costs(records, accounts)
    live = ingest.run_to_table(ingest.stream_costs(stream_of(records, "date"), accounts), ["organization_id", "service", "ds"])
    assert same(batch, live) and batch.count() > 5


def test_zscore_stream_equals_batch(requests, stream_of):
    rows = requests.select("key", F.col("seconds").alias("amount"), "ts")
    base = anomaly.baseline_stats(rows, ["key"])
    live = ingest.run_to_table(ingest.stream_zscore(stream_of(rows, "ts"), base, ["key"]), mode="append")
    assert same(anomaly.zscore_check(rows, base, ["key"]), live)


def test_stream_without_rows(spark, requests, tmp_path):
    path = str(tmp_path / "nothing")
    requests.filter("false").write.parquet(path)
    live = spark.readStream.schema(requests.schema).parquet(path)
    assert ingest.run_to_table(alerting.error_ratio(live, ["key"]), ["key", "window_start"]).count() == 0


def test_tasks(spark, accounts):
    messages = spark.createDataFrame([
        ('{"type": "sync_account", "account_id": "a3"}',), ('{"type": "sync_all", "organization_id": "org", "days": 7}',),
        ('{"type": "sync_account", "account_id": "a1", "days": 90}',), ('{"type": "odd"}',), ("broken",)], "value string")
    tasks = ingest.sync_tasks(messages)
    assert [r.route for r in tasks.collect()] == ["sync_account", "sync_all", "sync_account", "dropped", "dropped"]
    wanted = {r.id: r.days for r in ingest.accounts_to_sync(tasks, accounts).collect()}
    # a disabled account is synced when named, not as part of its tenant
    assert wanted == {"a1": 90, "a2": 7, "a3": 30}


def test_task_stream_runs_the_sync(spark, accounts, make_costs, stream_of, tmp_path):
    path = str(tmp_path / "costs")
    tables.write_costs(make_costs(("a1", 1, "old", None, "1"), ("a2", 1, "keep", None, "2")), path)
    now = dt.datetime(2026, 3, 15, 18, 30)
    pulled = make_costs(("a1", 1, "new", None, "5"), ("a1", 2, "new", None, "6"))

    def run(wanted, batch_id):
        for row in wanted.collect():  # a handful of accounts per batch
            start, end = resolve_window(now, row.days)
            mine = pulled.filter(F.col("cloud_account_id") == row.id)
            sync.import_window(spark, path, mine.select("date", "service", "amount", "currency"), row.id, start, end)

    messages = spark.createDataFrame([('{"type": "sync_account", "account_id": "a1"}',)] * 2, "value string")
    ingest.run_sync_tasks(stream_of(messages, "value", 2), accounts, run, str(tmp_path / "cp")).awaitTermination()
    got = sorted((r.cloud_account_id, r.service) for r in tables.read_costs(spark, path).collect())
    assert got == [("a1", "new"), ("a1", "new"), ("a2", "keep")]


# ---- bursts ----------------------------------------------------------------------------------


def sliding(times, limit, seconds):
    kept, out = deque(), []
    for t in times:
        while kept and kept[0] < t - seconds:
            kept.popleft()
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out


def counted(times, limit, seconds):
    opened, n, out = None, 0, []
    for t in times:
        if opened is None or t >= opened + seconds:
            opened, n = t, 0
        n += 1
        out.append(n <= limit)
    return out


def hits_of(spark, by_key):
    rows = [(k, T0 + dt.timedelta(seconds=t), i) for k, ts in by_key.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "key string, ts timestamp, n int")


@pytest.fixture(scope="module")
def busy(spark):
    rng = random.Random(3)
    # distinct times; "hot" holds most hits over many hours, with pauses of every length
    by_key = {"hot": sorted(rng.sample(range(40_000), 1500)), "calm": list(range(0, 30_000, 200)),
              "edge": list(range(0, 3600 * 4, 60)), "late": [5, 3599, 3600, 3601, 7199, 7200, 10_800, 10_860]}
    return by_key, hits_of(spark, by_key)


@pytest.mark.parametrize("limit, seconds", [(2, 60), (5, 300), (1, 60), (3, 0), (100, 60)])
def test_bursts_against_brute_force(busy, limit, seconds):
    by_key, hits = busy
    for run, plain in ((limits.burst_windows, sliding), (limits.burst_counter, counted)):
        got = {(r.key, r.n): r.accepted for r in run(hits, limit=limit, seconds=seconds).collect()}
        expected = {(k, i): ok for k, ts in by_key.items() for i, ok in enumerate(plain(ts, limit, seconds))}
        assert got == expected


def test_pieces_match_the_pauses(busy):
    by_key, hits = busy
    got = {(r.key, r.n): r._piece for r in limits.quiet_pieces(hits, "key", 60_000_000).collect()}
    for key, times in by_key.items():
        start = None
        for i, t in enumerate(times):
            if i == 0 or t - times[i - 1] > 60:
                start = t
            base = int(T0.replace(tzinfo=dt.timezone.utc).timestamp())
            assert got[(key, i)] == (base + start) * 1_000_000


def test_basic_limits(spark):
    hits = hits_of(spark, {"a": [0, 1, 2, 3, 4]})
    assert limits.burst_windows(hits, limit=5).filter("NOT accepted").count() == 0
    assert [r.accepted for r in limits.burst_windows(hits, limit=2).orderBy("ts").collect()] == [True, True, False, False, False]
    same_time = hits_of(spark, {"a": [0, 0]})
    assert limits.burst_windows(same_time, limit=1, seconds=0).filter("accepted").count() == 1


@pytest.fixture(scope="module")
def closed_stream(spark, tmp_path_factory):
    """Batches of rows as a stream, one file each, closed by a row that moves the watermark past all of them."""
    def make(batches, ts, last):
        path = str(tmp_path_factory.mktemp("closed") / "in")
        for df in [*batches, ordered.heartbeat(last, batches[0], ts)]:
            df.coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(path)
    return make


def shuffled(df, ts, seed, lateness=30):
    """Three batches in time order, but rows within ``lateness`` seconds of a cut may come in the later batch."""
    rows = df.collect()
    rng = random.Random(seed)
    rows.sort(key=lambda r: r[ts] + dt.timedelta(seconds=rng.random() * lateness))
    size = -(-len(rows) // 3)
    return [df.sparkSession.createDataFrame(rows[i:i + size], df.schema) for i in range(0, len(rows), size)]


LATER = T0 + dt.timedelta(days=40)


def test_burst_streams_equal_batch(busy, closed_stream):
    """One key holds most hits, batches overlap in time, and late hits get the verdict of the batch form."""
    _, hits = busy
    for batch, live in ((limits.burst_windows, limits.stream_burst_windows), (limits.burst_counter, limits.stream_burst_counter)):
        expected = batch(hits, limit=2, seconds=120).select("key", "ts", "accepted")
        stream = closed_stream(shuffled(hits.select("key", "ts"), "ts", 5), "ts", LATER)
        got = ingest.run_to_table(live(stream, limit=2, seconds=120), mode="append")
        assert same(expected, got.where("key is not null"))


def test_anomaly_flags_stream_equals_batch(spark, closed_stream):
    rng = random.Random(4)
    rows = [(f"s{i % 3}", T0.date() + dt.timedelta(days=i // 3), float(rng.randrange(0, 50))) for i in range(150) if i % 11]
    df = spark.createDataFrame(rows, "service string, ds date, amount double")
    expected = {(r.service, r.ds): r for r in anomaly.robust_flag(anomaly.anomaly_features(df, ["service"])).collect()}
    cut = [df.where("ds < '2026-01-20'"), df.where("ds >= '2026-01-20'")]
    live = ordered.anomaly_flags(closed_stream(cut, "ds", dt.date(2027, 1, 1)), ["service"])
    got = [r for r in ingest.run_to_table(live, mode="append").collect() if r.service]
    assert len(got) == len(expected)
    for r in got:
        want = expected[(r.service, r.ds)].asDict()
        assert {k: pytest.approx(v) if isinstance(v, float) else v for k, v in want.items()} == r.asDict()


def counters(spark, les=("",)):
    """Counters with resets and gaps, and samples on the edges of five-minute windows."""
    rng = random.Random(6)
    rows = []
    for pod in range(4):
        value = [0.0] * len(les)
        for at in sorted({rng.randrange(3600) for _ in range(70)} | {0, 300, 301, 600}):
            if rng.random() < 0.05:
                value = [0.0] * len(les)
            bump = rng.randrange(4)
            for i, le in enumerate(les):
                value[i] += bump if i else bump // 2
                rows.append((T0 + dt.timedelta(seconds=at), f"j{pod % 2}", f"p{pod}", le, value[i]))
    return spark.createDataFrame(rows, "ts timestamp, job string, pod string, le string, value double")


def test_request_rate_stream_equals_batch_at_each_window_end(spark, closed_stream):
    df = counters(spark)
    batch = df.select("ts", F.lit("http_requests_total").alias("metric"), "value", F.map_from_arrays(
        F.array(F.lit("job"), F.lit("pod")), F.array("job", "pod")).alias("labels"))
    live = ordered.request_rate(closed_stream(shuffled(df, "ts", 1), "ts", LATER), ["job"], ["pod"])
    got = {(r.job, r.window_end): r.value for r in ingest.run_to_table(live, mode="append").collect() if r.job}
    assert len(got) > 20
    expected = {}
    for end in sorted({e for _, e in got}):
        for r in metrics.request_rate(batch, end, {"job": metrics.label("job")}).collect():
            expected[(r.job, end)] = r.value
    assert got == pytest.approx(expected)


def test_bucket_quantile_stream_equals_batch(spark, closed_stream):
    df = counters(spark, ("1.0", "5.0", "+Inf"))
    batch = df.select("ts", F.lit("b").alias("metric"), "value", F.map_from_arrays(
        F.array(F.lit("job"), F.lit("pod"), F.lit("le")), F.array("job", "pod", "le")).alias("labels"))
    live = ordered.bucket_quantile(closed_stream(shuffled(df, "ts", 2), "ts", LATER), 0.7, ["job"], ["pod"], minutes=30)
    got = {(r.job, r.window_end): r.quantile for r in ingest.run_to_table(live, mode="append").collect() if r.job}
    expected = {}
    for end in sorted({e for _, e in got}):
        for r in metrics.bucket_quantile(batch, 0.7, end, 0.5, {"job": metrics.label("job")}, "b").collect():
            expected[(r.job, end)] = r.quantile
    assert len(got) >= 4 and got == pytest.approx(expected)


def test_sustained_stream_equals_batch(spark, closed_stream):
    rng = random.Random(8)
    rows = [(T0 + dt.timedelta(minutes=i), f"k{k}", 500 if (i // 9 + k) % 2 and rng.random() < 0.97 else 200, 1.0)
            for i in range(120) for k in range(2) if i % 31]
    df = spark.createDataFrame(rows, "ts timestamp, key string, status int, seconds double")
    batch = alerting.sustained(alerting.error_ratio(df, ["key"], minutes=2), ["key"], minutes=5)
    stream = closed_stream(shuffled(df, "ts", 3), "ts", LATER)
    got = ingest.run_to_table(alerting.stream_sustained(
        alerting.error_ratio(stream, ["key"], minutes=2), ["key"], minutes=5), mode="append")
    assert batch.count() > 5 and same(batch, got.where("key is not null"))


class CountedState:
    """State of one group in memory, which counts what is asked of it."""

    def __init__(self):
        self.calls, self.timers, self.of = 0, set(), {}

    def getMapState(self, name, *_):
        return CountedCell(self, name)

    getValueState = getMapState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


class CountedCell:
    def __init__(self, state, name):
        self.state, self.held = state, state.of.setdefault(name, {})

    def _do(self, do, key=(), value=None):
        self.state.calls += 1
        if do == "put":
            self.held[key] = value
        return key in self.held if do == "has" else self.held.pop(key, None) if do == "drop" else self.held.get(key)

    def updateValue(self, key, value):
        self._do("put", key, value)

    def getValue(self, key):
        return self._do("get", key)

    def containsKey(self, key):
        return self._do("has", key)

    def removeKey(self, key):
        self._do("drop", key)

    def update(self, value):
        self._do("put", (), value)

    def get(self):
        return self._do("get")

    def exists(self):
        return self._do("has")

    def clear(self):
        self._do("drop")


def replayed(processor, frames, until_ms):
    """Output and state of a processor that gets ``frames``, then a watermark behind them."""
    state = CountedState()
    processor.init(state)
    clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self: self.now, "now": 0})()
    out = [*processor.handleInputRows((0,), iter(frames), clock)]
    clock.now = until_ms
    while due := sorted(at for at in state.timers if at <= until_ms):
        state.timers.discard(due[0])
        expired = type("Expired", (), {"getExpiryTimeInMs": lambda self: due[0]})()
        out += processor.handleExpiredTimer((0,), clock, expired)
    return pd.concat(out), state


def test_a_limiter_asks_little_of_state_however_many_keys_and_slices():
    """Two buffers that overlap in time, cut into parts; thousands of (key, slice) pairs."""
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(300)}", rng.randrange(200 * 600_000_000), 0.0) for _ in range(20_000)]
    frames = [pd.DataFrame(rows[i::2], columns=["key", "at_us", "at_value"]) for i in range(2)]
    for machine in (limits.SlidingLog, limits.FixedCounter):
        processor = ordered._Limiter(["key"], 600_000_000, machine, 2, 7_200_000_000)
        got, state = replayed(processor, frames, 10**9)
        expected = []
        for key in sorted({r[0] for r in rows}):
            limiter = machine(2, 7_200_000_000)
            expected += [(key, at, limiter.hit(at)) for at in sorted(r[1] for r in rows if r[0] == key)]
        assert sorted(zip(got["key"], got["_us"], got["accepted"])) == sorted(expected)
        assert state.calls < 100 and not state.of["memory"] and not state.of["parts"]


def test_increases_ask_little_of_state_however_many_counters():
    rng = random.Random(5)
    rows = [(f"p{rng.randrange(400)}", rng.randrange(1, 10 * 300_000_000), float(rng.randrange(9))) for _ in range(8_000)]
    frames = [pd.DataFrame(rows[i::2], columns=["pod", "at_us", "at_value"]) for i in range(2)]
    got, state = replayed(ordered._Increase(["pod"], 300_000_000), frames, 10**9)
    expected, last = {}, {}
    for pod, at, value in sorted(rows):
        end = -(-at // 300_000_000)
        before = last.get((pod, end))
        step = 0.0 if before is None else value if value < before else value - before
        expected[(pod, end)] = expected.get((pod, end), 0.0) + step
        last[(pod, end)] = value
    got["end"] = (got["at"].astype("int64") // (300_000_000 if got["at"].dt.unit == "us" else 300_000_000_000)) + 1
    assert got.groupby(["pod", "end"])["increase"].sum().to_dict() == expected
    assert state.calls < 100 and not state.of["recent"]
