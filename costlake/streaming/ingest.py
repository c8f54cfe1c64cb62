"""Sync tasks, running cost totals and checks of arriving charges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.query import StreamingQuery

from costlake.operators.anomaly import zscore_check
from costlake.operators.joins import join_dimension
from costlake.schemas import SYNC_TASK
from costlake.session import scratch_path

#: The task types a worker understands, and days pulled unless a task says otherwise.
TASK_TYPES = ("sync_account", "sync_all")
DEFAULT_SYNC_DAYS = 30

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sync_tasks(messages: DataFrame, body: str = "value") -> DataFrame:
    """Parse JSON task messages (batch or stream); unknown types are routed to ``dropped``."""
    task = F.from_json(F.col(body).cast("string"), SYNC_TASK)
    kind = F.coalesce("t.type", F.lit("unknown"))
    others = [c for c in messages.columns if c != body]
    return messages.select(*others, task.alias("t")).select(
        *others, kind.alias("type"),
        F.when(kind.isin(*TASK_TYPES), kind).otherwise("dropped").alias("route"),
        F.col("t.account_id").alias("account_id"),
        F.col("t.organization_id").alias("organization_id"),
        F.coalesce("t.days", F.lit(DEFAULT_SYNC_DAYS)).alias("days"),
    )


def once(messages: DataFrame, key: str, ts: str, lateness: str = "1 hour") -> DataFrame:
    """Each message of a stream once, however often its queue delivers it.

    A key is remembered until the watermark is ``lateness`` past the message's own time; what is delivered
    again after that is behind the watermark and dropped as late, so nothing passes twice at any time.
    """
    return messages.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def accounts_to_sync(tasks: DataFrame, accounts: DataFrame) -> DataFrame:
    """The accounts each routed task asks for: one by id, or all active ones of a tenant.

    An account asked for more than once is synced once, for the longest period.
    """
    one = tasks.filter(F.col("route") == "sync_account").select(
        F.col("account_id").alias("id"), "days")
    every = tasks.filter(F.col("route") == "sync_all").select("organization_id", "days")
    # repeats go before the joins, so that a tenant asked for again and again is expanded once
    one = one.groupBy("id").agg(F.max("days").alias("days"))
    every = every.groupBy("organization_id").agg(F.max("days").alias("days"))
    named = accounts.select("id", "organization_id", "provider", "is_active")
    columns = ["id", "organization_id", "provider", "days"]
    by_id = named.join(one, "id").select(*columns)
    by_org = named.filter("is_active").join(every, "organization_id").select(*columns)
    return by_id.unionByName(by_org).groupBy(*columns[:3]).agg(F.max("days").alias("days"))


def run_sync_tasks(
    stream: DataFrame, accounts: DataFrame, sync: Callable[[DataFrame, int], None],
    checkpoint: str, body: str = "value",
) -> StreamingQuery:
    """Hand the accounts of every micro-batch to ``sync(accounts, batch_id)``.

    A batch is handed over again if its executors or driver are lost before it ends; ``sync`` must
    be idempotent, which replacing a window is.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        sync(accounts_to_sync(sync_tasks(batch, body), accounts), batch_id)

    return (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_costs(
    records: DataFrame, accounts: DataFrame, lateness: str = "7 days"
) -> DataFrame:
    """Daily totals per tenant and service, kept up to date as charges arrive.

    Works on a batch frame as well, where the watermark has no effect.
    """
    side = accounts.select(F.col("id").alias("cloud_account_id"), "organization_id")
    joined = join_dimension(records.withWatermark("date", lateness), side, "cloud_account_id")
    return joined.groupBy(
        "organization_id", "service", F.window("date", "1 day").alias("w")
    ).agg(F.sum("amount").alias("amount"), F.count("*").alias("records")).select(
        "organization_id", "service", F.to_date("w.start").alias("ds"), "amount", "records"
    )


def stream_zscore(records: DataFrame, baseline: DataFrame, on: list[str]) -> DataFrame:
    """Check arriving charges against stored baselines (stream-static join)."""
    return zscore_check(records, baseline, on)


def run_to_table(
    result: DataFrame, keys: list[str] | None = None, mode: str = "update", again: Callable[[], None] | None = None,
) -> DataFrame:
    """Run a stream over all available input and return what it wrote.

    With ``again``, which adds input, the stream is then started once more from its checkpoint.

    Every micro-batch is one folder, named by its id and overwritten if the batch is run again, so
    a restart cannot write twice.  With ``keys``, the last update of each key wins.
    """
    spark: SparkSession = result.sparkSession
    out = scratch_path(spark, "stream")
    data = f"{out}/data"

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{data}/batch_id={batch_id}")

    # large state lives off the heap, and timers and state variables need this store
    previous = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    # an input without rows runs no batch: the table exists all the same
    spark.createDataFrame([], result.schema).write.parquet(f"{data}/batch_id=-1")
    try:
        for more in ([None, again] if again else [None]):
            if more:
                more()
            query = (
                result.writeStream.outputMode(mode).foreachBatch(store)
                .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
            )
            query.awaitTermination()
    finally:
        spark.conf.set(_STORE, previous) if previous else spark.conf.unset(_STORE)
    schema = T.StructType(result.schema.fields + [T.StructField("batch_id", T.LongType())])
    written = spark.read.schema(schema).parquet(data)
    if keys is None:
        return written.drop("batch_id")
    rest = [c for c in result.columns if c not in keys]
    latest = written.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), "batch_id").alias("_row")
    )
    return latest.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c)
                           for c in result.columns])
