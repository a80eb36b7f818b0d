"""Status of shards from the append-only record of what happened to them, kept up as a stream.

A shard is a unit of work that is tried up to `attempts` times: done once any of its records says so, failed after that many
failures without one, otherwise running or, after a failure, waiting to be tried again.  One that has been neither done nor
failed for `silent` milliseconds of event time has stalled, which no record says: each row carries the time at which it is
due, and who reads it compares that with the latest time seen.  State is one row of aggregates a shard, which executors keep
without calling Python, and doesn't depend on the order of records; a restart goes on from the checkpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of records that the status depends on; any other only shows that the shard is alive.
DONE, FAILED = "done", "failed"
STATUS = "shard string, status string, failures int, last_ms long, due long, clock long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def statuses(records: DataFrame, attempts: int = 3, silent: int = 3_600_000, late: str = "10 minutes") -> DataFrame:
    """A stream of STATUS rows, each time a shard has news.  records: a stream (shard, id, ts, kind); those without shard or
    time are left out, an absent kind shows life, an absent id comes before others of that time.  A shard that hasn't ended
    stalls when the largest `clock` of all shards, the latest time less `late`, reaches its `due`.  Records that come late
    count like others, as a shard's state is never let go."""
    rows = records.where("shard IS NOT NULL AND ts IS NOT NULL")
    is_ = lambda k: F.coalesce(F.col("kind") == k, F.lit(False))
    known = rows.select(F.col("shard").cast("string").alias("shard"), F.unix_millis("ts").alias("ms"), F.unix_millis(F.col("ts") - F.lit(late).cast("interval")).alias("clock"), F.coalesce(F.col("id").cast("long"), F.lit(-1)).alias("id"), is_(DONE).alias("done"), is_(FAILED).alias("failed"))
    last = F.max(F.struct("ms", "id", "failed")).alias("last")
    state = known.groupBy("shard").agg(F.bool_or("done").alias("done"), F.count_if("failed").cast("int").alias("failures"), last, F.max("clock").alias("clock"))
    ended = F.when(F.col("done"), "done").when(F.col("failures") >= attempts, "failed")
    status = F.coalesce(ended, F.when(F.col("last.failed"), "retry").otherwise("running"))
    return state.select("shard", status.alias("status"), "failures", F.col("last.ms").alias("last_ms"), F.when(ended.isNull(), F.col("last.ms") + silent).alias("due"), "clock")


def run(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that is there now, with the latest row of each shard from this run and those before it under the same checkpoint.
    Each batch writes a folder of its own, so one that is repeated after a loss replaces what it wrote."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    spark, name = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        q = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return latest(spark.read.schema(f"{STATUS}, batch long").parquet(path))


def latest(rows: DataFrame) -> DataFrame:
    """(shard, status, failures, last_ms) of each shard's last batch; those due by the clock of all rows have stalled."""
    held = rows.groupBy("shard").agg(F.max_by(F.struct("status", "failures", "last_ms", "due"), "batch").alias("r"))
    both = held.crossJoin(F.broadcast(rows.agg(F.max("clock").alias("now"))))  # now is one row
    status = F.when(F.col("r.due") <= F.col("now"), "stalled").otherwise(F.col("r.status"))
    return both.select("shard", status.alias("status"), "r.failures", "r.last_ms")


def verdict(n: Column, done: Column, failed: Column, threshold: float) -> Column:
    """refuse: some shards ended and none of them well, which is the setup's fault; ask: more than `threshold` of all shards
    failed; else go on."""
    return F.when((failed > 0) & (done == 0), "refuse").when(failed > threshold * n, "ask").otherwise("go_on")


def report(status: DataFrame, threshold: float, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, done, failed, stalled, open, failure_share, verdict) of rows with a status; one row without keys, whose
    share is null if there are no shards."""
    keys = keys or []
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    sums = status.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), is_("done").alias("done"), is_("failed").alias("failed"), is_("stalled").alias("stalled"), is_("running", "retry").alias("open"))
    share = F.when(F.col("n") > 0, F.col("failed") / F.col("n"))
    return sums.withColumns({"failure_share": share, "verdict": verdict(F.col("n"), F.col("done"), F.col("failed"), threshold)})
