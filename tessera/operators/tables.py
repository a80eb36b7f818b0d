"""Intermediate tables in a folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Only a local master may do without that setting; it gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "tmp" not in _own:
        holder = tempfile.TemporaryDirectory(prefix="tessera-")
        atexit.register(holder.cleanup)
        _own["tmp"] = "file://" + holder.name
    return _own["tmp"]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """`df` written and read back, so that loops don't run their earlier rounds again."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """`df`, a side that grows with the units, so that its join shuffles.  Spark takes an exploded row for one row and a
    column of a compressed file for a few bytes, and would send such sides through the driver."""
    return df.hint("merge")


def shuffled_if_large(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """`df`, a side that needn't grow with the units, told to shuffle only if it has more than `rows` rows."""
    return large(df) if df.limit(rows + 1).count() > rows else df


#: Rows of one task of a shuffle that is dealt by rows.
TASK_ROWS = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """`df`, shuffled by `keys` into tasks of about TASK_ROWS of `rows`, however many partitions the session sets, so that a
    task's sorts and hash tables don't grow with the input.  What fits a few tasks is left as it is."""
    n, spark = -(-rows // TASK_ROWS), df.sparkSession
    return df.repartition(max(n, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys) if n > 4 else df


def maybe_broadcast(df: DataFrame, rows: int = 200_000, most: int = 64 << 20) -> DataFrame:
    """`df`, a written table, with a broadcast hint if it is small in rows and bytes, which is measured; else unchanged."""
    if not df.columns:
        return df
    size = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, held = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= most else df
