"""What the corpus operators share: places for intermediate tables, checked broadcasts, word patterns."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these.
SPACES = r"[\x20\x09-\x0D]"
#: Rows and bytes up to which a side may be broadcast; larger sides are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20

_own: dict[str, str] = {}
_scopes: list[Scope] = []


class Scope:
    """Tables and folders made while it is open; all but the kept ones are deleted when it closes.  For steps whose result
    is a written table: what led there isn't read again, whatever executors are lost later."""

    def __init__(self) -> None:
        self.made: list[str] = []
        self.kept: set[str] = set()

    def __enter__(self) -> Scope:
        _scopes.append(self)
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        _scopes.remove(self)
        if kind is None:
            for path in self.made:
                if path not in self.kept:
                    delete(path)
        for outer in _scopes[-1:]:
            outer.made += self.kept

    def keep(self, table: DataFrame) -> DataFrame:
        """`table`, which `materialise` made, stays."""
        self.kept.add(table.written_at)
        return table


def delete(path: str) -> None:
    """Deletes a folder, if it is there."""
    system, at = pafs.FileSystem.from_uri(path)
    if system.get_file_info(at).type == pafs.FileType.Directory:
        system.delete_dir(at)


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: the one in spark.checkpoint.dir.  Only a local master may do
    without that setting; it gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "tmp" not in _own:
        holder = tempfile.TemporaryDirectory(prefix="tessera-")
        atexit.register(holder.cleanup)
        _own["tmp"] = "file://" + holder.name
    return _own["tmp"]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    for scope in _scopes[-1:]:
        scope.made.append(path)
    return path


def materialise(df: DataFrame, name: str, rows_in_file: int = 0) -> DataFrame:
    """`df` written as a table in the shared folder and read back: lineage ends here, and a lost executor costs only
    the tasks that it ran.  rows_in_file: bounds what a reader holds at once of a table with rows of megabytes."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_in_file).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if it has at most `limit` rows of at most `most` bytes in all, which is measured; else
    unchanged, so that the join shuffles.  `df` is to be cheap to compute twice."""
    if not df.columns:
        return df
    size = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, held = df.limit(limit + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= limit and held <= most else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def columns_for(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the columns that an operator reads; a missing one is named."""
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f"`{c}`") for c in wanted])
