"""Append-only records: stable ids, deduplication, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stable_id(*parts: str) -> Column:
    """The first twelve hex digits of the SHA-256 of the parts as JSON, sorted by name; equal content has equal ids, and
    neither a missing part nor where one part ends can be mistaken."""
    row = F.struct(*[F.col(p).cast("string").alias(p) for p in sorted(parts)])
    return F.substring(F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256), 1, 12)


def append_new(ledger: DataFrame, records: DataFrame, told_apart: tuple[str, ...] = ()) -> DataFrame:
    """ledger and those records whose record_id it lacks, one of each.  An id is a shortened hash, so different content can
    have the same; records that differ in `told_apart` are both new."""
    return ledger.unionByName(records.dropDuplicates(["record_id", *told_apart]).join(ledger.select("record_id"), "record_id", "left_anti").select(ledger.columns))


def summary(records: DataFrame) -> DataFrame:
    """(kind, step, status, n, duration, untimed): by the step's part before `::`; a missing duration is untimed, not 0."""
    return records.groupBy("kind", F.substring_index("step", "::", 1).alias("step"), "status").agg(F.count(F.lit(1)).alias("n"), F.sum("duration").alias("duration"), F.count_if(F.col("duration").isNull()).alias("untimed"))


def last(records: DataFrame, n: int) -> DataFrame:
    return records.orderBy(F.col("at").desc(), F.col("record_id")).limit(n)


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__i = 1").drop("__i")
