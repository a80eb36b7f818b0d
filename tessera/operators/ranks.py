"""Ranks and running sums over an order, counted in ranges of it, so that no task sees the whole order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.permute import numbered

#: Rows of a range that a running sum is taken in.
RUN = 100_000


def before(rows: DataFrame, keys: list[str], value: str, weight: str, name: str = "before") -> DataFrame:
    """rows, whose values differ within `keys`, with the sum of the weights of smaller values there."""
    place = numbered(rows, keys, [value]).withColumn("__run", F.floor(F.col("place") / RUN))
    runs = place.groupBy(*keys, "__run").agg(F.sum(weight).alias("__all"))
    earlier = runs.select(*keys, "__run", (F.sum("__all").over(Window.partitionBy(*keys).orderBy("__run")) - F.col("__all")).alias("__earlier"))  # one row a range
    inside = F.sum(weight).over(Window.partitionBy(*keys, "__run").orderBy("place")) - F.col(weight)
    both = place.withColumn("__inside", inside).join(earlier, [*keys, "__run"])
    return both.withColumn(name, F.col("__earlier") + F.col("__inside")).select(*rows.columns, name)


def value_ranks(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, value, name): the mean rank, from 1, of each different value within `keys` among the rows that have one."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__t"))
    return before(counts, keys, value, "__t", "__b").select(*keys, value, (F.col("__b") + (F.col("__t") + 1) / 2).alias(name))


def midranks(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """rows with the mean rank, from 1, of each value within `keys`; a missing value has none."""
    return rows.join(value_ranks(rows, keys, value, name), [*keys, value], "left").select(*rows.columns, name)
