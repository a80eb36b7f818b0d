"""A declared schema's rules as queries that count what breaks them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def foreign_key(child: DataFrame, column: str, parent: DataFrame, key: str, name: str) -> DataFrame:
    """(rule, violations): rows whose value no parent has; a missing value breaks no foreign key."""
    held = parent.select(F.col(key).alias("__k")).distinct()
    return child.where(F.col(column).isNotNull()).join(held, child[column] == held["__k"], "left_anti").agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")


def unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")


def condition(df: DataFrame, test: str, name: str) -> DataFrame:
    """Rows for which `test` is not true: ranges, patterns, closed vocabularies, conditional rules."""
    return df.agg(F.count_if(~F.coalesce(F.expr(test), F.lit(False))).alias("violations")).select(F.lit(name).alias("rule"), "violations")


def violations(rules: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)
