"""Column functions on vectors (arrays of numbers).  Arithmetic is in double, whatever the storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalise(v: Column, eps: float = 1e-12, policy: str = "clip") -> Column:
    """policy: clip divides by max(norm, eps); keep leaves vectors below eps as they are; add divides by norm + eps."""
    n = norm(v)
    by = {"clip": F.greatest(n, F.lit(eps)), "keep": F.when(n < eps, 1.0).otherwise(n), "add": n + eps}[policy]
    return F.transform(v, lambda x: x.cast("double") / by)


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    c = dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


def midpoint(a: Column, b: Column) -> Column:
    """Mean of two views, not normalised again."""
    return F.zip_with(a, b, lambda x, y: (x.cast("double") + y.cast("double")) * 0.5)


def nan_to_null(v: Column) -> Column:
    """Spark's averages skip null but not nan."""
    return F.transform(v, lambda x: F.when(~F.isnan(x.cast("double")), x))


def has_missing(v: Column) -> Column:
    return F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")))


def uniform_if_missing(v: Column, k: int) -> Column:
    """A row of weights with a missing element becomes 1 / k each."""
    return F.when(has_missing(v), F.array_repeat(F.lit(1.0 / k), k)).otherwise(F.transform(v, lambda x: x.cast("double")))


def by_dimension(df: DataFrame, keys: list[str], vec: str, how: str = "avg") -> DataFrame:
    """(keys, dim, value): a vector aggregate by key and dimension, null elements skipped, combined before the shuffle."""
    long = df.select(*keys, F.posexplode(vec).alias("dim", "x"))
    return long.groupBy(*keys, "dim").agg(getattr(F, how)(F.col("x").cast("double")).alias("value"))


def collected(long: DataFrame, keys: list[str], name: str = "v") -> DataFrame:
    """by_dimension's rows as one array for each key; its length is the dimension, whatever the number of rows."""
    made = long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("__v"))
    return made.select(*keys, F.transform("__v", lambda x: x["value"]).alias(name))
