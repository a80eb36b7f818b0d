"""Stratified draws, the coherence of labels in a space, and a random projection that every executor knows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import cells, permute
from tessera.operators.permute import numbered
from tessera.operators.tables import materialise, maybe_broadcast

#: Steps of the hash by which a draw finds where a class's quota ends.
STEPS = 4096


def stratified(df: DataFrame, label: str, key: str, n_total: int, seed: int, least: int = 2) -> DataFrame:
    """Rows of `df` with a label: of each class its share of `n_total`, rounded half to even, at least `least` and at most all,
    the first in seeded hash order.  Counts by class and step of the hash say in which step a quota ends; only that step's
    rows are put in order, so no task sorts a class."""
    order = F.md5(F.concat_ws(":", F.lit(seed), key))
    rows = df.where(F.col(label).isNotNull()).withColumns({"__h": order, "__s": F.pmod(F.conv(F.substring(order, 1, 3), 16, 10).cast("int"), F.lit(STEPS))})
    steps = materialise(rows.groupBy(F.col(label).alias("__c"), "__s").agg(F.count(F.lit(1)).alias("k")), "draw-steps")
    by = Window.partitionBy("__c")  # at most STEPS rows a class
    total = steps.agg(F.sum("k").alias("all"))
    quota = F.least(F.col("n"), F.greatest(F.lit(least), F.rint(F.col("n") * (F.lit(float(n_total)) / F.col("all"))).cast("long")))
    ends = steps.withColumns({"n": F.sum("k").over(by), "before": F.sum("k").over(by.orderBy("__s")) - F.col("k")}).crossJoin(total).withColumn("quota", quota)  # total is one row
    ends = ends.select("__c", "__s", (F.col("quota") - F.col("before")).alias("due"), (F.col("quota") - F.col("before") >= F.col("k")).alias("whole")).where("due > 0")
    both = rows.join(maybe_broadcast(materialise(ends, "draw-ends")).withColumnRenamed("__s", "__t"), (F.col(label) == F.col("__c")) & (F.col("__s") == F.col("__t")))
    some = both.where("NOT whole").withColumn("__r", F.row_number().over(Window.partitionBy("__c", "__s").orderBy("__h", key))).where("__r <= due")
    return both.where("whole").select(df.columns).unionByName(some.select(df.columns))


def coherence(units: DataFrame, label: str, key: str, n_total: int, n_perms: int, seed: int, vec: str = "v") -> DataFrame:
    """One row (n, same, different, delta, n_same, n_different, null_mean, null_sd, z, p): how much nearer units of a label are
    to each other than to others, by mean cosine over all pairs of a stratified draw of about `n_total`, against labels
    permuted over the draw; p is two-sided.  Pairs are never formed: a class's cosines come from the sum of its unit
    vectors, and every permutation's sums are added up in one pass."""
    drawn = stratified(units.select(key, label, vec), label, key, n_total, seed)
    place = materialise(numbered(drawn.select(key, F.col(label).cast("string").alias("c"), V.l2_normalise(F.col(vec)).alias("u")), [], [key]), "coherence-draw")
    held = place.select("place", "c").toPandas().sort_values("place")  # the draw's labels: about `n_total`
    names, code = np.unique(held["c"].to_numpy(dtype=str), return_inverse=True)
    n = len(code)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cells.Open()
        for batch in (x for x in batches if x.num_rows):
            x, at = cells.matrix(batch.column("u")), batch.column("place").to_numpy()
            square = (x**2).sum(axis=1)
            for perm in range(n_perms + 1):
                member = np.eye(len(names))[code[permute.partners(at, n, perm, seed)]]
                for i, (s, q) in enumerate(zip(member.T @ x, member.T @ square, strict=True)):
                    own.add((names[i], "class", perm), 0, x.shape[1], s, np.array([q]))
            if own.size > cells.OPEN_NUMBERS:
                yield own.taken()
        if own.sums:
            yield own.taken()

    sums = materialise(cells.added(place.select("place", "u").mapInArrow(partial, cells.SUMS)), "coherence-sums")
    sizes = np.bincount(code)
    n_same, n_all = int((sizes * (sizes - 1) // 2).sum()), n * (n - 1) // 2
    whole = sums.where("perm = 0").select(F.posexplode("sums").alias("i", "x"), F.lit(0.0).alias("q")).groupBy("i").agg(F.sum("x").alias("x")).agg(F.sum(F.col("x") * F.col("x"))).first()[0] or 0.0
    own = sums.where("perm = 0").agg(F.sum(F.col("products")[0])).first()[0] or 0.0
    total = (whole - own) / 2
    by = sums.groupBy("perm").agg((F.sum(V.dot(F.col("sums"), F.col("sums")) - F.col("products")[0]) / 2).alias("t"))
    same = F.col("t") / F.lit(float(n_same)) if n_same else F.lit(0.0)
    different = (F.lit(float(total)) - F.col("t")) / F.lit(float(n_all - n_same)) if n_all > n_same else F.lit(0.0)
    rows = by.select("perm", same.alias("same"), different.alias("different")).withColumn("delta", F.round(F.col("same") - F.col("different"), 12))
    seen, nulls = rows.where("perm = 0").select("same", "different", "delta"), rows.where("perm > 0").select(F.col("delta").alias("v"))
    g = nulls.crossJoin(seen).groupBy("same", "different", "delta").agg(F.avg("v").alias("null_mean"), F.stddev_pop("v").alias("null_sd"), ((1 + F.count_if(F.abs("v") >= F.abs("delta"))) / F.lit(1 + n_perms)).alias("p"))  # seen is one row
    return g.select(F.lit(n).cast("long").alias("n"), "same", "different", "delta", F.lit(n_same).cast("long").alias("n_same"), F.lit(n_all - n_same).cast("long").alias("n_different"), "null_mean", "null_sd", ((F.col("delta") - F.col("null_mean")) / (F.col("null_sd") + 1e-12)).alias("z"), "p")


def gaussian(rows: int, columns: int, seed: int) -> np.ndarray:
    """rows x columns independent normal numbers of variance 1 / columns, each from its place and the seed alone, so that
    every task makes the same matrix and none is sent."""
    at = np.arange(rows * columns, dtype=np.int64)
    u = [(permute._mixed(permute._mixed(at % permute.PRIME, seed * 2 + i + 1), 40503) + 1) / (permute.PRIME + 1) for i in (0, 1)]
    return (np.sqrt(-2 * np.log(u[0])) * np.cos(2 * np.pi * u[1])).reshape(rows, columns) / np.sqrt(columns)


def random_projection(df: DataFrame, vec: str, columns: int, seed: int, name: str = "z") -> DataFrame:
    """df with the L2-normalised product of a vector column and `gaussian`: the control that no training went into."""
    kept = [c for c in df.columns if c != name]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = None
        for batch in (x for x in batches if x.num_rows):
            x = cells.matrix(batch.column(vec))
            if g is None:
                g = gaussian(x.shape[1], columns, seed)
            z = x @ g
            z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
            made = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * columns), pa.array(z.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], made], [*kept, name])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != name], f"`{name}` array<double>"])
    return df.select(*kept).mapInArrow(rows, schema)
