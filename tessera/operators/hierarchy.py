"""Ward's clustering by rounds of mutual nearest neighbours, and the rank test over groups.

Merging a pair of clusters that are nearest to each other can't change another such pair's distance downwards, so all of
them merge in one round and the tree is the one that merging the closest pair each time gives.  A cluster is its size and
centre; its distances follow from these, and none is stored.  Rounds are few where distances are scattered; points whose
gaps grow in one direction merge one by one."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranks import before
from tessera.operators.similarity import STRIPE, in_cells
from tessera.operators.tables import materialise

MERGE = "round int, kept long, gone long, height double, size long"


def _nearest(clusters: DataFrame) -> DataFrame:
    """(unit_id, other, cost): each cluster's nearest other by the increase of squared distances, ties by id."""

    def best(q: pa.Table, u: pa.Table) -> pa.Table:
        take = lambda t: (t.column("unit_id").to_numpy(), t.column("size").to_numpy().astype(float), np.asarray(t.column("v").combine_chunks().flatten(), float).reshape(t.num_rows, -1))
        (ids, n, a), (own, m, b) = take(q), take(u)
        order = np.argsort(own)
        own, m, b, out = own[order], m[order], b[order], []
        for at in range(0, len(ids), STRIPE if len(own) else len(ids) + 1):
            x, k = a[at : at + STRIPE], n[at : at + STRIPE, None]
            d2 = np.maximum((x**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * x @ b.T, 0)
            cost = np.round(k * m[None, :] / (k + m[None, :]) * d2, 12)
            cost[ids[at : at + STRIPE, None] == own[None, :]] = np.inf
            first = cost.argmin(axis=1)
            least = cost[np.arange(len(x)), first]
            good = np.isfinite(least)
            out.append((ids[at : at + STRIPE][good], own[first[good]], least[good]))
        parts = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 3
        return pa.table({"unit_id": pa.array(parts[0].astype(np.int64)), "other": pa.array(parts[1].astype(np.int64)), "cost": pa.array(parts[2].astype(float))})

    rows = in_cells(clusters, clusters, "v", "v", best, "unit_id long, other long, cost double")
    return rows.groupBy("unit_id").agg(F.min(F.struct("cost", "other")).alias("x")).select("unit_id", "x.other", "x.cost")


def ward(units: DataFrame, vec: str = "v") -> DataFrame:
    """Merges of units (unit_id, vec), as MERGE: the cluster `gone` joins `kept`, the smaller id, at `height`, the square root
    of twice the increase of squared distances to centres."""
    spark = units.sparkSession
    state = materialise(units.select(F.col("unit_id").cast("long").alias("unit_id"), F.lit(1).cast("long").alias("size"), F.col(vec).cast("array<double>").alias("v")), "ward-units")
    out, step = None, 0
    while state.limit(2).count() > 1:
        near = materialise(_nearest(state), "ward-nearest")
        back = near.select(F.col("unit_id").alias("other"), F.col("other").alias("unit_id"))
        pairs = near.join(back, ["unit_id", "other"]).where("unit_id < other").select(F.col("unit_id").alias("kept"), F.col("other").alias("gone"), "cost")
        side = lambda x: state.select(F.col("unit_id").alias(x), F.col("size").alias(f"n_{x}"), F.col("v").alias(f"v_{x}"))  # noqa: E731, B023
        both = pairs.join(side("kept"), "kept").join(side("gone"), "gone")
        size = F.col("n_kept") + F.col("n_gone")
        centre = F.zip_with("v_kept", "v_gone", lambda a, b: (a * F.col("n_kept") + b * F.col("n_gone")) / size)  # noqa: B023
        merged = materialise(both.select(F.lit(step).alias("round"), "kept", "gone", F.sqrt(2 * F.col("cost")).alias("height"), size.alias("size"), centre.alias("v")), "ward-merged")
        part = merged.select("round", "kept", "gone", "height", "size")
        out = part if out is None else out.unionByName(part)
        touched = merged.select(F.explode(F.array("kept", "gone")).alias("unit_id"))
        state = materialise(state.join(touched, "unit_id", "left_anti").unionByName(merged.select(F.col("kept").alias("unit_id"), "size", "v")), "ward-state")
        step += 1
    return spark.createDataFrame([], MERGE) if out is None else out


def cut(units: DataFrame, merges: DataFrame, clusters: int) -> DataFrame:
    """(unit_id, cluster): the `clusters` clusters before the highest merges, named by their smallest unit.  Each unit
    follows the merges to the last kept one, twice as far with every join."""
    n = units.count()
    undone = merges.orderBy(F.desc("height"), F.desc("round"), F.desc("gone")).limit(max(0, min(clusters, n) - 1)).select("gone")
    jump = merges.select("gone", "kept").join(undone, "gone", "left_anti")
    at = materialise(units.select(F.col("unit_id").cast("long").alias("unit_id")).join(jump.select(F.col("gone").alias("unit_id"), "kept"), "unit_id", "left").select("unit_id", F.coalesce("kept", "unit_id").alias("cluster")), "ward-cut")
    while True:
        next_ = at.select(F.col("unit_id").alias("cluster"), F.col("cluster").alias("further"))
        moved = materialise(at.join(next_, "cluster").select("unit_id", F.col("further").alias("cluster"), (F.col("further") != F.col("cluster")).alias("moved")), "ward-cut")
        at = moved.select("unit_id", "cluster")
        if moved.where("moved").isEmpty():
            return at


def chi_square_tail(x: float, freedom: int) -> float:
    """P(X >= x) for a chi-square variable, by the series of the incomplete gamma function, or its fraction for large x."""
    s, z = freedom / 2, x / 2
    if z <= 0:
        return 1.0
    scale = math.exp(s * math.log(z) - z - math.lgamma(s))
    if z < s + 1:
        term = total = 1 / s
        i = s
        while term > 1e-17 * total:
            i += 1
            term *= z / i
            total += term
        return 1 - scale * total
    b, c, d = z + 1 - s, 1e300, 1 / (z + 1 - s)
    h = d
    for i in range(1, 10_000):
        a = -i * (i - s)
        b += 2
        d = 1 / (a * d + b)
        c = b + a / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * h


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """(n, groups, statistic, p) of the rank test over groups with its correction for ties; rows without a group or value are
    left out.  With one group or all values equal, statistic and p are nan."""
    rows = df.where(F.col(group).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(group).alias("g"), F.col(value).cast("double").alias("x"))
    counts = rows.groupBy("g", "x").agg(F.count(F.lit(1)).alias("c"))
    values = materialise(counts.groupBy("x").agg(F.sum("c").alias("t")), "kruskal-values")
    ranks = before(values, [], "x", "t").select("x", (F.col("before") + (F.col("t") + 1) / 2).alias("rank"))
    sums = counts.join(ranks, "x").groupBy("g").agg(F.sum(F.col("c") * F.col("rank")).alias("r"), F.sum("c").alias("n"))
    n, k, s = sums.agg(F.sum("n"), F.count(F.lit(1)), F.sum(F.col("r") * F.col("r") / F.col("n"))).first()
    ties = values.agg(F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t"))).first()[0] or 0.0
    n, stat, p = n or 0, float("nan"), float("nan")
    if k > 1 and ties < float(n) ** 3 - n:
        stat = (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (float(n) ** 3 - n))
        p = chi_square_tail(stat, k - 1)
    return df.sparkSession.createDataFrame([(n, k, stat, p)], "n long, groups long, statistic double, p double")
