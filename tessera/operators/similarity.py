"""Neighbours and pair statistics of vectors and points."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators.tables import large, materialise, maybe_broadcast

#: Bytes of vectors on either side of a cell of a search, rows and columns of one product inside it, and columns of the first.
SIDE_BYTES, STRIPE, ACROSS, FEW = 8 << 20, 512, 2048, 256


def _groups(df: DataFrame, vec: str) -> int:
    """Into how many groups a side of a search is dealt: as its bytes ask for, and a few for the cores of any cluster."""
    n, width = df.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(vec)), F.lit(0))).first()
    return max(1, -(-n * width * 8 // SIDE_BYTES), min(4, -(-n // 2048)))


def in_cells(queries: DataFrame, units: DataFrame, vec: str, unit_vec: str, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """`work` on every cell of query groups and unit groups: each query meets every unit once, in a task that holds one group
    of either.  A side is copied once for each group of the other, so rows moved grow with both."""
    nq, nu = _groups(queries, vec), _groups(units, unit_vec)
    group = lambda n: F.pmod(F.xxhash64("unit_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("qg", group(nq)).withColumn("ug", every(nu))
    right = units.select(*[F.col(c).alias(f"__{c}") for c in units.columns], group(nu).alias("__ug"), every(nq).alias("__qg"))  # names of its own, as both sides may be one table
    cell = lambda q, u: work(q, u.rename_columns([c.removeprefix("__") for c in u.column_names]))
    return left.groupBy("qg", "ug").cogroup(right.groupBy("__qg", "__ug")).applyInArrow(cell, schema)


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _first(parts: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The first k (row, column, product) of each row, by product, rounded, then column."""
    row, col, s = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((col, -np.round(s, 12), row))
    row, col, s = row[order], col[order], s[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep], s[keep]


def _nearest(a: np.ndarray, ids: np.ndarray, b: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The first k (row, column, product) of each row of `a` among the columns of `b` but its own.  Of later columns only
    products that reach the k-th found so far are looked at, or would when rounded, so that ties stay."""
    top, least = None, np.full(len(a), -np.inf)
    edges = [0, *range(FEW, len(own), ACROSS), len(own)] if len(own) > FEW else [0, len(own)]
    for to, end in zip(edges, edges[1:], strict=False):
        s = a @ b[:, to:end]
        if top is None and s.shape[1] > 4 * k:
            least = np.partition(np.where(np.isnan(s), -np.inf, s), -k - 1, axis=1)[:, -k - 1] - 2e-12  # one may be its own
        row, col = np.nonzero(s >= least[:, None])
        other = (ids[row] != own[to + col]) & np.isfinite(s[row, col])
        row, col = row[other], col[other]
        found = (row, to + col, s[row, col])
        top = _first([found] if top is None else [top, found], k)
        full = np.flatnonzero(np.diff(np.concatenate([np.searchsorted(top[0], np.arange(len(a))), [len(top[0])]])) == k)
        least[full] = top[2][np.searchsorted(top[0], full, "right") - 1] - 2e-12
    return top


def nearest_vectors(units: DataFrame, k: int, queries: DataFrame | None = None, vec: str = "v") -> DataFrame:
    """(unit_id, pos, neighbour, similarity): the k most similar other units by cosine, ties by id.  Exact: executors pair
    groups of queries with groups of units and send k candidates for each query and group."""
    found = "unit_id long, neighbour long, similarity double"

    def best(q: pa.Table, u: pa.Table) -> pa.Table:
        ids, own, out = q.column("unit_id").to_numpy(), u.column("unit_id").to_numpy(), []
        if len(ids) and len(own):
            a, b = _matrix(q, vec), _matrix(u, vec).T
            by_id = np.argsort(own, kind="stable")
            own, b = own[by_id], b[:, by_id]
            for at in range(0, len(ids), STRIPE):
                top = _nearest(a[at : at + STRIPE], ids[at : at + STRIPE], b, own, k)
                out.append((ids[at + top[0]], own[top[1]], top[2]))
        parts = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"unit_id": pa.array(parts[0], pa.int64()), "neighbour": pa.array(parts[1], pa.int64()), "similarity": pa.array(parts[2], pa.float64())})

    asked = (units if queries is None else queries).select(F.col("unit_id").cast("long").alias("unit_id"), vec)
    rows = in_cells(asked, units.select(F.col("unit_id").cast("long").alias("unit_id"), vec), vec, vec, best, found)
    w = Window.partitionBy("unit_id").orderBy(F.round("similarity", 12).desc(), "neighbour")
    return rows.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k).select("unit_id", "pos", "neighbour", "similarity")


def purity(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """(unit_id, label, purity): share of a unit's neighbours with its label."""
    a, b = labels.select("unit_id", "label"), labels.select(F.col("unit_id").alias("neighbour"), F.col("label").alias("other"))
    return neighbours.join(a, "unit_id").join(b, "neighbour").groupBy("unit_id", "label").agg(F.avg((F.col("label") == F.col("other")).cast("double")).alias("purity"))


def retrieval(units: DataFrame, left: str, right: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, unit_id, matched, rank, n_tied, mean_other): for each unit's left vector, how its own right vector ranks among
    the right vectors of all units, or of those with its `keys`, by cosine (1 is best; ties take the best rank)."""
    keys = keys or []
    both = units.select(*keys, F.col("unit_id").cast("long").alias("unit_id"), left, F.round(V.cosine(F.col(left), F.col(right)), 12).alias("matched"))
    counted = "unit_id long, above long, tied long, total double, n long"
    code = F.xxhash64(F.to_json(F.struct(*keys))) if keys else F.lit(0).cast("long")

    def counts(q: pa.Table, u: pa.Table) -> pa.Table:
        ids, m, own = q.column("unit_id").to_numpy(), q.column("matched").to_numpy(), u.column("unit_id").to_numpy()
        kq, ku = q.column("k").to_numpy(), u.column("k").to_numpy()
        out = [np.zeros(len(ids), t) for t in (np.int64, np.int64, float, np.int64)]
        if len(ids) and len(own):
            a, b = _matrix(q, left), _matrix(u, right).T
            for at in range(0, len(ids), STRIPE):
                part = slice(at, at + STRIPE)
                for to in range(0, len(own), ACROSS):
                    some = slice(to, to + ACROSS)
                    s = np.clip(a[part] @ b[:, some], -1, 1)
                    other = (ids[part, None] != own[None, some]) & (kq[part, None] == ku[None, some])
                    apart = np.round(s, 12) - m[part, None]
                    for x, y in zip(out, ((apart > 1e-12) & other, (np.abs(apart) <= 1e-12) & other, np.where(other, s, 0), other), strict=True):
                        x[part] += y.sum(axis=1)
        return pa.table({"unit_id": pa.array(ids, pa.int64()), **{c: pa.array(x) for c, x in zip(("above", "tied", "total", "n"), out, strict=True)}})

    asked = both.select("unit_id", left, "matched", code.alias("k"))
    rows = in_cells(asked, units.select(F.col("unit_id").cast("long").alias("unit_id"), right, code.alias("k")), left, right, counts, counted)
    g = rows.groupBy("unit_id").agg((1 + F.sum("above")).alias("rank"), F.sum("tied").alias("n_tied"), (F.sum("total") / F.sum("n")).alias("mean_other"))
    return both.select(*keys, "unit_id", "matched").join(g, "unit_id").select(*keys, "unit_id", "matched", "rank", "n_tied", "mean_other")


def retrieval_baselines(ranks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mrr, r1, r5, random_mrr, random_r1, random_r5) of ranks within keys, beside what a random order gives."""
    at = lambda k: F.avg((F.col("rank") <= k).cast("double")).alias(f"r{k}")
    g = ranks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(1 / F.col("rank")).alias("mrr"), at(1), at(5))
    harmonic = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("n")), F.lit(0.0), lambda s, i: s + 1 / i)
    chance = lambda k: F.least(F.lit(1.0), F.lit(float(k)) / F.col("n")).alias(f"random_r{k}")
    return g.select(*keys, "n", "mrr", "r1", "r5", (harmonic / F.col("n")).alias("random_mrr"), chance(1), chance(5))


def retrieval_metrics(ranks: DataFrame) -> DataFrame:
    at = lambda k: F.avg((F.col("rank") <= k).cast("double")).alias(f"r{k}")
    return ranks.agg(F.count(F.lit(1)).alias("n"), F.avg(1 / F.col("rank")).alias("mrr"), at(1), at(5), at(10), F.median("rank").alias("median_rank"), (F.avg("matched") - F.avg("mean_other")).alias("gap"), F.sum("n_tied").alias("n_tied"))


def pair_sums(units: DataFrame, keys: list[str], vec: str = "v") -> DataFrame:
    """(keys, n, pairs, total): the sum of cosines over all unordered pairs of units that share `keys`, from the sum of
    their unit vectors: the pairs' cosines add up to (|sum|^2 - sum of |v|^2) / 2, so no pair is ever formed."""
    unit = units.select(*keys, V.l2_normalise(F.col(vec)).alias("__u"))
    sums = V.by_dimension(unit, keys, "__u", "sum").groupBy(*keys).agg(F.sum(F.col("value") * F.col("value")).alias("square"))
    sizes = unit.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(V.dot(F.col("__u"), F.col("__u"))).alias("own"))
    both = sums.join(sizes, keys) if keys else sums.crossJoin(sizes)  # one row each
    return both.select(*keys, "n", (F.col("n") * (F.col("n") - 1) / 2).alias("pairs"), ((F.col("square") - F.col("own")) / 2).alias("total"))


def _folded(units: DataFrame, keys: list[str], name: str) -> DataFrame:
    return pair_sums(units, keys).agg(F.coalesce(F.sum("pairs"), F.lit(0.0)).alias(f"{name}_n"), F.coalesce(F.sum("total"), F.lit(0.0)).alias(f"{name}_t"))


def label_delta(units: DataFrame, label: str, subject: str) -> DataFrame:
    """(same, different, delta): mean cosine of pairs across subjects with the same label, less that with different ones.
    Units without a label are left out.  By inclusion and exclusion over four groupings."""
    valid = units.where(F.col(label).isNotNull())
    parts = [_folded(valid, [], "a"), _folded(valid, [label], "l"), _folded(valid, [subject], "s"), _folded(valid, [label, subject], "b")]
    row = parts[0].crossJoin(parts[1]).crossJoin(parts[2]).crossJoin(parts[3])  # one row each
    same = (F.col("l_t") - F.col("b_t")) / (F.col("l_n") - F.col("b_n"))
    different = (F.col("a_t") - F.col("l_t") - F.col("s_t") + F.col("b_t")) / (F.col("a_n") - F.col("l_n") - F.col("s_n") + F.col("b_n"))
    return row.select(same.alias("same"), different.alias("different"), (same - different).alias("delta"))


def subject_delta(units: DataFrame, subject: str) -> DataFrame:
    """(same, different, delta): mean cosine within subjects less that between them."""
    row = _folded(units, [], "a").crossJoin(_folded(units, [subject], "s"))  # one row each
    same, different = F.col("s_t") / F.col("s_n"), (F.col("a_t") - F.col("s_t")) / (F.col("a_n") - F.col("s_n"))
    return row.select(same.alias("same"), different.alias("different"), (same - different).alias("delta"))


def mean_pool_l2(units: DataFrame, keys: list[str], vec: str = "v") -> DataFrame:
    """(keys, v): mean of the unit vectors, scaled to length one; the zero vector stays zero."""
    unit = units.select(*keys, V.l2_normalise(F.col(vec)).alias("__u"))
    return V.collected(V.by_dimension(unit, keys, "__u"), keys).select(*keys, V.l2_normalise(F.col("v")).alias("v"))


#: Halvings of a sample's box, and how many widths of its bulk the box reaches beyond it; what lies farther counts to the
#: outermost cells, which are open outwards.
DEPTH, REACH = 30, 4096


def _spread(c: Column) -> Column:
    """The bits of a number below 2^30 at every other place."""
    for by, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = c.bitwiseOR(F.shiftleft(c, by)).bitwiseAND(F.lit(mask))
    return c


def _shared_level(a: Column, b: Column) -> Column:
    """The finest level on which two cell codes are in one cell."""
    x = a.bitwiseXOR(b)
    return F.floor((2 * DEPTH - F.when(x == 0, 0).otherwise(F.length(F.bin(x)))) / 2).cast("int")


def _located(known: DataFrame, k: int) -> DataFrame:
    """(sample_id, x, y, ids, ix, iy, side, level): distinct places with their k + 1 smallest ids, which are all that any
    unit can have as neighbours there, cell numbers on the finest grid, and the finest level on which the place's cell holds
    k + 1 places."""
    by = Window.partitionBy("sample_id", "x", "y").orderBy("unit_id")  # each task keeps k + 1 of a place before the shuffle
    few = known.withColumn("__r", F.row_number().over(by)).where(F.col("__r") <= k + 1)
    places = few.groupBy("sample_id", "x", "y").agg(F.array_sort(F.collect_list("unit_id")).alias("ids"))
    box = places.groupBy("sample_id").agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("least", F.min), ("most", F.max))], *[F.percentile_approx(c, [0.01, 0.99], 1000).alias(f"bulk_{c}") for c in "xy"])
    width = F.greatest(*[F.col(f"bulk_{c}")[1] - F.col(f"bulk_{c}")[0] for c in "xy"])
    reach = F.when(width > 0, width * REACH).otherwise(F.lit(float("inf")))
    low = {c: F.greatest(F.col(f"least_{c}"), F.col(f"bulk_{c}")[0] - reach) for c in "xy"}
    high = {c: F.least(F.col(f"most_{c}"), F.col(f"bulk_{c}")[1] + reach) for c in "xy"}
    side = F.greatest(*[high[c] - low[c] for c in "xy"]) * (1 + 1e-9) + 1e-300
    boxes = box.select("sample_id", low["x"].alias("x0"), low["y"].alias("y0"), side.alias("side"))  # one row a sample
    last = (1 << DEPTH) - 1
    at = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(float(last)), F.floor((F.col(c) - F.col(f"{c}0")) / F.col("side") * float(1 << DEPTH)).cast("double"))).cast("long")
    celled = places.join(large(boxes), "sample_id").select("sample_id", "x", "y", "ids", at("x").alias("ix"), at("y").alias("iy"), "side")
    coded = celled.withColumn("code", _spread(F.col("ix")).bitwiseOR(F.shiftleft(_spread(F.col("iy")), 1)))
    order = Window.partitionBy("sample_id").orderBy("code")
    run = coded.withColumn("__l", _shared_level(F.col("code"), F.lead("code", k).over(order)))
    level = F.coalesce(F.max("__l").over(order.rowsBetween(-k, 0)), F.lit(0))
    return run.withColumn("level", level).drop("__l", "code")


def _around(due: DataFrame, places: DataFrame) -> DataFrame:
    """Pairs of `due` places and places in the nine cells of their level around them."""
    cell = lambda c: F.call_function("shiftright", F.col(c), F.lit(DEPTH) - F.col("level"))
    shifts = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("s")
    look = due.select("sample_id", "place", "x", "y", "level", "side", cell("ix").alias("cx"), cell("iy").alias("cy"), shifts).withColumns({"cx": F.col("cx") + F.col("s.i"), "cy": F.col("cy") + F.col("s.j")}).drop("s")
    levels = maybe_broadcast(due.groupBy("sample_id").agg(F.collect_set("level").alias("levels")))  # at most DEPTH a sample
    held = large(places).join(levels, "sample_id").select("sample_id", F.explode("levels").alias("level"), "ix", "iy", F.col("x").alias("nx"), F.col("y").alias("ny"), "ids")
    rows = held.select("sample_id", "level", cell("ix").alias("cx"), cell("iy").alias("cy"), "nx", "ny", "ids")
    return look.join(large(rows), ["sample_id", "level", "cx", "cy"])


def _searched(due: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """`due` places with `near`, the k + 1 nearest ids as (d2, id) in order, among the nine cells of their level around them,
    and whether nothing outside can be nearer."""
    near = _around(due, places)
    d2 = (F.col("x") - F.col("nx")) * (F.col("x") - F.col("nx")) + (F.col("y") - F.col("ny")) * (F.col("y") - F.col("ny"))
    rows = near.select("sample_id", "place", "level", "side", d2.alias("d2"), F.explode("ids").alias("id"))
    best = Window.partitionBy("sample_id", "place").orderBy("d2", "id")
    top = rows.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    g = top.groupBy("sample_id", "place").agg(F.array_sort(F.collect_list(F.struct("d2", "id"))).alias("near"), F.first("level").alias("level"), F.first("side").alias("side"), F.max("d2").alias("far"))
    size = F.col("side") / F.pow(F.lit(2.0), F.col("level"))
    return g.select("sample_id", "place", "near", ((F.col("level") == 0) | ((F.size("near") == k + 1) & (F.col("far") <= size * size))).alias("settled"))


def spatial_neighbours(spots: DataFrame, k: int) -> DataFrame:
    """(sample_id, unit_id, pos, neighbour): the unit itself at 0 and its k nearest others in the sample, by distance, then
    id.  Units at one place share a search, for the k + 1 smallest ids there.  A place looks into the nine cells around it
    on the finest of the halved grids on which its own cell holds k + 1 places; if the farthest found is farther than a
    cell, once more on the next coarser grid, where that can't be.  So the result is exact, cells follow the local density,
    a point far out or a heap of points changes no other unit's cost, and no sample is crossed with itself.  Units without
    finite coordinates have only themselves and are nobody's neighbour."""
    spots = spots.select("sample_id", "unit_id", (F.col("x").cast("double") + 0.0).alias("x"), (F.col("y").cast("double") + 0.0).alias("y"))
    known = spots.where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))  # neither null nor nan nor infinite
    places = materialise(_located(known, k).withColumn("place", F.monotonically_increasing_id()), "places")
    first = materialise(_searched(places, places, k), "neighbours")
    again = places.join(large(first.where("NOT settled").select("sample_id", "place")), ["sample_id", "place"], "left_semi").withColumn("level", F.greatest(F.col("level") - 1, F.lit(0)))
    lists = first.where("settled").select("sample_id", "place", "near").unionByName(_searched(again, places, k).select("sample_id", "place", "near"))
    found = lists.join(large(places.select("sample_id", "place", "x", "y")), ["sample_id", "place"]).select("sample_id", "x", "y", "near")
    own = F.slice(F.filter("near", lambda s: s["id"] != F.col("unit_id")), 1, k)
    rows = known.join(large(found), ["sample_id", "x", "y"]).select("sample_id", "unit_id", F.posexplode(own).alias("pos", "s"))
    return rows.select("sample_id", "unit_id", (F.col("pos") + 1).alias("pos"), F.col("s.id").alias("neighbour")).unionByName(spots.select("sample_id", "unit_id", F.lit(0).alias("pos"), F.col("unit_id").alias("neighbour")))
