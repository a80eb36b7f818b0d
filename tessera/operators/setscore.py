"""Scores of feature sets over sparse counts (sample_id, unit_id, gene, count); a gene without a row counts zero."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.operators.tables import dealt, large, materialise, maybe_broadcast, shuffled_if_large

UNIT = ["sample_id", "unit_id"]


def count_statistics(counts: DataFrame) -> DataFrame:
    """(n_obs, n_vars, median_total, median_detected, sparsity, integer)."""
    units = counts.groupBy(*UNIT).agg(F.sum("count").alias("total"), F.count_if(F.col("count") > 0).alias("detected"))
    per = units.agg(F.count(F.lit(1)).alias("n_obs"), F.median("total").alias("median_total"), F.median("detected").alias("median_detected"))
    whole = counts.agg(F.countDistinct("gene").alias("n_vars"), F.count_if(F.col("count") > 0).alias("nnz"), F.every(F.col("count") == F.floor("count")).alias("integer"))
    row = per.crossJoin(whole)  # one row each
    return row.select("n_obs", "n_vars", "median_total", "median_detected", (1 - F.col("nnz") / (F.col("n_obs") * F.col("n_vars"))).alias("sparsity"), "integer")


def marker_expression(counts: DataFrame, genes: DataFrame) -> DataFrame:
    """(gene, mean, percent): over all units, zeros included; markers that are not found are left out."""
    n = counts.select(*UNIT).distinct().agg(F.count(F.lit(1)).alias("units"))
    found = counts.join(F.broadcast(genes.limit(10_000)), "gene", "left_semi") if genes.limit(10_001).count() <= 10_000 else counts.join(genes, "gene", "left_semi")
    sums = found.groupBy("gene").agg(F.sum("count").alias("s"), F.count_if(F.col("count") > 0).alias("nz"))
    return sums.crossJoin(n).select("gene", (F.col("s") / F.col("units")).alias("mean"), (100 * F.col("nz") / F.col("units")).alias("percent"))  # n is one row


def drop_matching(counts: DataFrame, pattern: str) -> DataFrame:
    """Without genes whose name begins with a match of `pattern`."""
    return counts.where(~F.col("gene").rlike(f"^(?:{pattern})"))


def gene_axis(counts: DataFrame, mapping: DataFrame, how: str, unmapped: str) -> DataFrame:
    """Counts on another gene axis: version suffixes go, ids are mapped, unmapped ones dropped or kept under their own
    id, and rows combined: sum; mean, by the number of ids that map to the symbol, zeros included; or first by id."""
    plain = counts.withColumn("id", F.substring_index("gene", ".", 1))
    joined = plain.join(shuffled_if_large(mapping.select(F.col("gene").alias("id"), "symbol").dropDuplicates(["id"])), "id", "left")
    joined = joined.where("symbol IS NOT NULL") if unmapped == "drop" else joined.withColumn("symbol", F.coalesce("symbol", "id"))
    grouped = dealt(joined, counts.count(), *UNIT).groupBy(*UNIT, "symbol")
    if how == "first":
        return grouped.agg(F.min_by("count", "id").alias("count"))
    out = grouped.agg(F.sum("count").alias("count"))
    if how == "mean":
        ids = joined.groupBy("symbol").agg(F.countDistinct("gene").alias("ids"))
        out = out.join(ids, "symbol").withColumn("count", F.col("count") / F.col("ids")).drop("ids")
    return out.select(*UNIT, "symbol", "count")


def member_sums(members: DataFrame, counts: DataFrame, k: int = 2) -> DataFrame:
    """(sample_id, unit_id, gene, count): raw counts added up over the members of each unit's niche, about k + 1."""
    return _of_members(members, counts, "count", k).groupBy(*UNIT, "gene").agg(F.sum("count").alias("count"))


def _of_members(members: DataFrame, values: DataFrame, value: str, k: int) -> DataFrame:
    """(sample_id, unit_id, gene, value): the members' rows, dealt by unit, so that what is done by unit needs no other shuffle
    and no task holds more rows as there are more."""
    n = values.count()
    rows = values.select("sample_id", F.col("unit_id").alias("member"), "gene", value)
    pulled = dealt(members, n, "sample_id", "member").join(dealt(rows, n, "sample_id", "member"), ["sample_id", "member"]).select(*UNIT, "gene", value)
    return dealt(pulled, (k + 1) * n, *UNIT)


def log_normalise(counts: DataFrame, target: float, floor: float = 1.0) -> DataFrame:
    """log1p(count * target / max(library, floor)) within a unit."""
    library = F.sum("count").over(Window.partitionBy(*UNIT))
    known = counts.where(" AND ".join(f"{c} IS NOT NULL" for c in UNIT))
    return known.withColumn("value", F.log1p(F.col("count") * target / F.greatest(library, F.lit(floor))))


def log_normalised_lists(counts: DataFrame, target: float, rows: int, floor: float = 1.0) -> DataFrame:
    """(sample_id, unit_id, l): `log_normalise` as one list (gene, value) a unit, from one aggregate of `rows` counts."""
    known = counts.where(" AND ".join(f"{c} IS NOT NULL" for c in UNIT))
    held = dealt(known, rows, *UNIT).groupBy(*UNIT).agg(F.sum("count").alias("library"), F.collect_list(F.struct("gene", "count")).alias("c"))
    scale = F.greatest(F.col("library"), F.lit(floor))
    return held.select(*UNIT, F.transform("c", lambda x: F.struct(x["gene"].alias("gene"), F.log1p(x["count"] * target / scale).alias("value"))).alias("l"))


def niche_qc(counts: DataFrame, least_total: float, least_detected: int) -> DataFrame:
    """(sample_id, unit_id, total, detected, cause): the first gate that a unit fails, null if none."""
    u = counts.groupBy(*UNIT).agg(F.sum("count").alias("total"), F.count_if(F.col("count") > 0).alias("detected"))
    return u.withColumn("cause", F.when(F.col("total") < least_total, "total").when(F.col("detected") < least_detected, "detected"))


def _niche_rows(members: DataFrame, values: DataFrame, k: int, rows: int | None) -> DataFrame:
    """(sample_id, unit_id, gene, value): the members' rows, those of a unit one after another in one task.  Until they are
    there a member's rows travel as one list, so that what is joined, shuffled and sorted is k + 1 rows a unit."""
    n = values.count() if rows is None else rows
    if "l" not in values.columns:
        values = values.select(*UNIT, F.struct("gene", F.col("value").cast("double").alias("value")).alias("r")).groupBy(*UNIT).agg(F.collect_list("r").alias("l"))
    pulled = dealt(members, n, "sample_id", "member").join(large(values.withColumnRenamed("unit_id", "member")), ["sample_id", "member"]).select(*UNIT, "l")
    by_unit = dealt(pulled, (k + 1) * n, *UNIT)
    by_unit = pulled.repartition(*UNIT) if by_unit is pulled else by_unit
    return by_unit.sortWithinPartitions(*UNIT).select(*UNIT, F.inline("l"))


def _whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables that end where a unit ends."""
    held: list[pa.RecordBatch] = []
    for batch in (b for b in batches if b.num_rows):
        same = lambda row: np.logical_and.reduce([pc.equal(batch.column(c), row.column(c)[-1]).to_numpy(zero_copy_only=False) for c in UNIT])  # noqa: E731, B023
        if held and not same(held[-1])[0]:
            yield pa.Table.from_batches(held)
            held = []
        cut = batch.num_rows - int(same(batch).sum())
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _spread_of(values: np.ndarray, groups: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each of n groups (of values side by side), filled up to `least` with zeros: the sum over `least`, and the median
    absolute deviation from the median over that."""
    size = np.bincount(groups, minlength=n)
    pos, width = np.arange(len(groups)) - (np.cumsum(size) - size)[groups], np.maximum(size, least)
    mean, ratio, place = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
    middle = lambda x: (x[:, (x.shape[1] - 1) // 2] + x[:, x.shape[1] // 2]) / 2
    for w in np.unique(width):  # one, unless a member has several rows of a gene
        some = np.flatnonzero(width == w)
        place[some] = np.arange(len(some))
        f, inside = np.zeros((len(some), w)), width[groups] == w
        f[place[groups[inside]], pos[inside]] = values[inside]
        f.sort(axis=1)
        total = np.zeros(len(some))
        for j in range(w):
            total += f[:, j]
        mean[some] = total / least
        ratio[some] = middle(np.sort(np.abs(f - middle(f)[:, None]), axis=1)) / (mean[some] + 1e-9)
    return mean, ratio


def _gene_statistics(rows: pa.Table, k: int) -> tuple[np.ndarray, ...]:
    """(unit, gene, first, mean, ratio) by unit and gene of the rows of whole units: the unit's number, the gene's place in
    the order of genes, one of their rows."""
    apart = [pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in (rows.column(u).combine_chunks() for u in UNIT)]
    unit = np.concatenate([[0], np.cumsum(np.logical_or.reduce(apart))])
    coded = rows.column("gene").combine_chunks().dictionary_encode()
    place = np.empty(len(coded.dictionary) + 1, np.int64)
    place[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(1, len(place))
    place[-1] = 0  # a null name
    gene = place[coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)]
    key = unit * len(place) + gene
    order = np.argsort(key, kind="stable")
    starts = np.concatenate([[True], np.diff(key[order]) > 0])
    group, first = np.cumsum(starts) - 1, order[starts]
    value = rows.column("value").combine_chunks()
    there = value.is_valid().to_numpy(zero_copy_only=False)[order]
    mean, ratio = _spread_of(value.to_numpy(zero_copy_only=False)[order][there], group[there], len(first), k + 1)
    return unit[first], gene[first], first, mean, ratio


def variability(members: DataFrame, values: DataFrame, k: int, rows: int | None = None) -> DataFrame:
    """(sample_id, unit_id, gene, mean, ratio): over the k + 1 members of a niche, zeros included, the median absolute
    deviation from the median over the mean.  Zeros are never stored: lists are filled up to k + 1.  `values` are
    rows (gene, value) or lists `l` of them by unit; `rows` is their number, counted if it isn't given."""
    held = _niche_rows(members, values, k, rows)
    schema = held.select(*UNIT, "gene", F.col("value").alias("mean"), F.col("value").alias("ratio")).schema
    arrow = to_arrow_schema(schema)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_units(batches):
            _, _, first, mean, ratio = _gene_statistics(table, k)
            named = table.select([*UNIT, "gene"]).take(pa.array(first))
            yield from pa.table([*named.columns, pa.array(mean), pa.array(ratio)], names=arrow.names).cast(arrow).to_batches()

    return held.mapInArrow(measured, schema)


def _kept(unit: np.ndarray, gene: np.ndarray, mean: np.ndarray, ratio: np.ndarray, fraction: float, least: int) -> np.ndarray:
    """The rows that `foreground` keeps, by unit and place."""
    some = np.flatnonzero(~(mean <= 0))
    n = np.bincount(unit[some], minlength=int(unit.max()) + 1)
    keep = np.minimum(np.maximum(least, np.floor(n * fraction)), n)
    by = some[np.lexsort((gene[some], np.where(np.isnan(ratio[some]), -np.inf, -ratio[some]), unit[some]))]
    return by[np.arange(len(by)) - (np.cumsum(n) - n)[unit[by]] < keep[unit[by]]]


def niche_foreground(members: DataFrame, values: DataFrame, k: int, fraction: float, least: int, digits: int | None = None, rows: int | None = None) -> DataFrame:
    """(sample_id, unit_id, top): `foreground` of `variability` as one list (gene, mean, ratio) a unit, by place, made where
    the ratios are, so that no gene is a row again; ratios are rounded to `digits`, half up, before they are ordered."""
    held = _niche_rows(members, values, k, rows)
    schema = held.select(*UNIT, F.array(F.struct("gene", F.col("value").alias("mean"), F.col("value").alias("ratio"))).alias("top")).schema
    arrow = to_arrow_schema(schema)
    inner = arrow.field("top").type.value_type

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_units(batches):
            unit, gene, first, mean, ratio = _gene_statistics(table, k)
            if digits is not None:
                y = ratio * 10.0**digits
                ratio = (np.floor(y) + (y - np.floor(y) >= 0.5)) / 10.0**digits
            top = _kept(unit, gene, mean, ratio, fraction, least)
            if len(top):
                ends = np.concatenate([np.flatnonzero(np.diff(unit[top])) + 1, [len(top)]])
                parts = [table.column("gene").combine_chunks().take(pa.array(first[top])), pa.array(mean[top]), pa.array(ratio[top])]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.StructArray.from_arrays(parts, fields=list(inner)))
                units = table.select(UNIT).take(pa.array(first[top[ends - 1]]))
                yield from pa.table([*units.columns, lists], names=arrow.names).cast(arrow).to_batches()

    return held.mapInArrow(chosen, schema)


def foreground(ratios: DataFrame, fraction: float, least: int) -> DataFrame:
    """The min(max(least, floor(fraction * n)), n) genes of largest ratio of each unit, of its n with a positive mean."""
    some = ratios.where("mean > 0")
    w = Window.partitionBy(*UNIT)
    n = F.count(F.lit(1)).over(w)
    keep = F.least(F.greatest(F.lit(least), F.floor(n * fraction)), n)
    return some.withColumns({"keep": keep, "pos": F.row_number().over(w.orderBy(F.col("ratio").desc(), "gene"))}).where("pos <= keep").drop("keep")


def set_bounds(sets: DataFrame, low: int, high: int) -> DataFrame:
    """Rows (set_id, gene) of sets of low to high genes."""
    sizes = sets.groupBy("set_id").agg(F.countDistinct("gene").alias("n")).where(F.col("n").between(low, high))
    return sets.join(sizes.select("set_id"), "set_id", "left_semi")


#: Memberships of sets that one pass carries to the tasks.
SET_BLOCK = 2_000_000


def rank_score(values: DataFrame, genes: DataFrame, sets: DataFrame) -> DataFrame:
    """(sample_id, unit_id, set_id, score): 1 - mean rank / (n - 1) of a set's genes among all n genes by value, highest
    first, ties by gene.  Zeros are ranked without being stored: an absent gene comes after the unit's nz positive genes,
    by its place among all genes less the positive ones before it.  So with g over a set's genes and h over the positive
    ones, ranks add up to the sum of nz + place(g), less the number of genes of the set behind each h, plus, for each h of
    the set, rank(h) - nz - place(h) + the positive ones before it.  Sets go out in blocks of SET_BLOCK memberships as
    sorted places; units stay where they are."""
    universe = genes.select("gene").distinct()
    n = universe.count()
    order = universe.withColumn("idx", F.row_number().over(Window.orderBy("gene")) - 1)  # the gene axis, not the data
    w = Window.partitionBy(*UNIT)
    held = values.where("value > 0").join(order, "gene").select(*UNIT, "idx", (F.row_number().over(w.orderBy(F.col("value").desc(), "gene")) - 1).alias("rank"), (F.row_number().over(w.orderBy("gene")) - 1).alias("upto"), F.count(F.lit(1)).over(w).alias("nz"))
    units = held.groupBy(*UNIT).agg(F.first("nz").alias("nz"), F.collect_list(F.struct("idx", (F.col("rank") - F.col("nz") - F.col("idx") + F.col("upto")).alias("own"))).alias("held"))
    units = units.select(*UNIT, "nz", F.col("held.idx").alias("idx"), F.col("held.own").alias("own"))
    places = sets.join(order, "gene").select("set_id", "idx").distinct()
    sizes = places.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
    kinds, spark = {f.name: f.dataType.simpleString() for f in units.join(sets).schema.fields}, values.sparkSession
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*UNIT, "set_id"]) + ", score double"
    out = None
    for block in _blocks_of(sizes):
        rows = places.join(F.broadcast(spark.createDataFrame([(s,) for s in block], sizes.select("set_id").schema)), "set_id").toPandas().sort_values(["set_id", "idx"])
        shared = spark.sparkContext.broadcast([(s, g["idx"].to_numpy(np.int64)) for s, g in rows.groupby("set_id")])

        def scored(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                nz = batch.column("nz").to_numpy().astype(np.int64)
                idx, own = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("idx", "own"))
                ends = np.cumsum(nz)
                per_unit = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])  # noqa: E731, B023
                for s, places in shared.value:
                    to = np.searchsorted(places, idx, "right")
                    inside = (to > 0) & (places[np.maximum(to, 1) - 1] == idx)
                    total = len(places) * nz + places.sum() + per_unit(np.where(inside, own, 0) - (len(places) - to))
                    columns = [*(batch.column(c) for c in UNIT), pa.array([s] * batch.num_rows), pa.array(1 - total / len(places) / (n - 1))]
                    yield pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip(columns, types, strict=True)], [*UNIT, "set_id", "score"])

        types = [f.type for f in to_arrow_schema(spark.createDataFrame([], schema).schema)]
        part = units.mapInArrow(scored, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def _blocks_of(sizes: DataFrame) -> Iterator[list]:
    """Sets in blocks of at most SET_BLOCK memberships, at least one each; the driver holds the sets' names."""
    block, held = [], 0
    for r in sizes.orderBy("set_id").toLocalIterator():
        if block and held + r["n"] > SET_BLOCK:
            yield block
            block, held = [], 0
        block.append(r["set_id"])
        held += r["n"]
    if block:
        yield block


def closure(edges: DataFrame, roots: DataFrame | None = None, most: int = 64) -> DataFrame:
    """(root, node, depth): every node below each root, the root itself at depth 0, at its least depth; cycles end.
    edges: (parent, child).  One join a level, against the nodes of that level only."""
    start = (edges.select(F.col("parent").alias("root")).distinct() if roots is None else roots.select("root").distinct()).withColumns({"node": F.col("root"), "depth": F.lit(0)})
    out = level = start
    for depth in range(1, most + 1):
        below = level.join(edges, level["node"] == edges["parent"]).select("root", F.col("child").alias("node")).distinct()
        level = materialise(below.join(out.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)), "level")
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError("the hierarchy is deeper than allowed")


def pseudobulk(counts: DataFrame) -> DataFrame:
    """(sample_id, gene, value): log1p of the mean count over a sample's units, zeros included.  Rows are dealt by gene,
    so that what is done by gene needs no other shuffle."""
    n = maybe_broadcast(materialise(counts.groupBy("sample_id").agg(F.countDistinct("unit_id").alias("n")), "samples"))
    sums = dealt(counts, counts.count(), "gene").groupBy("sample_id", "gene").agg(F.sum("count").alias("s"))
    return sums.join(n, "sample_id").select("sample_id", "gene", F.log1p(F.col("s") / F.col("n")).alias("value"))


def leave_one_out_markers(loadings: DataFrame, top: int) -> DataFrame:
    """(class, gene, lead, pos): the genes of largest loading less the mean of the other classes' loadings."""
    g = Window.partitionBy("gene")
    n = F.count(F.lit(1)).over(g)
    lead = F.when(n > 1, F.col("loading") - (F.sum("loading").over(g) - F.col("loading")) / (n - 1))
    made = loadings.withColumn("lead", lead).where("lead IS NOT NULL")
    return made.withColumn("pos", F.row_number().over(Window.partitionBy("class").orderBy(F.col("lead").desc(), "gene"))).where(F.col("pos") <= top).select("class", "gene", "lead", "pos")
