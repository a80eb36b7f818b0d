"""Canonical correlations of many cells at once, and their permutation nulls.

A cell is a key (run, view, pathway, ...) with units that have a vector z and a target vector y, and belong to part train or
test.  Everything comes from counts, sums and products of [z, y]: one pass adds them up for every cell and part together,
and a task per cell does the d x d work, so there is no job for each cell.  Permuting targets changes only the products of
z and y; a unit's partner is computed (see `permute`), and all permutations' products are added up in one more pass.

Directions come from inverse roots of the products over the eigenvalues above FLOOR of the largest, so that collinear
columns don't count twice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.permute import numbered, partners
from tessera.operators.tables import materialise

FLOOR = 1e-10
#: Numbers in targets that every task may hold; beyond that partners are fetched by joins.
HELD_NUMBERS = 8_000_000
#: Numbers in a task's unfinished sums before they are passed on.
OPEN_NUMBERS = 4_000_000
SUMS = "cell string, kind string, perm int, n long, width int, sums array<double>, products array<double>"
FOUND = "cell string, n_full long, n_train long, n_test long, r_full double, r_train double, r_test double, z_full double, p_full double, z_test double, p_test double"


def held_out(units: DataFrame, subject: str, n: int, seed: int) -> DataFrame:
    """(subject): `n` subjects of the union over all runs, the first in seeded hash order, for every cell alike."""
    return units.select(subject).where(F.col(subject).isNotNull()).distinct().orderBy(F.md5(F.concat_ws(":", F.lit(seed), subject)), subject).limit(n)


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def _runs(cells: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    names, code = np.unique(cells, return_inverse=True)
    order = np.argsort(code, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
        yield names[code[at[0]]], at


class Open:
    """A task's sums by key, passed on when there are many."""

    def __init__(self) -> None:
        self.sums: dict[tuple, list] = {}
        self.size = 0

    def add(self, key: tuple, n: int, width: int, sums: np.ndarray, products: np.ndarray) -> None:
        if key in self.sums:
            own = self.sums[key]
            own[0] += n
            own[2] += sums
            own[3] += products
        else:
            self.sums[key] = [n, width, sums, products]
            self.size += sums.size + products.size

    def taken(self) -> pa.RecordBatch:
        keys, rows = list(self.sums), list(self.sums.values())
        self.sums, self.size = {}, 0
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([k[2] for k in keys], pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
                pa.array([r[2].reshape(-1) for r in rows], pa.list_(pa.float64())), pa.array([r[3].reshape(-1) for r in rows], pa.list_(pa.float64())),
            ],
            ["cell", "kind", "perm", "n", "width", "sums", "products"],
        )


def added(parts: DataFrame) -> DataFrame:
    """Sums of the tasks' rows by key."""

    def add(rows: pa.Table) -> pa.Table:
        total = lambda c: pa.array([np.sum([np.asarray(x, float) for x in rows.column(c).to_pylist()], axis=0)], pa.list_(pa.float64()))
        first = rows.slice(0, 1)
        return pa.table({"cell": first.column("cell"), "kind": first.column("kind"), "perm": first.column("perm"), "n": pa.array([sum(rows.column("n").to_pylist())], pa.int64()), "width": first.column("width"), "sums": total("sums"), "products": total("products")})

    return parts.groupBy("cell", "kind", "perm").applyInArrow(add, SUMS)


def moments(rows: DataFrame) -> DataFrame:
    """SUMS of rows (cell, part, z, y), for each cell and part and, of kind full, for the cell; `width` is that of z."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Open()
        for batch in (x for x in batches if x.num_rows):
            cells = np.array([f"{c}\0{p}" for c, p in zip(batch.column("cell").to_pylist(), batch.column("part").to_pylist(), strict=True)], object)
            for name, at in _runs(cells):
                take = pa.array(at)
                z, y = matrix(batch.column("z").take(take)), matrix(batch.column("y").take(take))
                x = np.concatenate([z, y], axis=1)
                cell, part = name.split("\0")
                for kind in (part, "full"):
                    held.add((cell, kind, 0), len(x), z.shape[1], x.sum(axis=0), x.T @ x)
            if held.size > OPEN_NUMBERS:
                yield held.taken()
        if held.sums:
            yield held.taken()

    return added(rows.select("cell", "part", "z", "y").mapInArrow(partial, SUMS))


def permuted_products(rows: DataFrame, kind: str, n_perms: int, seed: int) -> DataFrame:
    """SUMS of kind `kind` with perm 1..n_perms: products of z and the partners' y, of rows (cell, place, n, z, y) numbered
    within cells."""
    size = rows.agg(F.coalesce(F.sum(F.size("y")), F.lit(0))).first()[0]
    if size > HELD_NUMBERS:
        return _joined_products(rows, kind, n_perms, seed)
    found = rows.select("cell", "place", "y").toPandas().sort_values(["cell", "place"])
    targets = {c: np.stack([np.asarray(v, float) for v in g["y"]]) for c, g in found.groupby("cell")}
    held = rows.sparkSession.sparkContext.broadcast(targets)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Open()
        for batch in (x for x in batches if x.num_rows):
            for cell, at in _runs(np.array(batch.column("cell").to_pylist(), object)):
                y, z = held.value[cell], matrix(batch.column("z").take(pa.array(at)))
                place = batch.column("place").to_numpy()[at]
                for perm in range(1, n_perms + 1):
                    own.add((cell, kind, perm), len(at), z.shape[1], np.zeros(0), z.T @ y[partners(place, len(y), perm, seed)])
            if own.size > OPEN_NUMBERS:
                yield own.taken()
        if own.sums:
            yield own.taken()

    return added(rows.select("cell", "place", "z").mapInArrow(partial, SUMS))


def _joined_products(rows: DataFrame, kind: str, n_perms: int, seed: int) -> DataFrame:
    """`permuted_products` for any number of targets: rows ask for their partners by number, and only targets move."""

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for x in batches if x.num_rows):
            for cell, at in _runs(np.array(batch.column("cell").to_pylist(), object)):
                place, n = batch.column("place").to_numpy()[at], batch.column("n").to_numpy()[at[0]]
                for perm in range(1, n_perms + 1):
                    yield pa.RecordBatch.from_arrays([pa.array([cell] * len(at)), pa.array(place), pa.array(np.full(len(at), perm, np.int32)), pa.array(partners(place, int(n), perm, seed))], ["cell", "place", "perm", "partner"])

    wanted = rows.select("cell", "place", "n").mapInArrow(asks, "cell string, place long, perm int, partner long")
    given = wanted.join(rows.select("cell", F.col("place").alias("partner"), "y"), ["cell", "partner"]).groupBy("cell", "place").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("perm", "y"))), lambda s: s["y"])).alias("ys"))
    both = rows.select("cell", "place", "z").join(given, ["cell", "place"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Open()
        for batch in (x for x in batches if x.num_rows):
            for cell, at in _runs(np.array(batch.column("cell").to_pylist(), object)):
                z, ys = matrix(batch.column("z").take(pa.array(at))), matrix(batch.column("ys").take(pa.array(at)))
                for perm, y in enumerate(np.split(ys, n_perms, axis=1), 1):
                    own.add((cell, kind, perm), len(at), z.shape[1], np.zeros(0), z.T @ y)
            if own.size > OPEN_NUMBERS:
                yield own.taken()
        if own.sums:
            yield own.taken()

    return added(both.mapInArrow(partial, SUMS))


def _inverse_root(c: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(c)
    good = values > FLOOR * max(values.max(initial=0), 1e-300)
    return (vectors[:, good] / np.sqrt(values[good])) @ vectors[:, good].T


class _Side:
    """Centred products of one part of a cell."""

    def __init__(self, row: dict):
        self.n, d = row["n"], row["width"]
        s = np.asarray(row["sums"])
        c = np.asarray(row["products"]).reshape(len(s), len(s)) - np.outer(s, s) / self.n
        self.zz, self.zy, self.yy = c[:d, :d], c[:d, d:], c[d:, d:]
        self.shift = np.outer(s[:d], s[d:]) / self.n
        self.rz, self.ry = _inverse_root(self.zz), _inverse_root(self.yy)

    def top(self, zy: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The largest canonical correlation and its directions."""
        u, r, vt = np.linalg.svd(self.rz @ zy @ self.ry, full_matrices=False)
        return float(np.clip(r[0], -1, 1)), self.rz @ u[:, 0], self.ry @ vt[0]

    def along(self, a: np.ndarray, b: np.ndarray) -> float:
        """The correlation of this part's units along given directions; nan where they don't vary."""
        va, vb = a @ self.zz @ a, b @ self.yy @ b
        return float(a @ self.zy @ b / np.sqrt(va * vb)) if va > 0 and vb > 0 else float("nan")


def _finished(rows: pa.Table) -> pa.Table:
    rows = rows.to_pylist()
    sides = {r["kind"]: _Side(r) for r in rows if r["perm"] == 0}
    full, train, test = (sides.get(k) for k in ("full", "train", "test"))
    nulls = lambda side, kind: [np.asarray(r["products"]).reshape(r["width"], -1) - side.shift for r in sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["perm"])]
    r_full = full.top(full.zy)[0]
    null = np.array([full.top(c)[0] for c in nulls(full, "null_full")])
    z_full, p_full = (r_full - null.mean()) / (null.std() + 1e-12), (1 + (null >= r_full).sum()) / (1 + len(null))
    r_train = r_test = z_test = p_test = float("nan")
    if train and test and train.n >= 3 and test.n >= 3:
        r_train, a, b = train.top(train.zy)
        r_test = test.along(a, b)
        null = np.array([test.along(*train.top(c)[1:]) for c in nulls(train, "null_train")])
        null = null[~np.isnan(null)]
        if len(null) and not np.isnan(r_test):
            z_test, p_test = (r_test - null.mean()) / (null.std() + 1e-12), (1 + (np.abs(null) >= abs(r_test)).sum()) / (1 + len(null))
    n = lambda side: side.n if side else 0
    names = [x.split()[0] for x in FOUND.split(", ")]
    values = [rows[0]["cell"], n(full), n(train), n(test), *(float(x) for x in (r_full, r_train, r_test, z_full, p_full, z_test, p_test))]
    return pa.table({k: [v] for k, v in zip(names, values, strict=True)})


def study(rows: DataFrame, keys: list[str], unit: str, n_perms: int, seed: int) -> DataFrame:
    """For each cell of rows (keys, unit, part, z, y): the top canonical correlation over all units (r_full) against nulls that
    permute targets over all of them (one-sided p), and directions fitted on train (r_train) and scored on test (r_test)
    against nulls that permute train's targets and fit again (two-sided p).  Rows with a missing element are left out; a
    part below three units gives nan."""
    whole = lambda c: F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))
    cell = F.concat_ws("\u0001", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    good = rows.where(F.coalesce(whole("z") & whole("y"), F.lit(False))).select(cell.alias("cell"), *[F.col(k).alias(f"k_{k}") for k in keys], "part", unit, F.col("z").cast("array<double>").alias("z"), F.col("y").cast("array<double>").alias("y"))
    named = good.select("cell", *[f"k_{k}" for k in keys]).distinct()
    # train first, so that the numbers over all units are train's and then test's
    first = good.withColumn("later", F.when(F.col("part") == "train", 0).otherwise(1))
    place = materialise(numbered(first, ["cell"], ["later", unit]).drop(*[f"k_{k}" for k in keys]), "cells")
    train = place.where("part = 'train'")
    sizes = train.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    full = permuted_products(place.select("cell", "place", "n", "z", "y"), "null_full", n_perms, seed)
    part = permuted_products(train.drop("n").join(sizes, "cell").select("cell", "place", "n", "z", "y"), "null_train", n_perms, seed + 1)
    every = moments(place).unionByName(full).unionByName(part)
    return named.join(every.groupBy("cell").applyInArrow(_finished, FOUND), "cell").select(*[F.col(f"k_{k}").alias(k) for k in keys], *[x.split()[0] for x in FOUND.split(", ")[1:]])
