"""Two views brought into one space by closed forms: fitted on train from one Gram aggregate, applied to any rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import cells, gram, units


@dataclass(frozen=True)
class Alignment:
    """Means and directions of both views; `k` is how many directions the data had room for."""

    mean_left: np.ndarray
    mean_right: np.ndarray
    left: np.ndarray
    right: np.ndarray
    k: int


def _components(c: np.ndarray, k: int) -> np.ndarray:
    """The first k principal directions, each with its largest loading positive."""
    _, vectors = np.linalg.eigh(c)
    vectors = vectors[:, ::-1][:, :k]
    return vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])])


def fitted(train: DataFrame, left: str, right: str, method: str, k: int, reg: float = 1e-4) -> Alignment:
    """method cca: whitened by the ridge `reg`, then the singular directions of the cross products; procrustes: principal
    components of each view, the left ones rotated onto the right ones; unaligned: components only, the baseline without
    any signal between views.  Rows with a missing element are left out; without two rows nothing can be fitted."""
    if k < 1 or method not in ("cca", "procrustes", "unaligned"):
        raise ValueError(f"no alignment {method!r} of {k} dimensions")
    n, sums, products, widths = gram.moments(train, [left, right])
    if n < 2:
        raise ValueError("two rows or more are needed")
    a, b = widths
    c, mean = gram.centred(n, sums, products), sums / n
    k = min(k, a, b, n - 1)
    if method == "cca":
        x, y = (gram.inverse_root(m / n + reg * np.eye(len(m)), reg) for m in (c[:a, :a], c[a:, a:]))
        u, _, vt = np.linalg.svd(x @ (c[:a, a:] / n) @ y)
        return Alignment(mean[:a], mean[a:], x @ u[:, :k], y @ vt[:k].T, k)
    p, q = _components(c[:a, :a], k), _components(c[a:, a:], k)
    if method == "procrustes":
        u, _, vt = np.linalg.svd(p.T @ c[:a, a:] @ q)
        p = p @ (u @ vt)
    return Alignment(mean[:a], mean[a:], p, q, k)


def transformed(df: DataFrame, alignment: Alignment, left: str, right: str) -> DataFrame:
    """df with z_left and z_right, its rows along the fitted directions, of length one; a zero vector stays zero."""
    own = alignment

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for x in batches if x.num_rows):
            made = []
            for name, mean, d in ((left, own.mean_left, own.left), (right, own.mean_right, own.right)):
                z = (cells.matrix(batch.column(name)) - mean) @ d
                size = np.linalg.norm(z, axis=1, keepdims=True)
                z = z / np.where(size < 1e-12, 1, size)
                made.append(pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * own.k), pa.array(z.reshape(-1))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "z_left", "z_right"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], "z_left array<double>", "z_right array<double>"])
    return df.mapInArrow(rows, schema)


def three_way_split(table: DataFrame, stratum: str, validation: float, test: float, seed: int) -> DataFrame:
    """(subject_id, stratum, part): test first, then validation as its share of the rest, each stratified where every stratum
    still has two subjects or more."""
    first = units.split_subjects(table, stratum, test, seed)
    rest = first.where("part = 'train'").select("subject_id", "stratum")
    second = units.split_subjects(rest, "stratum", validation / (1 - test), seed + 1).withColumn("part", F.when(F.col("part") == "test", "validation").otherwise("train"))
    return first.where("part = 'test'").unionByName(second)
