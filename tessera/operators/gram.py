"""Statistics that need only n, sums and products of columns: one distributed pass gives the Gram matrix, whose size is
that of the dimensions, and numpy finishes on it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray, list[int]]:
    """(n, sums, products, widths) of the columns' vectors laid side by side; rows with a missing element are left out."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products, widths = 0, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [np.asarray(batch.column(c).flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1) for c in columns]
            x = np.concatenate(parts, axis=1)
            x = x[np.isfinite(x).all(axis=1)]
            n += len(x)
            sums = x.sum(axis=0) if sums is None else sums + x.sum(axis=0)
            products = x.T @ x if products is None else products + x.T @ x
            widths = [p.shape[1] for p in parts]
        if n:
            rows = np.arange(len(sums))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(rows, -1)), pa.array([*products.tolist(), [float(n), *map(float, widths)]]), pa.array([*sums.tolist(), 0.0])], ["i", "products", "total"])

    rows = df.select(*columns).where(" AND ".join(f"{c} IS NOT NULL" for c in columns)).mapInArrow(partial, "i long, products array<double>, total double")
    head = rows.where("i < 0").select("products").agg(F.sum(F.col("products")[0]).alias("n"), F.first("products").alias("w")).first()
    if head["n"] is None:
        return 0, np.zeros(0), np.zeros((0, 0)), [0] * len(columns)
    long = rows.where("i >= 0").select("i", "total", F.posexplode("products").alias("j", "x"))
    found = long.groupBy("i", "j").agg(F.sum("x").alias("x"), F.sum("total").alias("t")).toPandas()
    d = int(found["i"].max()) + 1
    products, sums = np.zeros((d, d)), np.zeros(d)
    products[found["i"], found["j"]] = found["x"]
    sums[found["i"]] = found["t"]
    return int(head["n"]), sums, products, [int(w) for w in head["w"][1:]]


def centred(n: int, sums: np.ndarray, products: np.ndarray) -> np.ndarray:
    return products - np.outer(sums, sums) / max(n, 1)


def linear_cka(df: DataFrame, left: str, right: str, eps: float = 1e-12) -> float:
    """|X'Y|^2 / (|X'X| |Y'Y| + eps) of centred columns."""
    n, sums, products, (a, _) = moments(df, [left, right])
    if n < 2:
        return float("nan")
    c = centred(n, sums, products)
    return float((c[:a, a:] ** 2).sum() / (np.linalg.norm(c[:a, :a]) * np.linalg.norm(c[a:, a:]) + eps))


def participation_ratio(df: DataFrame, vec: str) -> float:
    """(sum of eigenvalues)^2 / sum of their squares, from the trace and the norm of the covariance."""
    n, sums, products, _ = moments(df, [vec])
    c = centred(n, sums, products)
    return float(np.trace(c) ** 2 / (c**2).sum()) if n > 1 else float("nan")


def inverse_root(c: np.ndarray, floor: float) -> np.ndarray:
    values, vectors = np.linalg.eigh(c)
    return vectors / np.sqrt(np.maximum(values, floor)) @ vectors.T


def ridge_cca(df: DataFrame, left: str, right: str, k: int, reg: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(correlations, left directions, right directions) of canonical correlation with a ridge; at most n - 1 of them."""
    n, sums, products, (a, b) = moments(df, [left, right])
    c = centred(n, sums, products) / max(n, 1)
    x, y = inverse_root(c[:a, :a] + reg * np.eye(a), reg), inverse_root(c[a:, a:] + reg * np.eye(b), reg)
    u, s, vt = np.linalg.svd(x @ c[:a, a:] @ y)
    k = min(k, a, b, n - 1)
    return np.clip(s[:k], 0, 1), x @ u[:, :k], y @ vt[:k].T


def pca(df: DataFrame, vec: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, directions, variances); each direction's largest loading is positive."""
    n, sums, products, _ = moments(df, [vec])
    values, vectors = np.linalg.eigh(centred(n, sums, products) / max(n - 1, 1))
    vectors = vectors[:, ::-1][:, :k]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])])
    return sums / max(n, 1), vectors, values[::-1][:k]


def procrustes(df: DataFrame, left: str, right: str) -> np.ndarray:
    """The rotation that takes centred left vectors closest to right ones (equal widths)."""
    n, sums, products, (a, _) = moments(df, [left, right])
    u, _, vt = np.linalg.svd(centred(n, sums, products)[:a, a:])
    return u @ vt


def least_squares(df: DataFrame, vec: str, target: str) -> tuple[np.ndarray, float]:
    """(direction, correlation) of the ordinary least squares fit of a one-element vector column."""
    n, sums, products, (a, _) = moments(df, [vec, target])
    c = centred(n, sums, products)
    w = np.linalg.pinv(c[:a, :a]) @ c[:a, a]
    explained = float(w @ c[:a, a])
    return w / max(np.linalg.norm(w), 1e-12), float(np.sqrt(max(explained, 0) / c[a, a])) if c[a, a] > 0 else 0.0
