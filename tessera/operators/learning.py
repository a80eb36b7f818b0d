"""Fitted models on embeddings: clusters, probes and directions, always judged on subjects that they were not fitted on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import cells, gram, permute, statistics
from tessera.operators.permute import numbered
from tessera.operators.tables import materialise


def clusters(units: DataFrame, k: int, seed: int, vec: str = "v", n_init: int = 1) -> DataFrame:
    """units with a column cluster, of the best of `n_init` starts."""
    rows = units.withColumn("__f", array_to_vector(F.col(vec)))
    fits = (KMeans(k=k, seed=seed + i, featuresCol="__f", predictionCol="cluster", maxIter=50).fit(rows) for i in range(n_init))
    return min(fits, key=lambda m: m.summary.trainingCost).transform(rows).drop("__f")


def label_silhouette(units: DataFrame, key: str, label: str, most: int, seed: int, vec: str = "v") -> float:
    """The mean silhouette of a label on Euclidean distances, over the first `most` units in seeded hash order: their
    distances are what the definition asks for, so the bound is part of it.  A unit alone in its class has 0."""
    drawn = units.orderBy(F.md5(F.concat_ws(":", F.lit(seed), key)), key).limit(most).select(label, vec)
    held = drawn.toPandas()  # `most` rows
    names, code = np.unique(held[label].to_numpy(), return_inverse=True)
    x = np.stack([np.asarray(v, float) for v in held[vec]])
    if len(names) < 2:
        return float("nan")
    member = np.eye(len(names))[code]

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("id").to_numpy()
            for some in np.array_split(at, max(1, len(at) // 256)):
                if not len(some):
                    continue
                apart = np.sqrt(np.maximum((x[some] ** 2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * x[some] @ x.T, 0))
                apart[np.arange(len(some)), some] = 0
                total, n, own = apart @ member, member.sum(axis=0), code[some]
                a = total[np.arange(len(some)), own] / np.maximum(n[own] - 1, 1)
                mean = total / n
                mean[np.arange(len(some)), own] = np.inf
                b = mean.min(axis=1)
                top = np.maximum(a, b)
                s = np.where((n[own] > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0)
                yield pa.RecordBatch.from_arrays([pa.array(s)], ["s"])

    return units.sparkSession.range(len(x)).mapInArrow(scores, "s double").agg(F.avg("s")).first()[0]


def cluster_agreement(units: DataFrame, label: str, k: int, seed: int, n_init: int = 3, silhouette_sample: int = 2000, key: str = "unit_id", vec: str = "v") -> DataFrame:
    """(n, k, n_silhouette, ari, nmi, silhouette, reason): k clusters against a label, and the label's own silhouette on a
    sample of units.  With one class, or fewer units than clusters, the figures are nan and reason says so."""
    n, classes = units.agg(F.count(F.lit(1)), F.countDistinct(label)).first()
    schema = "n long, k long, n_silhouette long, ari double, nmi double, silhouette double, reason string"
    if classes < 2 or n < k:
        return units.sparkSession.createDataFrame([(n, k, 0, float("nan"), float("nan"), float("nan"), "fewer than two classes, or fewer units than k")], schema)
    ari, nmi = statistics.agreement(clusters(units, k, seed, vec, n_init), "cluster", label).first()
    return units.sparkSession.createDataFrame([(n, k, min(n, silhouette_sample), ari, nmi, label_silhouette(units, key, label, silhouette_sample, seed, vec), "")], schema)


def linear_probe(units: DataFrame, label: str, split: DataFrame, vec: str = "v", c: float = 1.0) -> DataFrame:
    """(n_train, n_test, train_groups, test_groups, accuracy, chance, reason) of a linear classifier of `label` (0, 1, ...)
    fitted on the subjects of part train and scored on those of part test; chance is the share of the commonest label among
    the tested.  The penalty is half the squared weights against `c` times the sum of losses, features as they are.  Where
    no subject is left on a side, or the fitted side has one class, accuracy is nan and reason says so."""
    rows = units.join(split.select("subject_id", "part"), "subject_id").withColumns({"__f": array_to_vector(F.col(vec)), "__l": F.col(label).cast("double")})
    on = lambda part, x: F.when(F.col("part") == part, x)
    n, m, groups, held, classes = rows.agg(F.count(on("train", F.lit(1))), F.count(on("test", F.lit(1))), F.countDistinct(on("train", F.col("subject_id"))), F.countDistinct(on("test", F.col("subject_id"))), F.countDistinct(on("train", F.col("__l")))).first()
    reason = "no subject on a side" if not groups or not held else "one class in the train split" if classes < 2 else ""
    accuracy = chance = float("nan")
    if not reason:
        model = LogisticRegression(featuresCol="__f", labelCol="__l", predictionCol="__p", maxIter=100, regParam=1 / (c * n), standardization=False).fit(rows.where("part = 'train'"))
        by = model.transform(rows.where("part = 'test'")).groupBy("__l").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__p") == F.col("__l")).alias("right"))
        accuracy, chance = by.agg(F.sum("right") / F.sum("n"), F.max("n") / F.sum("n")).first()
    return units.sparkSession.createDataFrame([(n, m, groups, held, accuracy, chance, reason)], "n_train long, n_test long, train_groups long, test_groups long, accuracy double, chance double, reason string")


def project(df: DataFrame, vec: str, direction: np.ndarray, name: str) -> DataFrame:
    """df with the product of a vector column and a direction."""
    return df.withColumn(name, V.dot(F.col(vec), F.array(*[F.lit(float(x)) for x in direction])))


def transfer_correlation(train: DataFrame, test: DataFrame, vec: str, target: str) -> tuple[float, float]:
    """(r on test, r on train) of the direction of `vec` that least squares fit to `target` on train.  Each side is centred
    on its own rows, which a correlation does by itself."""
    direction, _ = gram.least_squares(train.select(vec, F.array(F.col(target).cast("double")).alias("__y")), vec, "__y")
    r = lambda df: project(df, vec, direction, "__u").agg(F.corr("__u", F.col(target).cast("double"))).first()[0]
    return r(test), r(train)


def cca_scores(df: DataFrame, test: DataFrame, left: str, right: str, k: int, reg: float) -> DataFrame:
    """test with arrays cca_left and cca_right: its rows along the directions fitted on df, scaled to length one; a zero
    vector stays zero."""
    _, a, b = gram.ridge_cca(df, left, right, k, reg)
    n, sums, _, (width, _) = gram.moments(df, [left, right])
    mean = sums / max(n, 1)

    def along(vec: str, centre: np.ndarray, d: np.ndarray):
        shifted = F.zip_with(F.col(vec), F.array(*[F.lit(float(x)) for x in centre]), lambda x, m: x - m)
        return V.l2_normalise(F.array(*[V.dot(shifted, F.array(*[F.lit(float(x)) for x in d[:, i]])) for i in range(d.shape[1])]), policy="keep")

    return test.withColumns({"cca_left": along(left, mean[:width], a), "cca_right": along(right, mean[width:], b)})


def cka_draws(df: DataFrame, key: str, left: str, right: str, reps: int, seed: int) -> DataFrame:
    """(rep, value): CKA of bootstrap draws of rows.  How often a draw has a row is Poisson with mean one, from the row's
    number and the draw's, so rows needn't know of each other and no draw moves them (CKA doesn't change with the total);
    means are those of all rows and are not taken again.  All draws' products are added up in one pass."""
    place = materialise(numbered(df.where(f"{left} IS NOT NULL AND {right} IS NOT NULL").select(key, left, right), [], [key]), "cka-rows")
    n, sums, _, (a, _) = gram.moments(place, [left, right])
    mean = sums / max(n, 1)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = cells.Open()
        for batch in (x for x in batches if x.num_rows):
            x = np.concatenate([cells.matrix(batch.column(c)) for c in (left, right)], axis=1) - mean
            good = np.isfinite(x).all(axis=1)
            at, x = batch.column("place").to_numpy()[good], x[good]
            for rep in range(1, reps + 1):
                held.add(("", "cka", rep), len(x), a, np.zeros(0), x.T @ (x * permute.poisson(at, rep, seed)[:, None]))
        if held.sums:
            yield held.taken()

    def value(rows: pa.Table) -> pa.Table:
        c = np.asarray(rows.column("products")[0].as_py())
        c = c.reshape(len(mean), len(mean))
        return pa.table({"rep": pa.array([rows.column("perm")[0].as_py()], pa.int32()), "value": pa.array([float((c[:a, a:] ** 2).sum() / (np.linalg.norm(c[:a, :a]) * np.linalg.norm(c[a:, a:]) + 1e-12))])})

    return cells.added(place.select("place", left, right).mapInArrow(partial, cells.SUMS)).groupBy("perm").applyInArrow(value, "rep int, value double")
