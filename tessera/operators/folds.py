"""Probes over grouped folds: every subject is in one fold, and the classifiers of all folds are fitted together.

A fold's classifier is multinomial logistic regression on the units of the other folds, half the squared weights against
`c` times the sum of losses, the intercept free, features as they are.  One pass adds up the units' products by fold, which
gives each fold's curvature bound (what all folds hold less its own); then each round of descent is one pass that adds up
the losses and gradients of all folds not yet settled.  The driver holds a point for each fold, not units.

Units without subject, label or vector, or with a number in it that is not finite, are left out."""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import cells
from tessera.operators.permute import numbered
from tessera.operators.tables import materialise, maybe_broadcast

#: Labels that a probe may tell apart; each costs a weight vector for every fold.
MOST_CLASSES = 1000
#: Steps whose differences shape the next one.
MEMORY = 10


def grouped_folds(units: DataFrame, label: str, k: int, seed: int, subject: str = "subject_id") -> DataFrame:
    """(subject, stratum, n, fold): subjects in order of their commonest label (the smaller of equals), then from many units
    to few, then by seeded hash, are dealt to k folds back and forth, so folds are alike in labels and in size."""
    per = units.where(F.col(subject).isNotNull() & F.col(label).isNotNull()).groupBy(subject, label).agg(F.count(F.lit(1)).alias("m"))
    whole = per.groupBy(subject).agg(F.min_by(label, F.struct(-F.col("m"), F.col(label))).alias("stratum"), F.sum("m").alias("n"))
    keyed = whole.withColumns({"__few": -F.col("n"), "__hash": F.md5(F.concat_ws(":", F.lit(seed), subject))})
    dealt = numbered(keyed.withColumnRenamed("n", "__n"), [], ["stratum", "__few", "__hash", subject])
    turn, at = F.floor(F.col("place") / k), F.col("place") % k
    return dealt.select(subject, "stratum", F.col("__n").alias("n"), F.when(turn % 2 == 0, at).otherwise(k - 1 - at).cast("int").alias("fold"))


@dataclass(frozen=True)
class Probe:
    """classes: labels in order; weights: classes x (width + 1) for each fold, the intercept last; settled: whether the
    descent ended by its gradient; reasons: why a fold has no weights."""

    classes: list
    weights: dict[int, np.ndarray]
    settled: dict[int, bool]
    reasons: dict[int, str]


def _descent(start: np.ndarray, bend: Callable[[np.ndarray], np.ndarray], tol: float) -> Generator[np.ndarray, tuple[float, np.ndarray], None]:
    """Yields points and is sent (loss, gradient) of each; the last one yielded, when it returns, has no entry of its
    gradient above tol.  Limited-memory quasi-Newton steps on top of `bend`, halved until the loss falls enough."""
    x, pairs = start, []
    loss, g = yield x
    while np.abs(g).max() > tol:
        q, kept = g.copy(), []
        for s, y, r in reversed(pairs):
            a = r * np.vdot(s, q)
            kept.append(a)
            q -= a * y
        d = bend(q)
        for (s, y, r), a in zip(pairs, reversed(kept), strict=True):
            d += (a - r * np.vdot(y, d)) * s
        slope, step = np.vdot(g, d), 1.0
        while True:
            to = x - step * d
            new, h = yield to
            if new <= loss - 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        s, y = to - x, h - g
        if np.vdot(s, y) > 1e-14 * np.vdot(y, y):
            pairs = [*pairs[-MEMORY + 1 :], (s, y, 1 / np.vdot(s, y))]
        if step < 1e-10:
            return
        x, loss, g = to, new, h


def _added(rows: DataFrame, sums: Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[int, int, np.ndarray, np.ndarray]]]) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """`sums` gives (fold, n, sums, products) of a batch's folds, classes and features with a one behind; added up."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = cells.Open()
        for batch in (b for b in batches if b.num_rows):
            x = cells.matrix(batch.column("v"))
            x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            for fold, n, total, products in sums(batch.column("fold").to_numpy(), batch.column("y").to_numpy(), x):
                held.add((str(fold), "probe", 0), n, x.shape[1], total, products)
        if held.sums:
            yield held.taken()

    got = cells.added(rows.select("fold", "y", "v").mapInArrow(partial, cells.SUMS)).collect()  # a row for each fold
    return {int(r["cell"]): (r["n"], np.asarray(r["sums"]), np.asarray(r["products"])) for r in got}


def _usable(units: DataFrame, folds: DataFrame, label: str, subject: str, vec: str, key: str) -> DataFrame:
    rows = units.select(key, subject, F.col(label).alias("__label"), F.col(vec).cast("array<double>").alias("v")).where(F.col("__label").isNotNull() & F.col("v").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite).join(maybe_broadcast(materialise(folds.select(subject, "fold"), "folds")), subject)


def fitted(rows: DataFrame, k: int, c: float = 1.0, most_rounds: int = 200, tol: float = 1e-6) -> Probe:
    """The probe of rows (fold, __label, v), a written table; folds 0 to k - 1."""
    classes = [r[0] for r in rows.select("__label").distinct().limit(MOST_CLASSES + 1).collect()]
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} labels")
    classes = sorted(classes)
    if not classes:
        return Probe([], {}, {}, {f: "one class in the train split" for f in range(k)})
    code = rows.sparkSession.createDataFrame(list(enumerate(classes)), rows.select(F.lit(0).alias("y"), F.col("__label")).schema)
    coded = materialise(rows.join(F.broadcast(code), "__label").select("fold", "y", "v"), "probe-rows")  # at most MOST_CLASSES rows
    m = len(classes)

    def products(fold, y, x):
        for f in np.unique(fold):
            own = fold == f
            yield f, int(own.sum()), np.bincount(y[own], minlength=m).astype(float), x[own].T @ x[own]

    held = _added(coded, products)
    whole = [sum(h[i] for h in held.values()) for i in range(3)]
    reasons, open_, settled, last = {}, {}, {}, {}
    for f in range(k):
        n, seen, gram = (w - h for w, h in zip(whole, held.get(f, (0, 0.0, 0.0)), strict=True))
        width = round(len(whole[2]) ** 0.5)
        if f not in held:
            reasons[f] = "no subject on a side"
        elif n == 0 or (seen > 0).sum() < 2:
            reasons[f] = "no subject on a side" if n == 0 else "one class in the train split"
        else:
            shrink = np.full(width, 1 / (c * n))
            shrink[-1] = 0
            # the softmax's curvature is at most half the products'
            inverse = np.linalg.pinv(0.5 * gram.reshape(width, width) / n + np.diag(shrink), hermitian=True)
            step = _descent(np.zeros((m, width)), lambda q, inverse=inverse: q @ inverse, tol)
            open_[f], last[f] = (step, shrink, n), next(step)

    for _ in range(most_rounds):
        if not open_:
            break
        at = {f: last[f] for f in open_}

        def slopes(fold, y, x, at=at):
            for f, w in at.items():
                own = fold != f
                if not own.any():
                    continue
                z = x[own] @ w.T
                z -= z.max(axis=1, keepdims=True)
                e = np.exp(z)
                total = e.sum(axis=1, keepdims=True)
                loss = (np.log(total[:, 0]) - z[np.arange(len(z)), y[own]]).sum()
                p = e / total
                p[np.arange(len(z)), y[own]] -= 1
                yield f, len(z), np.array([loss]), p.T @ x[own]

        found = _added(coded, slopes)
        for f, (step, shrink, n) in list(open_.items()):
            w = last[f]
            loss, slope = found[f][1][0] / n + (w * w * shrink).sum() / 2, found[f][2].reshape(w.shape) / n + w * shrink
            try:
                last[f] = step.send((loss, slope))
            except StopIteration:
                settled[f] = bool(np.abs(slope).max() <= tol)
                del open_[f]
    return Probe(classes, last, {f: settled.get(f, False) for f in last}, reasons)


def predicted(rows: DataFrame, probe: Probe, key: str) -> DataFrame:
    """(key, fold, truth, guess): each unit under the classifier that its fold had no part in; units of a fold without one
    are left out."""
    kind = dict(rows.dtypes)
    weights = probe.weights

    def guesses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            x, fold = cells.matrix(batch.column("v")), batch.column("fold").to_numpy()
            best = np.full(len(x), -1)
            for f in np.unique(fold):
                if f in weights:
                    own = fold == f
                    best[own] = (x[own] @ weights[f][:, :-1].T + weights[f][:, -1]).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("fold"), batch.column("__label"), pa.array(best, pa.int32())], [key, "fold", "truth", "at"])

    got = rows.select(key, "fold", "__label", "v").mapInArrow(guesses, f"`{key}` {kind[key]}, fold int, truth {kind['__label']}, at int").where("at >= 0")
    names = F.array(*[F.lit(c) for c in probe.classes]).cast(f"array<{kind['__label']}>")
    return got.select(key, "fold", "truth", names[F.col("at")].alias("guess"))


def scores(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, accuracy, chance, macro_f1, weighted_f1) from confusion counts by keys; chance is the share of the commonest
    truth.  Macro F1 is over all labels that are a truth or a guess there."""
    counts = predictions.groupBy(*keys, "truth", "guess").agg(F.count(F.lit(1)).alias("m"))
    zero, hit = F.lit(0).cast("long"), F.when(F.col("truth") == F.col("guess"), F.col("m")).otherwise(0)
    sides = F.array(F.struct(F.col("truth").alias("c"), F.col("m").alias("support"), zero.alias("called"), hit.alias("hit")), F.struct(F.col("guess").alias("c"), zero.alias("support"), F.col("m").alias("called"), zero.alias("hit")))
    per = counts.select(*keys, F.inline(sides)).groupBy(*keys, "c").agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hit").alias("hit"))
    f1 = 2 * F.col("hit") / (F.col("support") + F.col("called"))
    return per.groupBy(*keys).agg(F.sum("support").alias("n"), (F.sum("hit") / F.sum("support")).alias("accuracy"), (F.max("support") / F.sum("support")).alias("chance"), F.avg(f1).alias("macro_f1"), (F.sum(f1 * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def fold_predictions(units: DataFrame, label: str, k: int, seed: int, c: float = 1.0, subject: str = "subject_id", vec: str = "v", key: str = "unit_id") -> tuple[DataFrame, Probe, DataFrame]:
    """(predictions, probe, rows) of k grouped folds."""
    rows = materialise(_usable(units, grouped_folds(units, label, k, seed, subject), label, subject, vec, key), "probe-units")
    probe = fitted(rows, k, c)
    return predicted(rows, probe, key), probe, rows


def fold_probe(units: DataFrame, label: str, k: int = 3, seed: int = 0, c: float = 1.0, subject: str = "subject_id", vec: str = "v", key: str = "unit_id") -> DataFrame:
    """(fold, n_train, n_test, train_groups, test_groups, accuracy, chance, macro_f1, weighted_f1, reason), a row for each of
    the k folds.  Where a side is empty or the fitted side has one class, the scores are null and reason says so; it also
    says if the descent has not settled."""
    found, probe, rows = fold_predictions(units, label, k, seed, c, subject, vec, key)
    spark = units.sparkSession
    notes = {**probe.reasons, **{f: "" if s else "not settled" for f, s in probe.settled.items()}}
    each = spark.createDataFrame([(f, notes[f]) for f in range(k)], "fold int, reason string")
    sizes = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n_test"), F.countDistinct(subject).alias("test_groups"))
    whole = rows.agg(F.count(F.lit(1)).alias("__n"), F.countDistinct(subject).alias("__g"))
    sized = each.join(sizes, "fold", "left").fillna(0, ["n_test", "test_groups"]).crossJoin(F.broadcast(whole))  # whole is one row
    of = sized.select("fold", (F.col("__n") - F.col("n_test")).alias("n_train"), "n_test", (F.col("__g") - F.col("test_groups")).alias("train_groups"), "test_groups", "reason")
    return of.join(scores(found, ["fold"]).drop("n"), "fold", "left").select("fold", "n_train", "n_test", "train_groups", "test_groups", "accuracy", "chance", "macro_f1", "weighted_f1", "reason")
