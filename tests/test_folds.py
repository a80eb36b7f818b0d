"""Grouped folds and the probes fitted on them together."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import folds

SCHEMA = "unit_id long, subject_id long, label int, v array<double>, fold string"


def planted(n=240, width=5, classes=3, subjects=9, seed=4):
    r = np.random.default_rng(seed)
    y = r.integers(0, classes, n)
    x = r.normal(size=(n, width)) * np.array([1, 30, 0.05, 1, 1])
    x[:, 0] += y
    return [(i, int(i * 7 % subjects), int(y[i]), [float(a) for a in x[i]], "clash") for i in range(n)]


def loss(w, x, y, c):
    z = x @ w.T
    z = z - z.max(axis=1, keepdims=True)
    logp = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    g = np.exp(logp)
    g[np.arange(len(y)), y] -= 1
    shrink = np.append(np.full(x.shape[1] - 1, 1 / c), 0)
    return -logp[np.arange(len(y)), y].sum() + (w * w * shrink).sum() / 2, g.T @ x + w * shrink


def test_every_subject_in_one_fold_and_folds_alike(spark):
    df = spark.createDataFrame(planted(subjects=10), SCHEMA)
    got = folds.grouped_folds(df, "label", 3, 1).toPandas()
    assert got.subject_id.is_unique and len(got) == 10 and got.n.sum() == 240
    assert got.groupby("fold").size().tolist() in ([3, 3, 4], [3, 4, 3], [4, 3, 3])
    order = got.assign(h=[__import__("hashlib").md5(f"1:{s}".encode()).hexdigest() for s in got.subject_id]).sort_values(["stratum", "n", "h"], ascending=[True, False, True])
    assert order.fold.tolist() == [0, 1, 2, 2, 1, 0, 0, 1, 2, 2]


def test_probe_is_the_optimum_of_each_fold(spark):
    rows = planted()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found, probe, table = folds.fold_predictions(df, "label", 3, 1, c=0.5)
    at = {r["unit_id"]: r["fold"] for r in table.collect()}
    x = np.array([[*r[3], 1.0] for r in rows])
    y = np.array([r[2] for r in rows])
    fold = np.array([at[r[0]] for r in rows])
    guess = {r["unit_id"]: r["guess"] for r in found.collect()}
    assert len(guess) == len(rows) and all(probe.settled.values())
    rng = np.random.default_rng(0)
    for f in range(3):
        w = probe.weights[f]
        value, slope = loss(w, x[fold != f], y[fold != f], 0.5)
        assert np.abs(slope).max() < 1e-3
        assert all(loss(w + rng.normal(size=w.shape) * 1e-3, x[fold != f], y[fold != f], 0.5)[0] > value for _ in range(20))
        assert all(guess[i] == (x[i] @ w.T).argmax() for i in np.flatnonzero(fold == f))


def test_scores_by_hand(spark):
    df = spark.createDataFrame([(1, "a", "a"), (1, "a", "b"), (1, "b", "b"), (1, "b", "c"), (2, "a", "a")], "fold int, truth string, guess string")
    got = {r["fold"]: r for r in folds.scores(df, ["fold"]).collect()}
    assert (got[1]["n"], got[1]["accuracy"], got[1]["chance"]) == (4, 0.5, 0.5)
    assert abs(got[1]["macro_f1"] - (2 / 3 + 1 / 2 + 0) / 3) < 1e-12 and abs(got[1]["weighted_f1"] - (2 / 3 + 1 / 2) / 2) < 1e-12
    assert got[2]["macro_f1"] == 1


def test_what_cannot_be_fitted_says_why(spark):
    rows = planted()
    one = spark.createDataFrame([(a, b, 1, v, e) for a, b, _, v, e in rows], SCHEMA)
    assert {r["reason"] for r in folds.fold_probe(one, "label").collect()} == {"one class in the train split"}
    two = spark.createDataFrame([(a, b % 2, c, v, e) for a, b, c, v, e in rows], SCHEMA)
    got = {r["fold"]: r for r in folds.fold_probe(two, "label").collect()}
    assert got[2]["reason"] == "no subject on a side" and got[2]["n_test"] == 0 and got[0]["accuracy"] > 0.4
    none = spark.createDataFrame([], SCHEMA)
    assert [r["n_train"] for r in folds.fold_probe(none, "label").collect()] == [0, 0, 0]
    odd = [(900, 1, None, [0.0] * 5, ""), (901, None, 1, [0.0] * 5, ""), (902, 1, 1, None, ""), (903, 1, 1, [float("nan")] * 5, ""), (904, 1, 1, [None] * 5, "")]
    got = folds.fold_probe(spark.createDataFrame(rows + odd, SCHEMA), "label").agg(F.sum("n_test"), F.min("accuracy")).first()
    assert got[0] == 240 and got[1] > 0.4
