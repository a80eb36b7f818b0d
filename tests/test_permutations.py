"""Computed permutations, and what is built on them: correlations of many cells, bootstrap draws of rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cells, learning, permute


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 16, 17, 101, 1000, 9991])
def test_partners_are_a_bijection(n):
    seen = set()
    for perm in (1, 2, 3):
        x = permute.partners(np.arange(n), n, perm, 3)
        assert sorted(x.tolist()) == list(range(n))
        seen.add(tuple(x.tolist()))
    assert n < 5 or len(seen) == 3


def test_partners_of_some_rows_are_those_of_all():
    every = permute.partners(np.arange(500), 500, 4, 1)
    assert np.array_equal(permute.partners(np.array([7, 499, 0]), 500, 4, 1), every[[7, 499, 0]])


def test_partners_look_dealt():
    x = np.stack([permute.partners(np.arange(50), 50, p, 1) for p in range(1, 4001)])
    at = np.stack([(x == j).sum(axis=0) for j in range(50)])
    assert 35 < at.min() and at.max() < 130  # 80 expected
    assert abs(np.mean([np.corrcoef(np.arange(50), r)[0, 1] for r in x])) < 0.02
    assert (np.diff(x, axis=1) == 1).mean() == pytest.approx(1 / 50, rel=0.15)


def test_partner_columns_are_the_arrays(spark):
    sizes = [1, 2, 3, 7, 17, 50, 101]
    rows = spark.createDataFrame([(n, i, p) for n in sizes for i in range(n) for p in range(4)], "n long, place long, perm int")
    got = {(r["n"], r["place"], r["perm"]): r["x"] for r in rows.withColumn("x", permute.partner(F.col("place"), F.col("n"), F.col("perm"), 3)).collect()}
    assert got == {(n, i, p): int(v) for n in sizes for p in range(4) for i, v in enumerate(permute.partners(np.arange(n), n, p, 3))}


def test_numbers_within_keys(spark):
    rows = spark.range(900).select((F.col("id") % 4).alias("k"), (F.col("id") * 7919 % 1009).alias("o")).withColumn("k", F.when(F.col("k") < 3, F.col("k"))).repartition(7)
    got = permute.numbered(rows, ["k"], ["o"]).collect()
    for k in (0, 1, 2, None):
        own = sorted((r for r in got if r["k"] == k), key=lambda r: r["o"])
        assert [r["place"] for r in own] == list(range(225)) and all(r["n"] == 225 for r in own)
    assert [r["place"] for r in sorted(permute.numbered(rows, [], ["o", "k"]).collect(), key=lambda r: r["place"])] == list(range(900))


def test_draws_have_rows_once_on_average():
    w = np.concatenate([permute.poisson(np.arange(5000), r, 2) for r in range(1, 21)])
    assert w.mean() == pytest.approx(1, abs=0.02) and w.var() == pytest.approx(1, abs=0.03) and (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)


def _top(z, y):
    a, b = z - z.mean(0), y - y.mean(0)
    (qa, ra), (qb, rb) = np.linalg.qr(a), np.linalg.qr(b)
    u, s, vt = np.linalg.svd(qa.T @ qb)
    return s[0], np.linalg.solve(ra, u[:, 0]), np.linalg.solve(rb, vt[0])


def _brute(rows, n_perms, seed):
    rows = sorted(rows, key=lambda x: (x[2] != "train", x[1]))
    z, y, train = np.array([x[3] for x in rows]), np.array([x[4] for x in rows]), np.array([x[2] == "train" for x in rows])
    n, m = len(rows), int(train.sum())
    r_full = _top(z, y)[0]
    full = np.array([_top(z, y[permute.partners(np.arange(n), n, p, seed)])[0] for p in range(1, n_perms + 1)])
    score = lambda a, b: np.corrcoef(z[~train] @ a, y[~train] @ b)[0, 1]
    r_train, a, b = _top(z[train], y[train])
    part = np.array([score(*_top(z[train], y[train][permute.partners(np.arange(m), m, p, seed + 1)])[1:]) for p in range(1, n_perms + 1)])
    r_test = score(a, b)
    return n, m, n - m, r_full, r_train, r_test, (r_full - full.mean()) / full.std(), (1 + (full >= r_full).sum()) / (1 + n_perms), (r_test - part.mean()) / part.std(), (1 + (abs(part) >= abs(r_test)).sum()) / (1 + n_perms)


@pytest.mark.parametrize("held", [8_000_000, 1])
def test_cells_against_plain_numpy(spark, monkeypatch, held):
    monkeypatch.setattr(cells, "HELD_NUMBERS", held)
    monkeypatch.setattr(cells, "OPEN_NUMBERS", 100)
    rng = np.random.default_rng(0)
    rows = []
    for run, n in (("a", 60), ("b", 45)):
        z = rng.normal(size=(n, 3))
        y = np.stack([z[:, 0] + rng.normal(size=n), rng.normal(size=n)], 1)
        rows += [(run, i * 7 % 101, "train" if i % 3 else "test", z[i].tolist(), y[i].tolist()) for i in range(n)]
    extra = [("a", 200, "train", [1.0, None, 2.0], [1.0, 2.0]), ("b", 201, "test", [1.0, 3.0, 2.0], [float("nan"), 2.0])]
    got = {r["run"]: r for r in cells.study(spark.createDataFrame(rows + extra, "run string, u long, part string, z array<double>, y array<double>").repartition(3), ["run"], "u", 15, 5).collect()}
    for run in ("a", "b"):
        assert np.allclose(np.array(got[run][1:], float), np.array(_brute([x for x in rows if x[0] == run], 15, 5), float))


def test_small_parts_and_flat_targets_have_no_answer(spark):
    rows = [("x", i, "train" if i else "test", [float(i), float(i * i)], [float(i % 2)]) for i in range(8)] + [("flat", i, "train" if i % 2 else "test", [float(i), float(i * i)], [1.0]) for i in range(8)]
    got = {r["run"]: r for r in cells.study(spark.createDataFrame(rows, "run string, u long, part string, z array<double>, y array<double>"), ["run"], "u", 5, 1).collect()}
    assert got["x"]["n_test"] == 1 and np.isnan(got["x"]["r_test"]) and got["x"]["r_full"] > 0
    assert got["flat"]["r_full"] == 0.0 and np.isnan(got["flat"]["r_test"])


def test_held_out_subjects_are_those_of_all_runs(spark):
    u = spark.createDataFrame([(r, s) for r in "ab" for s in range(10)] + [("a", None)], "run string, s int")
    first = sorted(x["s"] for x in cells.held_out(u, "s", 4, 1).collect())
    assert len(first) == 4 and first == sorted(x["s"] for x in cells.held_out(u.where("run = 'b'"), "s", 4, 1).collect())


def test_cka_of_draws(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(80, 3)), rng.normal(size=(80, 2))
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "k long, a array<double>, b array<double>").repartition(3)
    got = {r["rep"]: r["value"] for r in learning.cka_draws(df, "k", "a", "b", 6, 4).collect()}
    xc, yc = x - x.mean(0), y - y.mean(0)
    for rep in range(1, 7):
        w = permute.poisson(np.arange(80), rep, 4)[:, None]
        want = np.linalg.norm(xc.T @ (w * yc)) ** 2 / (np.linalg.norm(xc.T @ (w * xc)) * np.linalg.norm(yc.T @ (w * yc)) + 1e-12)
        assert got[rep] == pytest.approx(want)
