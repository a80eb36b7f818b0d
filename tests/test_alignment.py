"""Closed-form alignments against numpy, splits in three, effect ratios and silhouettes without pairs."""

import numpy as np
import pytest

from tessera.operators import alignment, batches


def _views(spark, x, y):
    return spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "k long, a array<double>, b array<double>")


def _unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 5)) * [3, 2, 1, 1, 1]
    y = x[:, :4] @ rng.normal(size=(4, 4)) + 0.3 * rng.normal(size=(90, 4))
    return x[:60], y[:60], x[60:], y[60:]


@pytest.mark.parametrize("method", ["cca", "procrustes", "unaligned"])
def test_alignments_of_held_out_rows(spark, data, method):
    x, y, u, v = data
    fit = alignment.fitted(_views(spark, x, y), "a", "b", method, 3)
    got = sorted(alignment.transformed(_views(spark, u, v).repartition(3), fit, "a", "b").collect(), key=lambda r: r["k"])
    zl, zr = np.array([r["z_left"] for r in got]), np.array([r["z_right"] for r in got])
    xc, yc = x - x.mean(0), y - y.mean(0)
    if method == "cca":
        root = lambda c: (lambda w, e: e @ np.diag(np.maximum(w, 1e-4) ** -0.5) @ e.T)(*np.linalg.eigh(c))
        wx, wy = root(xc.T @ xc / 60 + 1e-4 * np.eye(5)), root(yc.T @ yc / 60 + 1e-4 * np.eye(4))
        a, _, bt = np.linalg.svd(wx @ (xc.T @ yc / 60) @ wy, full_matrices=False)
        left, right = wx @ a[:, :3], wy @ bt[:3].T
    else:
        p, q = (np.linalg.svd(m, full_matrices=False)[2][:3].T for m in (xc, yc))
        p, q = (m * np.sign(m[np.abs(m).argmax(axis=0), range(3)]) for m in (p, q))
        a, _, bt = np.linalg.svd((xc @ p).T @ (yc @ q))
        left, right = (p @ a @ bt if method == "procrustes" else p), q
    wl, wr = _unit((u - x.mean(0)) @ left), _unit((v - y.mean(0)) @ right)
    assert np.allclose((zl * zr).sum(1), (wl * wr).sum(1)) and np.allclose(np.abs(zl @ zl.T), np.abs(wl @ wl.T)) and np.allclose(np.linalg.norm(zl, axis=1), 1)
    assert fit.k == 3 and alignment.fitted(_views(spark, x, y), "a", "b", method, 99).k == 4


def test_alignments_refuse(spark, data):
    x, y, _, _ = data
    with pytest.raises(ValueError):
        alignment.fitted(_views(spark, x[:1], y[:1]), "a", "b", "cca", 2)
    with pytest.raises(ValueError):
        alignment.fitted(_views(spark, x, y), "a", "b", "other", 2)


def test_split_in_three(spark):
    rows = [(i, "x" if i < 20 else "y") for i in range(30)] * 2
    got = {r["subject_id"]: (r["stratum"], r["part"]) for r in alignment.three_way_split(spark.createDataFrame(rows, "subject_id int, g string"), "g", 0.2, 0.2, 5).collect()}
    count = lambda g, p: sum(v == (g, p) for v in got.values())
    assert len(got) == 30 and [count("x", p) for p in ("test", "validation", "train")] == [4, 4, 12] and [count("y", p) for p in ("test", "validation", "train")] == [2, 2, 6]


def test_effect_ratio_and_silhouettes_are_those_of_pairs(spark):
    rng = np.random.default_rng(6)
    s, y = rng.integers(0, 4, 80), rng.integers(0, 3, 80)
    x = rng.normal(size=(80, 3)) + 2 * np.eye(3)[y] + s[:, None]
    y[0] = 7  # alone in its class
    df = spark.createDataFrame([(int(a), int(b), v.tolist()) for a, b, v in zip(s, y, x)], "s int, label int, v array<double>")
    c = np.stack([x[s == g].mean(0) for g in range(4)])
    d = 1 - _unit(c) @ _unit(c).T
    inter = d[np.triu_indices(4, 1)].mean()
    intra = np.mean([(1 - _unit(x[s == g]) @ _unit(c[[g]])[0]).mean() for g in range(4)])
    r = batches.effect_ratio(df, "s").first()
    assert r["subjects"] == 4 and r["inter"] == pytest.approx(inter) and r["intra"] == pytest.approx(intra) and r["ratio"] == pytest.approx(inter / intra)

    def plain(x, y):
        d, out = 1 - _unit(x) @ _unit(x).T, []
        for i in range(len(x)):
            same = (y == y[i]) & (np.arange(len(x)) != i)
            a, b = d[i][same].mean() if same.any() else None, min(d[i][y == c].mean() for c in set(y) if c != y[i])
            out.append(0 if a is None else (b - a) / max(a, b))
        return np.mean(out)

    assert batches.cosine_silhouettes(df, "label", []).first()["silhouette"] == pytest.approx(plain(x, y))
    got = {r["s"]: r["silhouette"] for r in batches.cosine_silhouettes(df, "label", ["s"]).collect()}
    assert all(got[g] == pytest.approx(plain(x[s == g], y[s == g])) for g in range(4))
    assert batches.cosine_silhouettes(df.where("label = 1"), "label", ["s"]).count() == 0
