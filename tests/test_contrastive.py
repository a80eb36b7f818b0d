"""Losses against plain sums and finite differences, batches, and towers against a plain loop."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import contrastive as ct

RNG = np.random.default_rng(7)


def plain(kind, a, b, w, s, tau=0.07, tau_target=0.1, off=5e-3):
    n, d = a.shape
    if kind == "barlow":
        total = 0.0
        for i in range(d):
            for j in range(d):
                x, y = a[:, i] - a[:, i].mean(), b[:, j] - b[:, j].mean()
                c = (x / (math.sqrt((x**2).sum() / (n - 1)) + 1e-8) * (y / (math.sqrt((y**2).sum() / (n - 1)) + 1e-8))).sum() / n
                total += (c - 1) ** 2 if i == j else off * c * c
        return total
    sim = lambda i, j: sum(a[i, k] * b[j, k] * (math.exp(2 * s[k]) if kind == "aninfonce" else 1) for k in range(d)) / tau
    total = 0.0
    for i in range(n):
        row, column = [sim(i, j) for j in range(n)], [sim(j, i) for j in range(n)]
        lr, lc = (math.log(sum(math.exp(x - max(v)) for x in v)) + max(v) for v in (row, column))
        if kind == "supcon":
            near = [math.exp((w[i] @ w[j]) / np.linalg.norm(w[i]) / np.linalg.norm(w[j]) / tau_target) for j in range(n)]
            want = [x / sum(near) for x in near]
        else:
            want = [float(i == j) for j in range(n)]
        total -= sum(t * (x - lr + y - lc) for t, x, y in zip(want, row, column, strict=True))
    return total / (2 * n)


@pytest.mark.parametrize("kind", ct.LOSSES)
def test_losses_and_slopes(kind):
    a, b, w, s = (RNG.normal(size=(6, 4)) for _ in range(4))
    a, b, s = ct.unit(a), ct.unit(b), s[0] * 0.2
    loss = ct.Loss(kind)
    value, da, db, ds = loss.of(a, b, w, s)
    assert value == pytest.approx(plain(kind, a, b, w, s), rel=1e-9)
    for x, g in ((a, da), (b, db), (s, ds)):
        for at in np.ndindex(x.shape):
            was, e = x[at], 1e-6
            x[at] = was + e
            up = loss.of(a, b, w, s)[0]
            x[at] = was - e
            down = loss.of(a, b, w, s)[0]
            x[at] = was
            assert g[at] == pytest.approx((up - down) / (2 * e), rel=1e-4, abs=1e-6)


def test_no_scale_is_infonce_and_unknown_kinds_are_refused():
    a, b = ct.unit(RNG.normal(size=(5, 3))), ct.unit(RNG.normal(size=(5, 3)))
    assert ct.Loss("aninfonce").of(a, b, None, np.zeros(3))[0] == pytest.approx(ct.Loss("infonce").of(a, b)[0])
    with pytest.raises(ValueError):
        ct.Loss("other")


def rows(n=90, width=6):
    r = np.random.default_rng(2)
    hidden = r.normal(size=(n, 3))
    left, right = hidden @ r.normal(size=(3, width)) + 0.1 * r.normal(size=(n, width)), hidden @ r.normal(size=(3, width)) + 0.1 * r.normal(size=(n, width))
    return [(i, f"s{i % 4}" if i else "alone", left[i].tolist(), right[i].tolist(), [1.0 + i % 3, 1.0], "x") for i in range(n)]


SCHEMA = "unit_id long, s string, l array<double>, r array<double>, w array<double>, batch string"


def test_batches_hold_every_usable_unit_once(spark):
    odd = [(900, "s0", None, [0.0] * 6, [1.0, 1.0], ""), (901, "s0", [float("nan")] * 6, [0.0] * 6, [1.0, 1.0], ""), (902, "s1", [0.0] * 6, [0.0] * 6, None, "")]
    got = ct.batches(spark.createDataFrame(rows() + odd, SCHEMA), "unit_id", "s", "l", "r", 10, 1, "w").toPandas()
    assert got.n.sum() == 89 and got.n.max() <= 10 and set(got["sample"]) == {"s0", "s1", "s2", "s3"}
    assert got.groupby("sample").n.agg(lambda x: x.max() - x.min()).max() <= 1
    firsts = {tuple(np.round(v[i * 6 : i * 6 + 6], 9)) for v, n in zip(got.left, got.n, strict=True) for i in range(n)}
    assert firsts == {tuple(np.round(r[2], 9)) for r in rows()[1:]}


def test_towers_are_those_of_a_plain_loop(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    train, held = (ct.batches(df.where(c), "unit_id", "s", "l", "r", 16, 1) for c in ("unit_id % 5 <> 0", "unit_id % 5 = 0"))
    loss = ct.Loss("infonce", tau=0.5)
    got = ct.fit(train, held, loss, 2, 3, epochs=6, rate=0.05, patience=3)

    rng = np.random.default_rng(3)
    parts = [rng.normal(size=(6, 2)) / 6**0.5 for _ in range(2)]
    moments = [[np.zeros((6, 2)), np.zeros((6, 2))] for _ in range(2)]
    unpack = lambda t: [(np.reshape(r["left"], (r["n"], 6)), np.reshape(r["right"], (r["n"], 6))) for r in t.collect()]
    fits, checks = unpack(train), unpack(held)

    def mean_loss(ps):
        return np.mean([plain("infonce", ct.unit(x @ ps[0]), ct.unit(y @ ps[1]), None, None, tau=0.5) for x, y in fits])

    for epoch in range(len(got.history)):
        cosine = np.concatenate([(ct.unit(x @ parts[0]) * ct.unit(y @ parts[1])).sum(axis=1) for x, y in checks]).mean()
        assert got.history[epoch][1:] == pytest.approx((mean_loss(parts), cosine), rel=1e-5)
        slopes = []
        for p in parts:
            g = np.zeros_like(p)
            for at in np.ndindex(p.shape):
                was = p[at]
                p[at] = was + 1e-5
                up = mean_loss(parts)
                p[at] = was - 1e-5
                g[at] = (up - mean_loss(parts)) / 2e-5
                p[at] = was
            slopes.append(g)
        for p, g, (m, s) in zip(parts, slopes, moments, strict=True):
            m[:] = 0.9 * m + 0.1 * g
            s[:] = 0.999 * s + 0.001 * g * g
            p -= 0.05 * (m / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(s / (1 - 0.999 ** (epoch + 1))) + 1e-8)
    assert got.history[-1][1] < got.history[0][1] and got.history[got.best][2] == max(h[2] for h in got.history)
    z = ct.embedded(df.withColumn("z_left", F.lit("clash")), got, "l", "r").where("unit_id = 5").first()
    assert z["z_left"] == pytest.approx(ct.unit(np.array([rows()[5][2]]) @ got.left)[0])
