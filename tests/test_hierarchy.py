"""Ward's tree and the rank test against plain Python."""

import numpy as np
import pytest

from tessera.operators import hierarchy, ranks, similarity, statistics


def _plain_ward(x):
    """The closest pair each time, by the increase of squared distances."""
    held, out = {i: (1, v) for i, v in enumerate(x)}, []
    while len(held) > 1:
        cost, a, b = min((n * m / (n + m) * float(((u - v) ** 2).sum()), i, j) for i, (n, u) in held.items() for j, (m, v) in held.items() if i < j)
        (n, u), (m, v) = held.pop(a), held.pop(b)
        held[a] = (n + m, (n * u + m * v) / (n + m))
        out.append((a, b, np.sqrt(2 * cost), n + m))
    return out


@pytest.mark.parametrize("kind", ["scattered", "line", "blobs"])
def test_ward_is_the_closest_pair_each_time(spark, monkeypatch, kind):
    monkeypatch.setattr(similarity, "SIDE_BYTES", 200)
    rng = np.random.default_rng(4)
    x = {"scattered": rng.normal(size=(24, 3)), "line": np.array([[2.0**i] for i in range(7)]), "blobs": np.concatenate([rng.normal(c, 0.3, (6, 2)) for c in (0, 5, 9)])}[kind]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "unit_id long, v array<double>")
    merges = hierarchy.ward(df)
    got = sorted(((r["kept"], r["gone"], r["height"], r["size"]) for r in merges.collect()), key=lambda r: r[2])
    want = sorted(_plain_ward(x), key=lambda r: r[2])
    assert [(a, b, n) for a, b, _, n in got] == [(a, b, n) for a, b, _, n in want] and np.allclose([r[2] for r in got], [r[2] for r in want])
    if kind == "blobs":
        labels = {r["unit_id"]: r["cluster"] for r in hierarchy.cut(df, merges, 3).collect()}
        assert [labels[i] for i in range(18)] == [0] * 6 + [6] * 6 + [12] * 6
        assert len({r["cluster"] for r in hierarchy.cut(df, merges, 18).collect()}) == 18 and {r["cluster"] for r in hierarchy.cut(df, merges, 1).collect()} == {0}


def test_ward_of_one_or_none(spark):
    one = spark.createDataFrame([(1, [1.0])], "unit_id long, v array<double>")
    assert hierarchy.ward(one).count() == 0 and hierarchy.ward(one.limit(0)).count() == 0
    assert [tuple(r) for r in hierarchy.cut(one, hierarchy.ward(one), 2).collect()] == [(1, 1)]


def test_kruskal_with_ties(spark, monkeypatch):
    monkeypatch.setattr(ranks, "RUN", 3)
    rows = [("a", x) for x in (1, 2, 2, 5, 9)] + [("b", x) for x in (2, 3, 3, 8)] + [("c", x) for x in (7, 8, 9, 9, 10)] + [(None, 1), ("a", None)]
    df = spark.createDataFrame([(g, None if x is None else float(x)) for g, x in rows], "g string, x double")
    good = [(g, x) for g, x in rows if g and x is not None]
    values = sorted(x for _, x in good)
    rank = {v: np.mean([i + 1 for i, y in enumerate(values) if y == v]) for v in set(values)}
    n = len(values)
    h = 12 / (n * (n + 1)) * sum(sum(rank[x] for k, x in good if k == g) ** 2 / sum(k == g for k, _ in good) for g in "abc") - 3 * (n + 1)
    h /= 1 - sum(values.count(v) ** 3 - values.count(v) for v in set(values)) / (n**3 - n)
    r = hierarchy.kruskal(df, "g", "x").first()
    assert (r["n"], r["groups"]) == (n, 3) and r["statistic"] == pytest.approx(h) and r["p"] == pytest.approx(np.exp(-h / 2))
    assert np.isnan(hierarchy.kruskal(df.where("g = 'a'"), "g", "x").first()["p"]) and np.isnan(hierarchy.kruskal(df.where("x = 2"), "g", "x").first()["p"])


@pytest.mark.parametrize("x", [0.0, 0.3, 2.0, 9.0, 40.0])
def test_chi_square_tail(x):
    assert hierarchy.chi_square_tail(x, 2) == pytest.approx(np.exp(-x / 2)) and hierarchy.chi_square_tail(x, 4) == pytest.approx(np.exp(-x / 2) * (1 + x / 2))
    assert hierarchy.chi_square_tail(x, 6) == pytest.approx(np.exp(-x / 2) * (1 + x / 2 + x * x / 8))


def test_ranks_and_sums_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranks, "RUN", 4)
    rng = np.random.default_rng(2)
    rows = [(int(k), float(v) if v < 9 else None) for k, v in zip(rng.integers(0, 3, 60), rng.integers(0, 10, 60))]
    df = spark.createDataFrame(rows, "k int, x double").repartition(5)
    for r in ranks.midranks(df, ["k"], "x", "r").collect():
        own = [v for k, v in rows if k == r["k"] and v is not None]
        assert r["r"] == (None if r["x"] is None else sum(v < r["x"] for v in own) + (sum(v == r["x"] for v in own) + 1) / 2)


def test_auc_of_scores_of_any_spread(spark, monkeypatch):
    monkeypatch.setattr(ranks, "RUN", 5)
    rng = np.random.default_rng(7)
    score = np.round(np.concatenate([rng.normal(0, 1e-6, 30), rng.normal(0, 1e9, 30), np.full(10, 5.0)]), 7)
    positive = rng.random(70) < 0.4
    r = statistics.auc(spark.createDataFrame([(float(s), bool(p)) for s, p in zip(score, positive)], "score double, positive boolean")).first()
    a, b = score[positive][:, None], score[~positive][None, :]
    assert r["auc"] == pytest.approx(((a > b) + 0.5 * (a == b)).mean()) and (r["n_pos"], r["n_neg"]) == (positive.sum(), (~positive).sum())
