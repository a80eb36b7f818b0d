"""Guards inside proposals, who wrote what, gates on hypotheses, batch structure, searches in many cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import batches, promotion, similarity

CAND = "task_id string, axis int, higher_is_better boolean, method_id string, value double, ci_lo double, ci_hi double"


def test_blocked_methods_win_nothing(spark):
    c = spark.createDataFrame(
        [
            ("a", 0, True, "best", 9.0, 8.9, 9.1), ("a", 0, True, "next", 7.0, 6.9, 7.1), ("a", 0, True, "tied", 6.9, 6.8, 7.0), ("a", 0, True, "low", 1.0, None, None),
            ("b", 0, True, "x", 3.0, None, None), ("c", 0, False, "x", 3.0, None, None), ("c", 0, False, "y", 2.0, None, None), ("d", 0, True, "x", 5.0, None, None),
        ], CAND,
    )
    bars = spark.createDataFrame([("a", 0, 2.0), ("b", 0, 3.0), ("d", 0, 1.0)], "task_id string, axis int, floor double")
    guards = spark.createDataFrame([("a", "best", True), ("d", "x", True), ("c", "x", False)], "task_id string, method_id string, contraindicated boolean")
    got = {r["task_id"]: r for r in promotion.propose(c, bars, guards).collect()}
    assert got["a"]["outcome"] == "tie" and got["a"]["tied"] == ["next", "tied"] and got["a"]["margin"] == pytest.approx(0.1) and got["a"]["best"] == "best" and got["a"]["winner"] is None
    assert got["b"]["outcome"] == "refuse" and got["b"]["refusal"] == "no candidate clears the floor" and got["b"]["best_value"] == 3.0
    assert got["c"]["outcome"] == "recommend" and got["c"]["winner"] == "y" and got["c"]["margin"] == 1.0
    assert got["d"]["outcome"] == "refuse" and got["d"]["refusal"] == "every candidate is contraindicated by a guard"


def test_ratio_guard_needs_its_inputs(spark):
    tasks = spark.createDataFrame([("a", "G3", None), ("b", "G3", 2.0), ("c", "G5", None), ("d", None, None)], "task_id string, guard string, floor double")
    inputs = spark.createDataFrame([(t, m, b, c) for t in "abcd" for m, b, c in (("hi", 3.0, 2.0), ("lo", 1.0, 2.0), ("zero", 1.0, 0.0), ("none", None, 1.0))], "task_id string, method_id string, biology_z double, confounder_z double")
    got = {(r["task_id"], r["method_id"]): (r["status"], r["contraindicated"]) for r in promotion.task_guards(tasks, inputs).collect()}
    assert got["a", "hi"] == ("pass", False) and got["a", "lo"] == ("fail", True) and got["a", "zero"] == ("pass", False) and got["a", "none"] == ("not_run", False)
    assert got["b", "hi"] == ("fail", True) and got["c", "lo"] == ("not_run", False) and ("d", "hi") not in got


def test_measurements_are_not_typed(spark):
    rows = [("t", "ok", "1.5e-3", "[0, 1]"), ("t", "plain", "-2", None), ("t", "prose", "about 2", None), ("t", "none", None, None), ("t", "one", "2", "[1]"), ("t", "text", "2", "wide")]
    got = {r["method_id"]: r["reason"] for r in promotion.authored(spark.createDataFrame(rows, "task_id string, method_id string, value string, ci string")).collect()}
    assert got == {"prose": "value is not a number", "none": "value is not a number", "one": "ci is not an interval", "text": "ci is not an interval"}


def test_recorded_circularity_is_derived_again(spark):
    rows = [("m", v, t, True, q, 7, clean) for v, clean in (("he", True), ("st", True)) for t, q in (("p", 0.01), ("q", 0.2), ("r", None))] + [("k", "st", "p", True, 0.01, 7, False), ("k", "he", "p", False, 0.01, 8, True)]
    results = spark.createDataFrame(rows, "method_id string, view string, test string, testable boolean, q double, n_test int, view_clean boolean")
    features = spark.createDataFrame([("m", "path"), ("k", "other")], "method_id string, feature string")
    runs, guards = promotion.pathway_gate(results, features, "he", "path")
    got = {r["method_id"]: r for r in runs.collect()}
    assert got["m"]["n_significant"] == 1 and got["m"]["significant"] == ["p"] and not got["m"]["circular"] and got["m"]["n_disagreeing"] == 1
    assert got["k"]["excluded"] == ["p"] and got["k"]["n_disagreeing"] == 1
    g = guards.first()
    assert (g["held_out"], g["circular_supervision"], g["n_disagreeing"], g["headline_affected"]) == ("fail", "flag_disagreement", 2, False)
    runs, guards = promotion.pathway_gate(results, features, "st", "path", clean_view="he")
    assert {r["method_id"]: r["circular"] for r in runs.collect()} == {"m": True, "k": False} and guards.first()["headline_affected"]


def _counts(spark, shift):
    rng = np.random.default_rng(3)
    rows, units = [], []
    for s in range(8):
        for u in range(4):
            units.append((s, s * 10 + u))
            for g in range(30):
                c = rng.poisson(2 + (6 if shift(s) and g < 10 else 0))
                if c:
                    rows.append((s, s * 10 + u, f"g{g}", float(c)))
    return rows, units


def test_batch_structure_compares_origin_with_biology(spark):
    variables = spark.createDataFrame([(s, n, k, v) for s in range(8) for n, k, v in (("site", "technical", str(s % 2)), ("kind", "biological", str(s // 4)), ("one", "technical", "x"))], "sample_id int, variable string, kind string, value string")
    for shift, status in ((lambda s: s % 2, "fail"), (lambda s: s // 4, "pass")):
        rows, units = _counts(spark, shift)
        c, u = spark.createDataFrame(rows, "sample_id int, unit_id int, gene string, count double"), spark.createDataFrame(units, "sample_id int, unit_id int")
        found, verdict = batches.batch_structure(c, u, variables, most_components=3)
        dense = np.zeros((8, 30))
        for s, _, g, x in rows:
            dense[s, int(g[1:])] += x / 4
        x = np.log1p(dense)
        _, _, vt = np.linalg.svd(x - x.mean(0))
        coords = (x - x.mean(0)) @ vt[:3].T
        d = np.linalg.norm(coords[:, None] - coords[None], axis=-1)
        want = {}
        for name, label in (("site", np.arange(8) % 2), ("kind", np.arange(8) // 4)):
            a = np.array([d[i][(label == label[i]) & (np.arange(8) != i)].mean() for i in range(8)])
            b = np.array([d[i][label != label[i]].mean() for i in range(8)])
            want[name] = np.mean((b - a) / np.maximum(a, b))
        got = {r["variable"]: r for r in found.collect()}
        assert all(got[n]["silhouette"] == pytest.approx(want[n], abs=1e-4) for n in want) and got["one"]["silhouette"] is None and got["one"]["note"]
        assert verdict.first()["status"] == status and verdict.first()["n_components"] == 3
    two = batches.batch_structure(c.where("sample_id < 2"), u.where("sample_id < 2"), variables)[1].first()
    assert two["status"] == "not_run" and two["n_samples"] == 2
    none = batches.batch_structure(c, u, variables.where("variable = 'one'"))[1].first()
    assert none["status"] == "fail" and none["reason"] == "no technical variable was assessable"


def test_searches_over_many_cells_are_exact(spark, monkeypatch):
    monkeypatch.setattr(similarity, "SIDE_BYTES", 4 * 8 * 40)
    monkeypatch.setattr(similarity, "STRIPE", 7)
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(150, 4)), rng.normal(size=(150, 4))
    x[20:25] = x[20]  # ties
    x[30] = 0
    df = spark.createDataFrame([(i, i % 3, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "unit_id long, s int, v array<double>, w array<double>")
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    sim = unit(x) @ unit(x).T
    np.fill_diagonal(sim, -np.inf)
    want = np.lexsort((np.broadcast_to(np.arange(150), sim.shape), -np.round(sim, 12)), axis=1)[:, :5]
    got = {}
    for r in similarity.nearest_vectors(df, 5).collect():
        got.setdefault(r["unit_id"], {})[r["pos"]] = r["neighbour"]
    assert all([got[i][p] for p in range(1, 6)] == want[i].tolist() for i in range(150))
    some = similarity.nearest_vectors(df, 5, queries=df.where("unit_id % 20 = 0")).collect()
    assert {r["unit_id"] for r in some} == set(range(0, 150, 20)) and len(some) == 40
    cross = np.round(unit(x) @ unit(y).T, 12)
    for keys, same in (([], np.ones((150, 150), bool)), (["s"], np.arange(150)[:, None] % 3 == np.arange(150)[None] % 3)):
        ranks = {r["unit_id"]: r for r in similarity.retrieval(df, "v", "w", keys).collect()}
        for i in range(0, 150, 7):
            other = same[i] & (np.arange(150) != i)
            assert ranks[i]["rank"] == 1 + (cross[i][other] > cross[i, i] + 1e-12).sum() and ranks[i]["mean_other"] == pytest.approx(cross[i][other].mean(), abs=1e-9)
    base = similarity.retrieval_baselines(similarity.retrieval(df, "v", "w", ["s"]), ["s"]).first()
    assert base["n"] == 50 and base["random_mrr"] == pytest.approx(sum(1 / i for i in range(1, 51)) / 50) and base["random_r5"] == 0.1


def test_held_out_gate_wants_one_number_of_subjects(spark):
    runs = lambda *n: spark.createDataFrame([(f"m{i}", x, 0.1 * i) for i, x in enumerate(n)], "method_id string, n_subjects int, probe double")
    status = lambda df, n, least=5: promotion.held_out_gate(df, n, least).first()["status"]
    assert status(runs(8, 8), 8) == "pass" and status(runs(8, 7), 8) == "fail" and status(runs(8, None), 8) == "fail" and status(runs(4, 4), 4) == "fail" and status(runs(8), 7) == "fail"
    assert promotion.held_out_gate(runs(8, 8), 8).select(F.round("strongest", 3)).first()[0] == 0.1
