"""Stratified draws, coherence of labels, random projections, pins and scope."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import artifacts, coherence, permute


def test_draw_keeps_a_least_number_of_each_class(spark):
    rows = [(i, "big" if i < 900 else "small" if i < 990 else "rare" if i < 999 else "one") for i in range(1000)] + [(1000, None)]
    df = spark.createDataFrame(rows, "k long, c string").repartition(5)
    got = coherence.stratified(df, "c", "k", 50, 3).collect()
    assert Counter(r["c"] for r in got) == {"big": 45, "small": 4, "rare": 2, "one": 1}  # 4.5 rounds to even
    assert sorted(r["k"] for r in got) == sorted(r["k"] for r in coherence.stratified(df.coalesce(1), "c", "k", 50, 3).collect())
    assert {r["k"] for r in got} != {r["k"] for r in coherence.stratified(df, "c", "k", 50, 4).collect()}
    assert coherence.stratified(df, "c", "k", 5000, 3).count() == 1000 and coherence.stratified(df.limit(0), "c", "k", 5, 1).count() == 0


def test_coherence_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 3, 60)
    x = rng.normal(size=(60, 4)) + 1.5 * np.eye(4)[y]
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x))], "k long, c int, v array<double>").repartition(3)
    r = coherence.coherence(df, "c", "k", 1000, 20, 2).first()  # all units are drawn
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.triu_indices(60, 1)
    cos = (u @ u.T)[i, j]
    delta = lambda c: cos[c[i] == c[j]].mean() - cos[c[i] != c[j]].mean()
    null = np.array([delta(y[permute.partners(np.arange(60), 60, p, 2)]) for p in range(1, 21)])
    assert r["n"] == 60 and r["n_same"] == (y[i] == y[j]).sum() and r["delta"] == pytest.approx(delta(y))
    assert r["z"] == pytest.approx((delta(y) - null.mean()) / null.std()) and r["p"] == pytest.approx((1 + (abs(null) >= abs(delta(y))).sum()) / 21)


def test_coherence_of_one_class_has_no_other_pairs(spark):
    df = spark.createDataFrame([(i, 1, [1.0, float(i)]) for i in range(6)], "k long, c int, v array<double>")
    r = coherence.coherence(df, "c", "k", 6, 5, 1).first()
    assert r["n_different"] == 0 and r["different"] == 0.0 and r["p"] == 1.0


def test_random_projection_is_one_matrix_everywhere(spark):
    g = coherence.gaussian(400, 50, 3)
    assert abs(g.mean()) < 0.01 and g.std() == pytest.approx(1 / np.sqrt(50), rel=0.02) and np.abs(np.corrcoef(g[:, :5].T) - np.eye(5)).max() < 0.2
    x = np.random.default_rng(1).normal(size=(40, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    for parts in (1, 5):
        got = {r["k"]: r["z"] for r in coherence.random_projection(df.repartition(parts), "v", 3, 9).collect()}
        z = x @ coherence.gaussian(6, 3, 9)
        assert np.allclose([got[i] for i in range(40)], z / np.linalg.norm(z, axis=1, keepdims=True))


def test_pins_tell_changed_from_missing(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, text in (("a/kept", "1"), ("a/changed", "2"), ("extra", "3"), ("loose", "4")):
        (tmp_path / name).write_text(text)
    found = artifacts.addressed(spark, f"file://{tmp_path}")
    sha = {r["path"]: r["sha256"] for r in found.collect()}
    assert set(sha) == {"a/kept", "a/changed", "extra", "loose"}
    declared = spark.createDataFrame([("a/kept", sha["a/kept"]), ("a/changed", sha["extra"]), ("gone", "x"), ("loose", None)], "path string, sha256 string")
    pinned = artifacts.pins(declared, found)
    assert {r["path"]: r["status"] for r in pinned.collect()} == {"a/kept": "pinned", "a/changed": "changed", "extra": "undeclared", "gone": "missing", "loose": "unpinned"}
    uses = spark.createDataFrame([("m", "a/kept"), ("m", "loose"), ("k", "a/kept"), ("k", "gone"), ("j", "nowhere")], "method_id string, path string")
    guards = spark.createDataFrame([(m, "biological") for m in "mkjo"], "method_id string, verdict string")
    assert {r["method_id"]: r["status"] for r in artifacts.verdicts(guards, pinned, uses).collect()} == {"m": "biological", "k": "unpinned_evidence", "j": "unpinned_evidence", "o": "biological"}


def test_scope_of_a_grid(spark):
    cells = spark.createDataFrame([(r, m) for r in ("r1", "r2") for m in ("ari", "cka", "none", "off")], "run string, metric string")
    templates = spark.createDataFrame([("ari", "{run}/ari.json"), ("ari", "shared.tsv"), ("cka", "{run}/cka.json"), ("off", "{run}/off.json")], "metric string, template string")
    off = spark.createDataFrame([("off", "no such assay")], "metric string, reason string")
    found = spark.createDataFrame([("r1/ari.json",), ("shared.tsv",), ("r2/cka.json",), ("r1/off.json",)], "path string")
    got = {(r["run"], r["metric"]): (r["status"], r["lacking"]) for r in artifacts.scope(cells, templates, off, found).collect()}
    assert got["r1", "ari"] == ("fillable", []) and got["r2", "ari"] == ("missing", ["r2/ari.json"]) and got["r1", "cka"][0] == "missing" and got["r2", "cka"][0] == "fillable"
    assert got["r1", "none"] == ("undeclared", []) and got["r1", "off"][0] == "not_available"
    assert artifacts.scope(cells, templates, off, found).where(F.col("status") == "not_available").count() == 2
