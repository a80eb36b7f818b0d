"""Cases with known results, and properties that must hold."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import constraints, evidence, gram, learning, ledger, nichejoin, nulls, rules, setscore, similarity, statistics, tables, units
from tessera.operators.tables import materialise
from tessera.sources import readers


def test_vector_policies(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "i int, v array<double>")
    for policy in ("clip", "keep", "add"):
        rows = {r["i"]: r["u"] for r in df.select("i", V.l2_normalise(F.col("v"), policy=policy).alias("u")).collect()}
        assert np.allclose(rows[1], [0.6, 0.8]) and rows[2] == [0.0, 0.0]


def test_spatial_neighbours_are_exact_for_uneven_points(spark):
    rng = np.random.default_rng(1)
    points = [(s, s * 1000 + i, float(x), float(y)) for s in range(2) for i, (x, y) in enumerate(np.concatenate([rng.normal(0, 1, (40, 2)), rng.normal(900, 300, (15, 2)), np.zeros((4, 2))]))]
    points.append((2, 9999, 5.0, 5.0))
    got = similarity.spatial_neighbours(spark.createDataFrame(points, "sample_id long, unit_id long, x double, y double"), 5).collect()
    found = {}
    for r in got:
        found.setdefault(r["unit_id"], {})[r["pos"]] = r["neighbour"]
    for s, u, x, y in points:
        near = sorted((q for q in points if q[0] == s and q[1] != u), key=lambda q: ((x - q[2]) ** 2 + (y - q[3]) ** 2, q[1]))[:5]
        assert found[u] == {0: u} | {i + 1: q[1] for i, q in enumerate(near)}


def _near(points, i, k):
    d = ((points - points[i]) ** 2).sum(axis=1)
    return [int(j) for j in np.lexsort((np.arange(len(points)), d)) if j != i][:k]


def test_no_point_far_out_nor_heap_changes_what_is_compared(spark):
    rng = np.random.default_rng(1)
    flat = rng.uniform(0, 100, (1500, 2))
    cases = {
        "flat": flat, "far": np.vstack([flat, [[1e7, 1e7]]]), "very far": np.vstack([flat, [[1e15, -1e15]]]), "heap": np.vstack([flat, np.full((1500, 2), 50.0)]), "dense": np.vstack([flat, rng.normal(50, 1e-4, (1500, 2))]),
        "twice": np.vstack([flat, flat]), "line": np.stack([np.arange(700.0), np.zeros(700)], 1), "lattice": np.stack([np.arange(900) % 30, np.arange(900) // 30], 1).astype(float),
    }
    rows = [(s, i, float(x), float(y)) for s, name in enumerate(cases) for i, (x, y) in enumerate(cases[name])]
    df = spark.createDataFrame(rows, "sample_id long, unit_id long, x double, y double").repartition(4)
    places = similarity._located(df, 6).withColumn("place", F.monotonically_increasing_id()).persist()
    pairs = {r["sample_id"]: r["n"] for r in similarity._around(places, places).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(pairs[s] < 300 * len(cases[name]) for s, name in enumerate(cases)), pairs
    found = {}
    for r in similarity.spatial_neighbours(df, 6).where("pos > 0").collect():
        found.setdefault((r["sample_id"], r["unit_id"]), {})[r["pos"]] = r["neighbour"]
    for s, name in enumerate(cases):
        for i in [*range(0, len(cases[name]), 37), len(cases[name]) - 1]:
            assert [found[s, i][p] for p in range(1, 7)] == _near(cases[name], i, 6), (name, i)


def test_gram_statistics(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 6))
    y = x[:, :4] @ rng.normal(size=(4, 5)) + 0.1 * rng.normal(size=(200, 5))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "x array<double>, y array<double>")
    xc, yc = x - x.mean(0), y - y.mean(0)
    want = (np.linalg.norm(xc.T @ yc) ** 2) / (np.linalg.norm(xc.T @ xc) * np.linalg.norm(yc.T @ yc))
    assert gram.linear_cka(df, "x", "y") == pytest.approx(want)
    q, _ = np.linalg.qr(rng.normal(size=(5, 5)))
    turned = spark.createDataFrame([(a.tolist(), (b @ q).tolist()) for a, b in zip(x, y)], "x array<double>, y array<double>")
    assert gram.linear_cka(turned, "x", "y") == pytest.approx(want)
    r, _, _ = gram.ridge_cca(df, "x", "y", 3, 1e-9)
    assert (r[:3] > 0.9).all()
    rotated = spark.createDataFrame([(b.tolist(), (b @ q).tolist()) for b in y], "x array<double>, y array<double>")
    assert np.allclose(gram.procrustes(rotated, "x", "y"), q)
    values = np.linalg.eigvalsh(np.cov(x.T))
    assert gram.participation_ratio(df, "x") == pytest.approx(values.sum() ** 2 / (values**2).sum())


def test_neighbourhood_passes_over_absent_units_and_pads(spark):
    edges = spark.createDataFrame([(0, 1, p, n) for p, n in enumerate([1, 2, 3, 4])], "sample_id int, unit_id long, pos int, neighbour long")
    here = spark.createDataFrame([(0, 1), (0, 3)], "sample_id int, unit_id long")
    got = nichejoin.neighbourhood(edges, here, 3).where("unit_id = 1").orderBy("pos").collect()
    assert [r["member"] for r in got] == [1, 3, 1, 1]


def test_subjects_refuse(spark):
    units = spark.createDataFrame([(0, 1)], "sample_id int, unit_id int")
    twice = spark.createDataFrame([(0, "a"), (0, "b")], "sample_id int, subject_id string")
    with pytest.raises(ValueError):
        nichejoin.subject_resolution(units, twice, "mark")
    with pytest.raises(ValueError):
        nichejoin.subject_resolution(units, twice.where("sample_id = 1"), "refuse")


def test_rank_score_ranks_zeros(spark):
    values = spark.createDataFrame([(0, 0, "b", 5.0), (0, 0, "d", 7.0)], "sample_id int, unit_id int, gene string, value double")
    genes = spark.createDataFrame([(g,) for g in "abcde"], "gene string")
    sets = spark.createDataFrame([("x", "a"), ("x", "d"), ("y", "c"), ("y", "e")], "set_id string, gene string")
    got = {r["set_id"]: r["score"] for r in setscore.rank_score(values, genes, sets).collect()}
    assert got == {"x": pytest.approx(1 - (2 + 0) / 2 / 4), "y": pytest.approx(1 - (3 + 4) / 2 / 4)}


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "parent string, child string")
    got = {(r["node"], r["depth"]) for r in setscore.closure(edges, spark.createDataFrame([("a",)], "root string")).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2)}


def test_missing_p_values_leave_the_family(spark):
    p = spark.createDataFrame([("f", 1, 0.01), ("f", 2, 0.04), ("f", 3, None), ("f", 4, 0.03)], "fam string, t int, p double")
    got = {r["t"]: r["q"] for r in statistics.bh_fdr(p, ["fam"], "t", 0.05).collect()}
    assert got[1] == pytest.approx(0.03) and got[4] == pytest.approx(0.04) and got[2] == pytest.approx(0.04) and got[3] is None


def test_bootstrap_needs_two_groups(spark):
    one = spark.createDataFrame([(1, 2.0), (1, 4.0)], "g int, x double")
    r = statistics.group_bootstrap(one, "g", "x", 10, 1).first()
    assert r["mean"] == 3.0 and r["lo"] is None


def test_tie_rules_differ(spark):
    df = spark.createDataFrame([(1.0, 0.9, 1.0, 1.0, 1.1, 1.2)], "v double, l double, h double, v2 double, l2 double, h2 double")
    c = [F.col(x) for x in ("v", "l", "h", "v2", "l2", "h2")]
    assert df.select(rules.ties_with(*c, True)).first()[0] is True
    assert df.select(rules.ties_with(*c, False)).first()[0] is False


EVIDENCE = "method_id int, nmi double, within double, across double, biology_z double, confounder_z double, ratio_floor double, off_cosine double, p double, n_nulls int, circular boolean"


def test_circular_evidence_fails_its_guard(spark):
    e = spark.createDataFrame([(1, None, None, None, None, None, None, None, None, 0, True), (2, 0.5, 0.0, -1.0, 1.0, 0.0, 9.0, 0.51, 0.04, 20, False)], EVIDENCE)
    got = {(r["method_id"], r["guard"]): r["status"] for r in rules.guards(e).collect()}
    assert got[1, "G6"] == "fail" and {v for k, v in got.items() if k[0] == 1 and k[1] != "G6"} == {"not_run"}
    assert [got[2, f"G{i}"] for i in range(1, 7)] == ["pass", "pass", "pass", "fail", "pass", "pass"]


def test_banned_methods_never_lead_and_proposals_refuse(spark):
    c = spark.createDataFrame([("t", 0, True, m, v, None, None) for m, v in (("a", 3.0), ("b", 2.0), ("c", 1.0))], "task_id string, axis int, higher_is_better boolean, method_id string, value double, ci_lo double, ci_hi double")
    bars = spark.createDataFrame([("t", 0, 0.5, 2.5)], "task_id string, axis int, floor double, reference double")
    ban = spark.createDataFrame([("a", "t", True)], "method_id string, task_id string, applies boolean")
    requests = spark.createDataFrame([(1, "t", None, False), (2, "t", "a", False), (3, "t", "a", True), (4, "u", None, False), (5, "t", "b", False), (6, "v", None, False)], "request_id int, task_id string, proposed string, override boolean")
    families = spark.createDataFrame([("t",), ("v",)], "task_id string")
    got = {r["request_id"]: (r["outcome"], r["method_id"], r["shortfall"]) for r in rules.resolve(requests, families, c, bars, ban).collect()}
    assert got == {1: ("recommend", "b", True), 2: ("refuse", None, False), 3: ("override", "a", False), 4: ("escalate", None, False), 5: ("recommend", "b", True), 6: ("escalate", None, False)}


def test_verdicts_have_four_states(spark):
    s = spark.createDataFrame([(1, "G1", "pass"), (1, "G2", "not_run"), (2, "G1", "fail"), (2, "G2", "pass"), (3, "G1", "not_run"), (4, "G1", "pass")], "method_id int, guard string, status string")
    ran = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False), (5, True)], "method_id int, ran boolean")
    assert {r["method_id"]: r["verdict"] for r in rules.verdicts(s, ran).collect()} == {1: "biological", 2: "diagnostic", 3: "unguarded", 4: "not_run", 5: "unguarded"}


def test_advisory_checks_never_gate(spark):
    def gate(*rows):
        df = spark.createDataFrame([("c", i, *r) for i, r in enumerate(rows)], "cohort string, check_id int, rule string, authority string, required boolean, present boolean, value string, calibrated boolean")
        return rules.admissibility(df).first()["gate"]

    assert gate(("is_true", "advisory", True, True, "false", True)) == "proceed"
    assert gate(("is_true", "gate", True, True, None, True)) == "stop" == gate(("is_true", "gate", True, False, None, True))
    assert gate(("is_true", "cohort_calibrated", True, True, "true", False)) == "proceed_with_caution" == gate(("is_true", "gate", False, True, "false", True))
    assert gate(("all_encoders_assessed", "gate", True, True, '{"x": "uncertain"}', True)) == "proceed_with_caution" and gate(("all_encoders_assessed", "gate", True, True, '{"x": "no"}', True)) == "stop"


def test_constraints_ignore_missing_keys(spark):
    child, parent = spark.createDataFrame([(1,), (None,), (7,)], "k int"), spark.createDataFrame([(1,)], "k2 int")
    assert constraints.foreign_key(child, "k", parent, "k2", "r").first()["violations"] == 1


def test_sources(spark, tmp_path):
    with pytest.raises(KeyError):
        readers.load(spark, "no such loader")
    spark.createDataFrame([("x_a1", 1.5)], "id string, v double").write.csv(str(tmp_path / "t"), sep="\t", header=True)
    r = readers.load(spark, "table_one_file", path=str(tmp_path / "t"), schema="id string, v double", key="id", strip_before="_").collect()
    assert [(x["id"], x["v"]) for x in r] == [("a1", 1.5)]
    for s in ("s1", "s2"):
        spark.range(2).write.parquet(str(tmp_path / f"{s}_spots.parquet"))
    with pytest.raises(ValueError):
        readers.load(spark, "parquet_one_file", path=str(tmp_path / "s1_spots.parquet"), columns=["nothing"])
    (tmp_path / "m").mkdir()
    np.save(tmp_path / "m" / "a.npy", np.arange(6.0).reshape(3, 2))
    index = spark.createDataFrame([("a.npy", i, f"u{i}") for i in range(3)], "file string, row long, unit string")
    assert {r["unit"]: r["vec"] for r in readers.load(spark, "npy_with_index", matrices=str(tmp_path / "m"), index=index).collect()}["u2"] == [4.0, 5.0]


def test_permutation_test_keeps_every_key(spark):
    observed = spark.range(100_010).selectExpr("id AS k", "1.0D AS observed")
    nulls = spark.range(100_010).selectExpr("id AS k", "0.0D AS value")
    assert statistics.permutation_test(nulls, observed, ["k"]).count() == 100_010


def _blobs(spark, n=240):
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 6, (3, 5))
    rows = [(i, i % 12, i % 3, (centres[i % 3] + rng.normal(0, 0.5, 5)).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "unit_id long, subject_id int, label int, v array<double>"), np.array([r[3] for r in rows]), np.array([r[2] for r in rows])


def test_clusters_and_probe_find_planted_classes(spark):
    df, x, y = _blobs(spark)
    r = learning.cluster_agreement(df, "label", 3, 1).first()
    assert r["ari"] == pytest.approx(1.0) and r["nmi"] == pytest.approx(1.0)
    d2 = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    a = np.array([d2[i][(y == y[i]) & (np.arange(len(y)) != i)].mean() for i in range(len(y))])
    b = np.array([min(d2[i][y == c].mean() for c in range(3) if c != y[i]) for i in range(len(y))])
    assert r["silhouette"] == pytest.approx(np.mean((b - a) / np.maximum(a, b)))
    # the silhouette is the label's own, not the clusters'
    crossed = df.withColumn("label", (F.col("unit_id") % 2).cast("int"))
    r = learning.cluster_agreement(crossed, "label", 3, 1).first()
    z = np.arange(len(y)) % 2
    a = np.array([d2[i][(z == z[i]) & (np.arange(len(z)) != i)].mean() for i in range(len(z))])
    b = np.array([d2[i][z != z[i]].mean() for i in range(len(z))])
    assert r["silhouette"] == pytest.approx(np.mean((b - a) / np.maximum(a, b))) and abs(r["ari"]) < 0.1
    few = learning.cluster_agreement(df.limit(2), "label", 3, 1).first()
    assert np.isnan(few["ari"]) and np.isnan(few["silhouette"]) and few["reason"]
    split = units.split_subjects(df.withColumn("s", F.lit(0)), "s", 0.25, 3)
    parts = {p["subject_id"]: p["part"] for p in split.collect()}
    p = learning.linear_probe(df, "label", split).first()
    assert sum(v == "test" for v in parts.values()) == 3 and p["accuracy"] == 1.0 and p["n_test"] == 60 and p["chance"] < 0.7


def test_probe_names_why_it_cannot_answer(spark):
    df, _, _ = _blobs(spark, 24)
    one = spark.createDataFrame([(i, "train") for i in range(12)], "subject_id int, part string")
    assert learning.linear_probe(df, "label", one).first()["reason"] == "no subject on a side"
    two = one.withColumn("part", F.when(F.col("subject_id") < 3, "test").otherwise("train"))
    r = learning.linear_probe(df.withColumn("label", F.lit(1)), "label", two).first()
    assert r["reason"] == "one class in the train split" and np.isnan(r["accuracy"])


def test_moran_p_has_both_tails(spark):
    side = 8
    cells = [(0, i * side + j, float(i), float(j), float((i + j) % 2)) for i in range(side) for j in range(side)]
    board = spark.createDataFrame(cells, "sample_id long, unit_id long, x double, y double, value double")
    edges = [(0, a[1], b[1]) for a in cells for b in cells if abs(a[2] - b[2]) + abs(a[3] - b[3]) == 1]
    r = nulls.morans_test(board, spark.createDataFrame(edges, "sample_id long, unit_id long, neighbour long"), 40, 1).first()
    assert r["moran"] == pytest.approx(-1.0) and r["z"] < -5 and r["p"] < 1e-6


def test_slices_differ_by_their_largest_element(spark):
    schema = "unit_id int, v array<double>"
    computed, cached = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0])], schema), spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 4.0]), (4, [1.0, 1.0])], schema)
    r = units.slice_difference(computed, cached, ["unit_id"], "v").first()
    assert (r["rows"], r["only_computed"], r["only_cached"]) == (2, 1, 1) and r["max_abs"] == 2.0 and r["mean_abs"] == pytest.approx(1.0) and r["max_rel"] == pytest.approx(1.0)
    assert r["min_cosine"] == pytest.approx(0.0) and r["mean_cosine"] == pytest.approx(0.5)
    empty = units.slice_difference(computed.limit(0), cached.limit(0), ["unit_id"], "v")
    assert empty.first()["rows"] == 0


def test_neighbours_that_tie_in_the_cached_space_agree(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12, 4))
    x[3:7] = x[3]  # one point four times: which of them is in a list is the sort's doing
    cached = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "unit_id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u @ u.T
    np.fill_diagonal(sim, -np.inf)
    ours = np.lexsort((-np.broadcast_to(np.arange(12), sim.shape), -np.round(sim, 12)), axis=1)[:, :3]  # ties by the larger id
    ours[0] = [11, 10, 9]
    lists = lambda a: spark.createDataFrame([(i, p + 1, int(n)) for i, row in enumerate(a) for p, n in enumerate(row)], "unit_id long, pos int, neighbour long")
    theirs = np.lexsort((np.broadcast_to(np.arange(12), sim.shape), -np.round(sim, 12)), axis=1)[:, :3]
    got = {r["unit_id"]: r for r in units.neighbour_agreement(lists(ours), lists(theirs), cached).collect()}
    for i in range(12):
        a, b = set(ours[i].tolist()), set(theirs[i].tolist())
        tied = a != b and all(abs(sim[i, m] - sim[i, theirs[i, -1]]) <= 1e-6 for m in a ^ b)
        assert (got[i]["same"], got[i]["tied"], got[i]["ordered"]) == (a == b, tied, ours[i].tolist() == theirs[i].tolist())
    shares = units.agreement_shares(units.neighbour_agreement(lists(ours), lists(theirs), cached))
    same = units.slice_difference(cached, cached, ["unit_id"], "v")
    assert units.accepted(same, units.agreement_shares(units.neighbour_agreement(lists(theirs), lists(theirs), cached))).first()["accepted"]
    r = units.accepted(same, shares).first()
    assert not r["accepted"] and r["failed"] == "neighbours"


def test_capacity_lists_every_check(spark):
    rows = [(1, 89.0, 100.0, 7.9, 10.0, 5.0, None), (2, 90.0, 100.0, 8.0, 10.0, 5.0, 5.0), (3, 1.0, None, 1.0, 10.0, 1.0, 0.0), (4, 500.0, None, 9.0, None, 1.0, 2.0)]
    got = {r["plan_id"]: r for r in evidence.capacity(spark.createDataFrame(rows, "plan_id int, disk_gb double, free_gb double, memory_gb double, available_gb double, hours double, limit_hours double")).collect()}
    assert got[1]["verdict"] == "fits" and [c["resource"] for c in got[1]["checks"]] == ["disk", "memory"] and got[1]["not_checked"] == []
    assert got[2]["blocked_by"] == ["disk", "memory", "walltime"] and got[2]["verdict"] == "does_not_fit"
    assert got[3]["verdict"] == "fits" and got[3]["not_checked"] == ["disk"]
    assert got[4]["verdict"] == "fits" and got[4]["not_checked"] == ["disk", "memory"]


def test_encoder_fit_states_ratios_and_kinds(spark):
    declared = spark.createDataFrame([("tile",), ("any",), ("cell",), ("free",), ("new",)], "encoder string")
    encoders = spark.createDataFrame([("tile", "he", True, 50.0, None), ("any", "he", True, None, None), ("cell", "st", True, None, ["cell"]), ("free", "st", False, None, None)], "encoder string, modality string, expects boolean, footprint double, classes array<string>")
    platforms = spark.createDataFrame([("a", 40.0, "cell"), ("b", 60.0, "spot"), ("c", None, None)], "platform string, tile double, class string")
    got = {(r["encoder"], r["platform"]): r for r in evidence.fit(declared, encoders, platforms, spark.createDataFrame([("a",), ("a",)], "platform string")).collect()}
    assert len(got) == 11 and got["tile", "a"]["ratio"] == 0.8 and got["tile", "a"]["shortfall_pct"] == 20.0 and got["tile", "a"]["n_samples"] == 2
    assert got["tile", "b"]["ratio"] == 1.2 and got["tile", "b"]["shortfall_pct"] == 0.0 and got["tile", "c"]["relation"] == "not_stated"
    assert got["any", "a"]["relation"] == "encoder_states_none" and got["any", "c"]["relation"] == "not_stated"
    assert [got["cell", p]["relation"] for p in "abc"] == ["in_class", "out_of_class", "not_stated"]
    assert got["free", None]["relation"] == "encoder_states_none" and got["new", None]["relation"] == "undeclared_encoder"


def test_checks_that_no_section_measured_are_not_applicable(spark):
    rows = spark.createDataFrame([("a", None), ("a", None), ("b", True), ("b", None), ("c", True), ("c", False)], "check_id string, passed boolean")
    assert {r["check_id"]: (r["sections"], r["measured"], r["status"]) for r in units.per_section(rows, "all").collect()} == {"a": (2, 0, "not_applicable"), "b": (2, 1, "pass"), "c": (2, 2, "fail")}
    assert {r["check_id"]: r["status"] for r in units.per_section(rows, "fraction", 0.5).collect()}["c"] == "pass"


def test_directions_are_fitted_on_train_and_scored_on_test(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 4))
    y = x @ [1.0, -2.0, 0.0, 0.5] + rng.normal(0, 0.5, 150)
    df = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "k long, v array<double>, y double")
    train, test = df.where("k < 100"), df.where("k >= 100")
    got, fitted = learning.transfer_correlation(train, test, "v", "y")
    w = np.linalg.lstsq(x[:100] - x[:100].mean(0), y[:100] - y[:100].mean(), rcond=None)[0]
    assert got == pytest.approx(np.corrcoef(x[100:] @ w, y[100:])[0, 1]) and fitted == pytest.approx(np.corrcoef(x[:100] @ w, y[:100])[0, 1])
    views_ = df.select("k", F.slice("v", 1, 2).alias("a"), F.array("y").alias("b"))
    scored = learning.cca_scores(views_, views_, "a", "b", 1, 1e-9).collect()
    best = np.linalg.lstsq(x[:, :2] - x[:, :2].mean(0), y - y.mean(), rcond=None)[0]
    along = (x[:, :2] - x[:, :2].mean(0)) @ best
    sign = np.sign([r["cca_left"][0] for r in sorted(scored, key=lambda r: r["k"])])  # one dimension of length one
    assert np.array_equal(sign, np.sign(along)) or np.array_equal(sign, -np.sign(along))


def test_units_without_coordinates_are_nobodys_neighbour(spark):
    rows = [(0, 1, 0.0, 0.0), (0, 2, 1.0, 0.0), (0, 3, None, 0.0), (0, 4, float("nan"), 1.0), (0, 5, float("inf"), 1.0), (1, 6, None, None)]
    got = {(r["unit_id"], r["pos"]): r["neighbour"] for r in similarity.spatial_neighbours(spark.createDataFrame(rows, "sample_id int, unit_id long, x double, y double"), 2).collect()}
    assert got == {(i, 0): i for i in range(1, 7)} | {(1, 1): 2, (2, 1): 1}


def test_splits_are_of_whole_subjects(spark):
    df = spark.createDataFrame([(i, "a" if i < 8 else "b") for i in range(10) for _ in range(3)], "subject_id int, kind string")
    got = units.split_subjects(df, "kind", 0.25, 7).collect()
    assert {k: sum(r["part"] == "test" for r in got if r["stratum"] == k) for k in "ab"} == {"a": 2, "b": 1} and len(got) == 10
    lone = units.split_subjects(df.where("subject_id < 9"), "kind", 0.25, 7).collect()
    assert sum(r["part"] == "test" for r in lone) == 3


def test_untestable_nulls_say_why(spark):
    p = spark.createDataFrame([(0, 0, "x", [1.0, 0.0]), (1, 1, "y", [0.0, 1.0])], "sample_id int, subject_id int, label string, v array<double>")
    pair = nulls.pairs(p)
    r = nulls.test(*nulls.subject(pair, p, 25, 1), "patient").first()
    assert r["untestable"] == "no pairs of a kind" and r["delta"] is None and r["p"] <= 1
    b = nulls.test(*nulls.biology(pair, p.select("subject_id", "label"), 25, 1), "biology").first()
    assert b["n_different"] == 1 and b["untestable"] == "no pairs of a kind"


def test_readers_are_declared(spark):
    with pytest.raises(KeyError):
        evidence.read("no such reader", spark.range(1))
    assert len(evidence.readers()) == 7
    df = spark.createDataFrame([(1, "z_he", 2.26, False), (2, "z_he", 2.26, None), (3, "z_st", 1.0, True)], "method_id int, view string, z double, significant boolean")
    assert {r["method_id"]: r["value"] for r in evidence.read("signature_z", df).collect()} == {1: 0.0, 2: 2.3}


def test_roles_name_all_that_is_missing(spark):
    with pytest.raises(ValueError, match="a .x., b .y."):
        units.mapped(spark.range(1), {"a": "x", "b": "y", "c": "id"})
    df = spark.createDataFrame([(0.2, 0.5, None), (0.3, 0.3, 0.4), (None, None, None), (0.6, 0.6, 0.1)], "p double, q double, r double")
    assert [r[0] for r in df.select(units.dominant({c: F.col(c) for c in "pqr"}, 0.45)).collect()] == ["q", "mixed", None, "p"]


def test_neighbour_search_shuffles_what_grows_with_the_units(spark):
    rows = [(i % 3, i, float(i % 17), float(i % 13)) for i in range(300)]
    df = spark.createDataFrame(rows, "sample_id int, unit_id long, x double, y double")
    places = materialise(similarity._located(df, 2).withColumn("place", F.monotonically_increasing_id()), "places")
    plan = similarity._around(places, places)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [sample_id" in plan and plan.count("BroadcastExchange") <= 2, plan  # the samples' levels alone, in both shapes of the adaptive plan
    value = df.withColumn("value", F.col("x"))
    edges = materialise(similarity.spatial_neighbours(df, 2), "edges")
    written = materialise(value, "values")
    plan = nichejoin.tokens(materialise(nichejoin.neighbourhood(edges, written, 2), "members"), written.withColumn("v", F.array("x")), "v")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan, plan


def test_products_of_a_search_stay_small(spark, monkeypatch):
    """The memory of a task doesn't follow the number of units it searches."""
    rng, works = np.random.default_rng(4), []
    monkeypatch.setattr(similarity, "in_cells", lambda q, u, a, b, work, schema: works.append(work) or spark.createDataFrame([], schema))
    df = spark.createDataFrame([(1, [1.0, 0.0], [0.0, 1.0])], "unit_id long, v array<double>, w array<double>")
    similarity.nearest_vectors(df, 3)
    similarity.retrieval(df, "v", "w")
    x = rng.integers(-3, 4, (30_000, 2)).astype(float)
    table = pa.table({"unit_id": np.arange(len(x)), "v": list(x), "w": list(x[:, ::-1]), "matched": np.zeros(len(x)), "k": np.zeros(len(x), np.int64)})
    for work in works:
        tracemalloc.start()
        got = work(table.slice(0, 600), table)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 60e6 and got.num_rows in (600, 1800), peak
    own = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    near = works[0](table.slice(0, 5), table).to_pylist()
    for i in range(5):
        s = np.round(own @ own[i], 12)
        s[i] = -np.inf
        assert [r["neighbour"] for r in near if r["unit_id"] == i] == np.lexsort((np.arange(len(s)), -s))[:3].tolist()


def test_records_with_one_shortened_id_are_told_apart(spark):
    old = spark.createDataFrame([("a", "error")], "record_id string, kind string")
    new = spark.createDataFrame([("a", "view"), ("b", "view"), ("b", "view"), ("b", "click")], "record_id string, kind string")
    got = sorted(tuple(r) for r in ledger.append_new(old, new, ("kind",)).collect())
    assert got == [("a", "error"), ("b", "click"), ("b", "view")]
    assert ledger.append_new(old, new).count() == 2


def test_ranks_of_large_groups_are_those_of_small_ones(spark, monkeypatch):
    rows = [(g, float(i * 7 % 5), None if i % 9 == 0 else float(i * i % 11)) for g in ("a", "b", None) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    one = {r["g"]: (r["n"], r["rho"]) for r in statistics.spearman(df, ["g"], "a", "b").collect()}
    monkeypatch.setattr(statistics, "RUN", 10)
    got = statistics.spearman(df, ["g"], "a", "b")
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()  # no group is ranked in one task
    many = {r["g"]: (r["n"], r["rho"]) for r in got.collect()}
    assert set(one) == set(many) == {"a", "b", None} and all(many[g][0] == n and many[g][1] == pytest.approx(rho) for g, (n, rho) in one.items())


def test_moran_means_go_to_the_units(spark, tmp_path):
    """Spark takes a written table's units for smaller than their means and would broadcast them."""
    spark.range(3000).selectExpr("id % 3 AS sample_id", "id AS unit_id", "cast(id % 7 AS double) AS value").write.parquet(f"{tmp_path}/v")
    v = spark.read.parquet(f"{tmp_path}/v")
    edges = v.select("sample_id", "unit_id", ((F.col("unit_id") + 3) % 3000).alias("neighbour"))
    got = statistics.morans_i(v, edges)
    assert got.count() == 3
    assert "rightHint=(strategy=broadcast)" in got._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_follow_the_rows(spark, monkeypatch):
    """A join by unit and what is done by unit after it run in tasks whose number grows with the rows, in one shuffle of the members' rows."""
    monkeypatch.setattr(tables, "TASK_ROWS", 10)
    values = spark.range(300).selectExpr("cast(id % 2 AS int) AS sample_id", "id % 100 AS unit_id", "concat('G', id) AS gene", "cast(1 AS double) AS count")
    members = spark.range(300).selectExpr("cast(id % 2 AS int) AS sample_id", "id % 100 AS unit_id", "(id % 100 + 2 * (id % 3)) % 100 AS member")
    got = setscore.member_sums(members, values)
    assert got.rdd.getNumPartitions() == 90
    assert got.groupBy("sample_id", "unit_id").agg(F.sum("count").alias("s")).agg(F.sum("s")).first()[0] == 900


def test_counts_are_dealt_by_rows_before_they_are_added_up(spark, monkeypatch):
    from tessera.operators import batches

    rows = [(s, u, f"G{g}.1", float(g % 5 + u)) for s in range(3) for u in range(4) for g in range(25)]
    counts = spark.createDataFrame(rows, "sample_id int, unit_id int, gene string, count double")
    mapping = spark.createDataFrame([(f"G{g}", f"S{g % 4}") for g in range(20)], "gene string, symbol string")
    got = lambda: [setscore.gene_axis(counts, mapping, "sum", "drop"), setscore.pseudobulk(counts)]
    values = lambda: [sorted(map(tuple, df.collect())) for df in got()]
    few, held = values(), batches.sample_components(counts, counts, 2)[1]
    monkeypatch.setattr(tables, "TASK_ROWS", 10)
    assert values() == few and np.allclose(np.abs(batches.sample_components(counts, counts, 2)[1]), np.abs(held))
    assert all(df.rdd.getNumPartitions() >= 30 for df in got())  # 300 rows


def test_a_large_mapping_is_not_sent_through_the_driver(spark):
    many = spark.range(200_001).select(F.concat(F.lit("G"), "id").alias("gene"), F.lit("S").alias("symbol"))
    shuffled = lambda df: "merge" in str(tables.shuffled_if_large(df)._jdf.queryExecution().logical().toString()).lower()
    assert shuffled(many) and not shuffled(many.limit(200_000))


@pytest.mark.parametrize(("n", "width", "different"), [(1, 4, 1), (5, 4, 5), (256, 3, 9), (257, 2, 257), (2600, 3, 40), (4700, 3, 4700)])
def test_nearest_of_a_cell_by_brute_force(n, width, different):
    """Copies, its own among them, vectors that are no numbers, and more columns than one product has."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(different, width))[rng.integers(0, different, n)]
    x[::7] = np.nan if n > 100 else x[::7]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own, ids = np.arange(n) * 3, rng.integers(0, n, 30) * 3
    row, col, s = similarity._nearest(x[ids // 3], ids, x.T, own, 6)
    for i, q in enumerate(ids):
        product = np.round(x @ x[q // 3], 12)
        want = sorted((-p, j) for j, p in enumerate(product) if own[j] != q and np.isfinite(p))[:6]
        assert col[row == i].tolist() == [j for _, j in want]
        assert np.allclose(s[row == i], [-p for p, _ in want], atol=1e-11)


def test_few_products_are_ordered(monkeypatch):
    """Only what can reach the k-th found is ordered, not the k first of every product."""
    seen, first = [], similarity._first
    monkeypatch.setattr(similarity, "_first", lambda parts, k: seen.append(sum(len(p[0]) for p in parts)) or first(parts, k))
    x = np.random.default_rng(0).normal(size=(20_000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    similarity._nearest(x[:100], np.arange(100), x.T, np.arange(20_000), 6)
    assert sum(seen) < 100 * 6 * 30 and max(seen) < 100 * 6 * 10
