"""Ratios and foreground of niches: made by unit from lists, the same as gene by gene."""

import math
import statistics

import pytest

from tessera.operators import setscore
from tessera.plans import summaries

SF = "/root/testdata/sf0.001"
ROWS = [
    ("s", 1, "b", 2.0), ("s", 1, "a", 2.0), ("s", 1, None, 1.0), ("s", 1, "c", None), ("s", 2, "a", 5.0), ("s", 2, "b", 0.5), ("s", 2, "d", -3.0), ("s", 3, "a", 1.25), ("s", 3, "e", 4.0), ("s", 3, "e", 6.0), ("s", 3, "e", 9.0), ("s", 3, "e", 2.0),
    ("s", 4, "d", -1.0), ("t", 1, "a", 7.0), ("t", 2, "é", 1.0), ("t", 2, "z", 1.0), ("t", 2, "Z", 1.0), ("t", 2, "n", float("nan")), (None, 5, "a", 1.0),
]
MEMBERS = [("s", 1, 1), ("s", 1, 2), ("s", 1, 3), ("s", 2, 2), ("s", 2, 3), ("s", 2, 2), ("s", 3, 3), ("s", 4, 4), ("s", 9, 8), ("t", 1, 1), ("t", 1, 2), ("t", 2, 2), ("u", 1, 1)]
K = 2


def _frames(spark):
    values = spark.createDataFrame(ROWS, "sample_id string, unit_id long, gene string, value double")
    return spark.createDataFrame(MEMBERS, "sample_id string, unit_id long, member long"), values


def _expected():
    lists = {}
    for s, u, m in MEMBERS:
        for s2, u2, g, v in ROWS:
            if (s2, u2) == (s, m):
                lists.setdefault((s, u, g), []).extend([] if v is None else [v])
    out = {}
    for key, l in lists.items():
        if any(math.isnan(x) for x in l):
            continue
        f = l + [0.0] * (K + 1 - len(l))
        mean, med = sum(sorted(f)) / (K + 1), statistics.median(f)
        out[key] = (mean, statistics.median([abs(x - med) for x in f]) / (mean + 1e-9))
    return out


@pytest.fixture(params=[2, 3, 10_000])
def batches(spark, request):
    """Units that lie in several batches, and one batch for all."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ratios_are_those_of_each_gene(spark, batches):
    got = {tuple(r[:3]): (r["mean"], r["ratio"]) for r in setscore.variability(*_frames(spark), K).collect()}
    nan = {k for k in got if k[2] == "n"}
    assert nan == {("t", 1, "n"), ("t", 2, "n")} and all(math.isnan(got[k][0]) for k in nan)
    want = _expected()
    assert {k: v for k, v in got.items() if k not in nan} == {k: pytest.approx(v, rel=1e-12) for k, v in want.items()}


@pytest.mark.parametrize(("fraction", "least"), [(0.25, 1), (0.5, 2), (1.0, 1)])
def test_lists_are_the_foreground(spark, batches, fraction, least):
    """Against the windows of `foreground`, ties, unnamed genes and numbers that are none included."""
    f = _frames(spark)
    rows = setscore.foreground(setscore.variability(*f, K), fraction, least).orderBy("sample_id", "unit_id", "pos").collect()
    want = {}
    for r in rows:
        want.setdefault((r["sample_id"], r["unit_id"]), []).append((r["gene"], str(r["mean"]), str(r["ratio"])))
    got = {(r[0], r[1]): [(g, str(m), str(x)) for g, m, x in r["top"]] for r in setscore.niche_foreground(*f, K, fraction, least).collect()}
    assert got == want and ("s", 4) not in got


def test_lists_normalise_as_rows_do(spark):
    counts = spark.createDataFrame([r for r in ROWS if r[3] is None or r[3] > 0], "sample_id string, unit_id long, gene string, count double")
    rows = {(r[0], r[1], r["gene"], r["count"]): r["value"] for r in setscore.log_normalise(counts, 1e4).collect()}
    lists = setscore.log_normalised_lists(counts, 1e4, counts.count()).selectExpr("sample_id", "unit_id", "inline(l)").collect()
    assert sorted(map(str, ((r[0], r[1], r["gene"], r["value"]) for r in lists))) == sorted(map(str, ((*k[:3], v) for k, v in rows.items())))


def test_rounded_before_they_are_ordered(spark):
    values = spark.createDataFrame([("s", 1, "b", 1.0), ("s", 2, "b", 1.4999999), ("s", 1, "a", 1.0), ("s", 2, "a", 1.4999998)], "sample_id string, unit_id long, gene string, value double")
    members = spark.createDataFrame([("s", 1, 1), ("s", 1, 2)], "sample_id string, unit_id long, member long")
    first = lambda digits: setscore.niche_foreground(members, values, 2, 0.0, 1, digits=digits).first()["top"][0]["gene"]
    assert (first(None), first(3)) == ("b", "a")


def test_no_gene_is_a_row_of_a_window(spark):
    """Windows and lists by gene made most of the seconds of foreground_sets; the one window left is the ring's, by unit."""
    plan = summaries.foreground_sets(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "MapInArrow" in plan
