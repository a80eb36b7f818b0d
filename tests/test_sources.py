"""Sources: what is declared, what is pushed, what is refused."""

import json
import pathlib
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import cohort, matrices, readers


@pytest.fixture
def folder(tmp_path):
    for name, n in (("a", 5), ("b-part00000", 3), ("b-part00001", 4), ("c", 0)):
        np.save(tmp_path / f"{name}.npy", (np.arange(n * 6, dtype=np.float64).reshape(n, 6) + ord(name[0])))
    (tmp_path / "other.txt").write_text("x")
    return f"file://{tmp_path}"


def test_matrices_by_range_and_slice(spark, folder):
    df = matrices.read(spark, folder, split_bytes=96)
    rows = df.collect()
    assert len(rows) == 12 and df.rdd.getNumPartitions() == 3 + 2 + 2
    assert all(np.allclose(r["vec"], np.arange(6) + 6 * r["row"] + ord(r["sample_id"])) for r in rows)
    part = matrices.read(spark, folder, ["a"], columns="2:4").where("row = 3").first()
    assert part["vec"] == [18 + 2 + ord("a"), 18 + 3 + ord("a")] and matrices.samples(folder) == ["a", "b", "c"]


def test_conditions_on_samples_leave_other_files_unopened(spark, folder):
    path = folder.removeprefix("file://")
    with open(f"{path}/a.npy", "wb") as f:
        f.write(b"this file can't be opened as a matrix")
    with pytest.raises(Exception):
        matrices.read(spark, folder).count()
    assert matrices.read(spark, folder, ["b"]).count() == 7
    spark.conf.set(matrices.PUSHDOWN, "true")
    try:
        assert matrices.read(spark, folder).where("sample_id = 'b'").count() == 7
        assert matrices.read(spark, folder).where("sample_id IN ('b', 'c') AND row > 1").count() == 3
        assert matrices.read(spark, folder, ["c"]).where("sample_id = 'b'").count() == 0
    finally:
        spark.conf.unset(matrices.PUSHDOWN)


def test_index_must_be_the_files(spark, folder):
    good = [(f, i, f"{f}:{i}") for f, n in (("a.npy", 5), ("b-part00000.npy", 3), ("b-part00001.npy", 4)) for i in range(n)]
    index = lambda rows: spark.createDataFrame(rows, "file string, row long, unit_id string")
    got = matrices.with_index(spark, folder, index(good)).collect()
    assert len(got) == 12 and all(r["unit_id"] == f"{r['file']}:{r['row']}" for r in got)
    for bad in (good[1:], good + [("a.npy", 5, "x")], good[1:] + [("a.npy", 1, "twice")]):
        with pytest.raises(ValueError, match="a.npy: 5 vectors"):
            matrices.with_index(spark, folder, index(bad))


def test_matrices_survive_writing(spark, tmp_path):
    df = spark.range(50).select((F.col("id") % 2).alias("s"), "id", F.array(F.col("id").cast("float"), F.lit(1.0)).alias("vec"))
    index = matrices.write(df, f"file://{tmp_path}/m", "s", "id", rows_in_file=7)
    back = matrices.with_index(spark, f"file://{tmp_path}/m", index)
    assert sorted((r["id"], r["vec"][0], r["sample_id"]) for r in back.collect()) == [(i, float(i), str(i % 2)) for i in range(50)]
    assert len(list(pathlib.Path(tmp_path / "m").glob("*.npy"))) > 4 and not list(pathlib.Path(tmp_path / "m").glob("*.tmp"))


def test_other_arrays_are_refused(spark, tmp_path):
    for x in (np.zeros(3), np.zeros((2, 2), int), np.asfortranarray(np.ones((2, 3)))):
        np.save(tmp_path / "a.npy", x)
        with pytest.raises(ValueError):
            matrices.headers(f"file://{tmp_path}")
    with open(tmp_path / "a.npy", "wb") as f:
        out = BytesIO()
        np.save(out, np.ones((4, 2)))
        f.write(out.getvalue()[:-8])
    with pytest.raises(Exception, match="ends before"):
        matrices.read(spark, f"file://{tmp_path}").count()


@pytest.fixture
def canonical(spark, tmp_path):
    (tmp_path / "ingest.json").write_text(json.dumps({"samples": ["s1", "s2", "s3"], "images": {"s1": "one.tif"}, "native": 4}, indent=1))
    for s in ("s1", "s2"):
        spark.createDataFrame([(f"{s}u{i}", float(i), 0.0, "x") for i in range(3)], "spot_id string, x double, y double, kind string").write.parquet(f"{tmp_path}/{s}_spots.parquet")
    spark.createDataFrame([("s1u0", "g", 2)], "spot_id string, gene string, count int").write.parquet(f"{tmp_path}/s1_counts.parquet")
    return str(tmp_path)


def test_canonical_cohort(spark, canonical):
    import pandas as pd

    for s in ("s1", "s2"):  # a part is a file, as the ingest writes it
        folder = pathlib.Path(canonical) / f"{s}_spots.parquet"
        frame = pd.read_parquet(folder)
        folder.rename(folder.with_suffix(".old"))
        frame.to_parquet(folder)
    counts = pathlib.Path(canonical) / "s1_counts.parquet"
    frame = pd.read_parquet(counts)
    counts.rename(counts.with_suffix(".old"))
    frame.to_parquet(counts)
    got = {r["sample_id"]: r for r in cohort.samples(spark, canonical).collect()}
    assert set(got) == {"s1", "s2", "s3"} and got["s1"]["image"] == "one.tif" and got["s2"]["image"] is None
    assert got["s1"]["counts"] and got["s2"]["spots"] and not got["s2"]["counts"] and not got["s3"]["spots"]
    rows = cohort.spots(spark, canonical, ["s1", "s2"], ["kind"]).collect()
    assert len(rows) == 6 and {r["sample_id"] for r in rows} == {"s1", "s2"} and rows[0]["kind"] == "x"
    assert [tuple(r) for r in cohort.counts(spark, canonical, ["s1"]).select("sample_id", "spot_id", "gene", "count").collect()] == [("s1", "s1u0", "g", 2)]
    with pytest.raises(FileNotFoundError, match="no spots of s3"):
        cohort.spots(spark, canonical)
    with pytest.raises(FileNotFoundError, match="s2"):
        cohort.counts(spark, canonical, ["s1", "s2"])
    with pytest.raises(ValueError, match="absent"):
        cohort.spots(spark, canonical, ["s1"], ["absent"])


def test_cohort_without_a_record_is_refused(spark, tmp_path):
    (tmp_path / "x_spots.parquet").write_text("")
    with pytest.raises(FileNotFoundError, match="no ingest record"):
        cohort.samples(spark, str(tmp_path))


NICHE = "unit_id int, s string, p int, he array<double>, tok array<double>, mc array<double>, a array<double>, b array<double>"
ROLES = {"niche": "he", "tokens": "tok", "supervision": "mc", "subject": "p", "sample": "s", "width": 2, "members": 2}


def test_joined_niches_by_declared_roles(spark):
    nan = float("nan")
    rows = [
        (1, "x", 1, [1.0, 2.0], [1.0, 2.0, 3.0, 4.0], [nan, 1.0], [5.0], [6.0]), (2, "x", 1, [1.0, nan], [1.0, 2.0, 3.0, 4.0], [0.5, 0.5], [5.0], [6.0]), (3, "x", 1, [1.0, 2.0], [1.0, 2.0, None, 4.0], [0.5, 0.5], [5.0], [6.0]),
        (4, "y", 2, [1.0, 2.0], [1.0, 2.0, 3.0, 4.0], [0.1, 0.9], [5.0], None),
    ]
    units, dropped = cohort.loaded(spark.createDataFrame(rows, NICHE), cohort.Contract.declared(ROLES), ["a", "b"])
    got = units.collect()
    assert [r["unit"] for r in got] == [1] and got[0]["tokens"] == [[1.0, 2.0], [3.0, 4.0]] and got[0]["features"] == [5.0, 6.0] and got[0]["supervision"] == [0.5, 0.5]
    assert {r["sample"]: (r["n"], r["dropped"]) for r in dropped.collect()} == {"x": (3, 2), "y": (1, 1)}
    with pytest.raises(ValueError, match="tok: widths 4 to 4, declared 6"):
        cohort.loaded(spark.createDataFrame(rows, NICHE), cohort.Contract.declared(ROLES | {"members": 3}), ["a"])
    with pytest.raises(ValueError, match="missing columns: zz"):
        cohort.loaded(spark.createDataFrame(rows, NICHE), cohort.Contract.declared(ROLES), ["zz"])
    with pytest.raises(ValueError, match="not declared: niche, width"):
        cohort.Contract.declared({k: v for k, v in ROLES.items() if k not in ("niche", "width")})


def test_views_must_have_the_same_units(spark):
    a = spark.createDataFrame([("s", 1, [1.0]), ("s", 2, [2.0])], "sample_id string, unit_id int, vec array<double>")
    assert cohort.matrices({"x": a, "y": a}, ["sample_id", "unit_id"]).count() == 2
    with pytest.raises(ValueError, match="y lacks 1 units"):
        cohort.matrices({"x": a, "y": a.where("unit_id = 1")}, ["sample_id", "unit_id"])


def test_declared_tables_and_files_per_sample(spark, tmp_path):
    for s in ("a", "b"):
        spark.createDataFrame([(f"{s}1", 2.0)], "unit string, v double").coalesce(1).write.parquet(f"{tmp_path}/per/x_{s}.parquet")
    per = readers.load(spark, "parquet_per_sample", pattern=f"{tmp_path}/per/x_{{sample}}.parquet/*.parquet", columns=["unit"])
    assert per.count() == 2
    (tmp_path / "t.tsv").write_text("key\tv\nP1_C1\t3\nP2_C2\t4\n")
    t = readers.load(spark, "table_one_file", path=f"{tmp_path}/t.tsv", schema="key string, v int", key="key", strip_before="_")
    assert sorted(tuple(r) for r in t.collect()) == [("C1", 3), ("C2", 4)]
    readers.write_manifest(t, f"{tmp_path}/out")
    m = spark.read.json(f"{tmp_path}/out.manifest").first()
    assert m["rows"] == 2 and m["schema"] == "struct<key:string,v:int>"
