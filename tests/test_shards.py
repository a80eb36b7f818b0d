"""Shard status as a stream: attempts, stalls, late batches and restarts."""

import datetime as dt

import pandas as pd

from tessera.streaming import shards

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "shard string, id long, ts timestamp, kind string, status string"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


FIRST = [
    ("a", 1, at(0), "started", "clash"), ("a", 2, at(1), "failed", ""), ("a", 3, at(2), "done", ""), ("b", 4, at(0), "failed", ""), ("b", 5, at(1), "failed", ""), ("c", 6, at(2), "started", ""),
    ("d", 7, at(3), "failed", ""), ("e", 8, at(3), None, ""), (None, 9, at(3), "done", ""), ("g", None, None, "done", ""), ("h", None, at(5), "failed", ""), ("h", 1, at(5), "started", ""),
]
SECOND = [("b", 10, at(70), "failed", ""), ("d", 11, at(71), "started", ""), ("a", 12, at(72), "failed", ""), ("f", 13, at(100), "started", "")]


def write(folder, name, rows):
    pd.DataFrame(rows, columns=["shard", "id", "ts", "kind", "status"]).astype({"id": "Int64", "ts": "datetime64[us]"}).to_parquet(f"{folder}/{name}.parquet")


def stream(spark, folder):
    return shards.statuses(spark.readStream.schema(SCHEMA).parquet(str(folder)), attempts=3, silent=50 * 60_000)


def states(df):
    return {r["shard"]: (r["status"], r["failures"]) for r in df.collect()}


def test_status_over_a_restart(spark, tmp_path):
    seen = tmp_path / "in"
    seen.mkdir()
    write(seen, "one", FIRST)
    got = states(shards.run(stream(spark, seen), f"{tmp_path}/out", f"{tmp_path}/state"))
    assert got == {"a": ("done", 1), "b": ("retry", 2), "c": ("running", 0), "d": ("retry", 1), "e": ("running", 0), "h": ("running", 1)}
    write(seen, "two", SECOND)
    again = shards.run(stream(spark, seen), f"{tmp_path}/out", f"{tmp_path}/state")
    want = {"a": ("done", 2), "b": ("failed", 3), "c": ("stalled", 0), "d": ("running", 1), "e": ("stalled", 0), "h": ("stalled", 1), "f": ("running", 0)}
    assert states(again) == want
    assert states(shards.run(stream(spark, seen), f"{tmp_path}/out", f"{tmp_path}/state")) == want  # nothing new
    r = shards.report(again, 0.1).first()
    assert (r["n"], r["done"], r["failed"], r["stalled"], r["open"], r["verdict"]) == (7, 1, 1, 3, 2, "ask")


def test_late_records_count(spark, tmp_path):
    seen = tmp_path / "in"
    seen.mkdir()
    write(seen, "one", [("a", 1, at(300), "started", ""), ("b", 2, at(280), "started", "")])
    assert states(shards.run(stream(spark, seen), f"{tmp_path}/out", f"{tmp_path}/state")) == {"a": ("running", 0), "b": ("running", 0)}
    write(seen, "two", [("a", 3, at(2), "failed", ""), ("c", 4, at(1), "failed", ""), ("d", 5, at(1), "done", "")])
    got = states(shards.run(stream(spark, seen), f"{tmp_path}/out", f"{tmp_path}/state"))
    assert got == {"a": ("running", 1), "b": ("running", 0), "c": ("stalled", 1), "d": ("done", 0)}


def test_state_is_kept_without_python(spark, tmp_path):
    plan = stream(spark, tmp_path)._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "InPySpark" not in plan and "TransformWithState" not in plan


def test_report_of_total_failure_and_of_nothing(spark):
    df = spark.createDataFrame([("x", "failed"), ("y", "running")], "shard string, status string")
    assert shards.report(df, 0.9).first()["verdict"] == "refuse"
    r = shards.report(df.limit(0), 0.1).first()
    assert r["n"] == 0 and r["failure_share"] is None and r["verdict"] == "go_on"
