"""Files that results rest on: their content against declared pins, and what of a declared scope they can fill."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def addressed(spark: SparkSession, place: str, pattern: str = "*") -> DataFrame:
    """(path below place, bytes, sha256) of the files in a folder and its folders; a task reads a file at a time."""
    root = place.split(":", 1)[-1].strip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(place)
    return files.select(F.substring_index("path", root, -1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def pins(declared: DataFrame, found: DataFrame) -> DataFrame:
    """(path, status) of declared pins (path, sha256; null pins the file's presence only) and files (path, sha256): pinned,
    changed, missing, unpinned (declared without content) or undeclared."""
    both = declared.select("path", F.col("sha256").alias("want"), F.lit(True).alias("d")).join(found.select("path", F.col("sha256").alias("have"), F.lit(True).alias("f")), "path", "full_outer")
    status = F.when(F.col("d").isNull(), "undeclared").when(F.col("f").isNull(), "missing").when(F.col("want").isNull(), "unpinned").when(F.col("want") == F.col("have"), "pinned").otherwise("changed")
    return both.select("path", status.alias("status"))


def scope(cells: DataFrame, templates: DataFrame, unavailable: DataFrame, found: DataFrame) -> DataFrame:
    """(run, metric, status, lacking) of a grid's cells (run, metric): fillable if every artifact of the metric (templates:
    metric, template with `{run}`) is there; not_available if the metric is declared so (unavailable: metric, reason), which
    wins; undeclared if no artifact is named for it; else missing, with the paths it lacks."""
    need = cells.select("run", "metric").distinct().join(templates, "metric", "left").withColumn("path", F.replace(F.col("template"), F.lit("{run}"), F.col("run").cast("string")))
    held = need.join(found.select("path", F.lit(True).alias("there")).distinct(), "path", "left")
    g = held.groupBy("run", "metric").agg(F.count("template").alias("named"), F.array_sort(F.collect_set(F.when(F.col("template").isNotNull() & F.col("there").isNull(), F.col("path")))).alias("lacking"))
    off = unavailable.select("metric", "reason").dropDuplicates(["metric"])
    status = F.when(F.col("reason").isNotNull(), "not_available").when(F.col("named") == 0, "undeclared").when(F.size("lacking") == 0, "fillable").otherwise("missing")
    return g.join(off, "metric", "left").select("run", "metric", status.alias("status"), "lacking")


def verdicts(guards: DataFrame, pinned: DataFrame, uses: DataFrame) -> DataFrame:
    """(method_id, status) of guard verdicts (method_id, verdict) on the files they used (uses: method_id, path): one that
    rests on a file that changed, is missing or isn't declared stands on nothing."""
    bad = uses.join(pinned, "path", "left").groupBy("method_id").agg(F.count_if(~F.coalesce(F.col("status").isin("pinned", "unpinned"), F.lit(False))).alias("bad"))
    return guards.join(bad, "method_id", "left").select("method_id", F.when(F.coalesce("bad", F.lit(0)) > 0, "unpinned_evidence").otherwise(F.col("verdict")).alias("status"))
