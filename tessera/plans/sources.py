"""Queries over files that are written from the driver's tables and read back through the library's sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators.tables import fresh_path
from tessera.plans.tables import views, with_
from tessera.sources import cohort
from tessera.sources import matrices as npy


def stacked_matrices(spark: SparkSession, d: str) -> DataFrame:
    """Both views of all samples but one as .npy files, read with their indexes and laid side by side."""
    v = views(spark, d)
    read = {}
    for name in ("left", "right"):
        place = fresh_path(spark, f"matrices-{name}")
        index = npy.write(v.select("sample_id", "unit_id", F.col(name).alias("vec")), place, "sample_id", "unit_id", rows_in_file=100)
        wanted = [s for s in npy.samples(place) if s != "3"]
        read[name] = npy.with_index(spark, place, index.where("sample_id <> '3'"), wanted)
    both = cohort.matrices(read, ["sample_id", "unit_id"])
    g = both.select("sample_id", V.norm(F.col("left")).alias("a"), V.norm(F.col("right")).alias("b"), V.dot(F.col("left"), F.col("right")).alias("c"))
    return g.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.sum(x), 4).alias(y) for x, y in (("a", "left"), ("b", "right"), ("c", "dot"))])


def joined_niches(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as joined niches under declared roles: tokens of two members, features side by side, missing elements."""
    e = views(spark, d)
    hole = F.when(F.col("label") == 4, F.array(F.lit(float("nan")))).otherwise(F.slice("v", 4, 1))
    made = e.select("unit_id", "sample_id", "subject_id", "label", F.slice("v", 1, 8).alias("he"), F.slice("v", 1, 16).alias("tok"), F.concat(F.slice("v", 1, 3), hole).alias("st_a"), F.slice("v", 33, 4).alias("st_b"), F.when(F.col("label") == 2, F.array(F.lit(None).cast("double"), F.lit(1.0))).otherwise(F.array(F.lit(0.25), F.lit(0.75))).alias("mc"))
    contract = cohort.Contract.declared({"niche": "he", "tokens": "tok", "supervision": "mc", "subject": "subject_id", "sample": "sample_id", "width": 8, "members": 2, "labels": ("label",)})
    units, dropped = cohort.loaded(made, contract, ["st_a", "st_b"])
    g = units.groupBy(F.col("sample").alias("sample_id")).agg(F.count(F.lit(1)).alias("kept"), F.round(F.sum(V.norm(F.col("features"))), 4).alias("features"), F.round(F.sum(V.norm(F.col("tokens")[1])), 4).alias("second"), F.sum(F.col("supervision")[0]).alias("weight"))
    return g.join(dropped.select(F.col("sample").alias("sample_id"), "n", "dropped"), "sample_id")


QUERIES = [stacked_matrices, joined_niches]

ORACLE = {
    "stacked_matrices": with_("units") + """SELECT sample_id::VARCHAR AS sample_id, count(*) AS n, round(sum(sqrt(list_dot_product(v[1:32], v[1:32]))), 4) AS left, round(sum(sqrt(list_dot_product(v[33:64], v[33:64]))), 4) AS right, round(sum(list_dot_product(v[1:32], v[33:64])), 4) AS dot
        FROM units WHERE sample_id <> 3 GROUP BY 1""",
    "joined_niches": with_("units") + """, u AS (SELECT *, coalesce(label <> 4, true) AS whole FROM units)
        SELECT sample_id, count(*) FILTER (whole) AS kept, round(sum(sqrt(list_dot_product(list_concat(v[1:4], v[33:36]), list_concat(v[1:4], v[33:36])))) FILTER (whole), 4) AS features, round(sum(sqrt(list_dot_product(v[9:16], v[9:16]))) FILTER (whole), 4) AS second,
        sum(CASE WHEN label = 2 THEN 0.5 ELSE 0.25 END::DOUBLE) FILTER (whole) AS weight, count(*) AS n, count(*) FILTER (NOT whole) AS dropped FROM u GROUP BY 1""",
}
