"""The roles of the operators' inputs, taken from the star-schema tables; SQL holds the same definitions for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.tables import dealt, large, materialise

SQL = {
    "spots": "spots AS (SELECT c_nationkey AS sample_id, c_custkey AS unit_id, (c_custkey * 7919 % 1000)::DOUBLE / 10 AS x, (c_custkey * 104729 % 997)::DOUBLE / 10 AS y, c_acctbal AS value, c_mktsegment AS label FROM customer)",
    "knn": """knn AS (SELECT sample_id, unit_id, neighbour, pos FROM (SELECT a.sample_id, a.unit_id, b.unit_id AS neighbour, row_number() OVER (PARTITION BY a.sample_id, a.unit_id
        ORDER BY CASE WHEN a.unit_id = b.unit_id THEN 0 ELSE 1 END, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.unit_id) - 1 AS pos FROM spots a JOIN spots b USING (sample_id)) WHERE pos <= 6)""",
    "units": "units AS (SELECT vec_id AS unit_id, vec_id % 8 AS sample_id, vec_id % 14 AS subject_id, label, embedding::DOUBLE[] AS v FROM embeddings)",
    "counts": "counts AS (SELECT c_nationkey AS sample_id, l_orderkey AS unit_id, 'G' || l_partkey AS gene, sum(l_quantity) AS count FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3)",
    "members": """members AS (SELECT u.sample_id, u.unit_id, p.pos, coalesce(n.neighbour, u.unit_id) AS member FROM (SELECT * FROM spots WHERE value >= 0) u CROSS JOIN range(0, 7) p(pos)
        LEFT JOIN (SELECT sample_id, unit_id, neighbour, row_number() OVER (PARTITION BY sample_id, unit_id ORDER BY pos) AS pos FROM knn WHERE pos > 0 AND neighbour IN (SELECT unit_id FROM spots WHERE value >= 0)) n ON n.sample_id = u.sample_id AND n.unit_id = u.unit_id AND n.pos = p.pos)""",
}


def with_(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_nationkey").alias("sample_id"), F.col("c_custkey").alias("unit_id"), ((F.col("c_custkey") * 7919 % 1000).cast("double") / 10).alias("x"), ((F.col("c_custkey") * 104729 % 997).cast("double") / 10).alias("y"), F.col("c_acctbal").alias("value"), F.col("c_mktsegment").alias("label"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("unit_id"), (F.col("vec_id") % 8).alias("sample_id"), (F.col("vec_id") % 14).alias("subject_id"), "label", F.col("embedding").cast("array<double>").alias("v"))


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with their vector's two halves as two views of them."""
    return units(spark, sf_dir).withColumns({"left": F.slice("v", 1, 32), "right": F.slice("v", 33, 32)})


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as units of their customer's nation, parts as genes: written, as most queries use them several times, by tasks
    of about as many lines each."""
    lines = table(spark, sf_dir, "lineitem")
    n = lines.count()
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit_id"), F.col("o_custkey").alias("c_custkey"))
    units = orders.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("sample_id")), "c_custkey").drop("c_custkey")
    rows = lines.select(F.col("l_orderkey").alias("unit_id"), F.concat(F.lit("G"), "l_partkey").alias("gene"), "l_quantity")
    both = dealt(rows, n, "unit_id").join(dealt(large(units), n, "unit_id"), "unit_id")
    return materialise(both.groupBy("sample_id", "unit_id", "gene").agg(F.sum("l_quantity").alias("count")), "counts")
