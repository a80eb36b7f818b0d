"""Routing questions to task families by TF-IDF cosine; below the threshold a question has no task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def terms(text: Column) -> Column:
    """Words of two or more letters or digits, lower-cased, and pairs of neighbours."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


def _weights(texts: DataFrame, key: str, idf: DataFrame) -> DataFrame:
    tf = texts.select(key, F.explode(terms(F.col("text"))).alias("term")).groupBy(key, "term").agg((1 + F.log(F.count(F.lit(1)))).alias("tf"))
    w = tf.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))


def route(questions: DataFrame, tasks: DataFrame, threshold: float = 0.15) -> DataFrame:
    """(question_id, task_id, score): sublinear tf, smooth idf over the tasks, ties to the smaller task_id."""
    n = tasks.count()
    df = tasks.select("task_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.select("term", (F.log((1 + F.lit(float(n))) / (1 + F.col("df"))) + 1).alias("idf"))
    scored = _weights(questions, "question_id", idf).join(_weights(tasks, "task_id", idf).withColumnRenamed("w", "v"), "term").groupBy("question_id", "task_id").agg(F.sum(F.col("w") * F.col("v")).alias("score"))
    best = scored.withColumn("i", F.row_number().over(Window.partitionBy("question_id").orderBy(F.round("score", 9).desc(), "task_id"))).where("i = 1").drop("i")
    out = questions.select("question_id").join(best, "question_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return out.select("question_id", F.when(F.col("score") >= threshold, F.col("task_id")).alias("task_id"), "score")
