"""Queries of grouped folds, contrastive losses and shard status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import contrastive, folds
from tessera.operators.tables import fresh_path
from tessera.plans.tables import table, units, views, with_
from tessera.streaming import events, shards

ATTEMPTS, SILENT, LATE = 2, 3 * 86_400_000, "10 minutes"


def grouped_folds(spark: SparkSession, d: str) -> DataFrame:
    return folds.grouped_folds(units(spark, d), "label", 3, 5)


def fold_probe(spark: SparkSession, d: str) -> DataFrame:
    scores = ["accuracy", "chance", "macro_f1", "weighted_f1"]
    return folds.fold_probe(units(spark, d), "label", 3, 5).withColumns({c: F.round(c, 6) for c in scores})


def _soft(spark: SparkSession, d: str) -> DataFrame:
    return views(spark, d).withColumn("soft", F.slice("v", 1, 4))


def contrastive_losses(spark: SparkSession, d: str) -> DataFrame:
    """The three losses without parameters, of both halves of every sample's vectors in batches of 32."""
    batched = contrastive.batches(_soft(spark, d), "unit_id", "sample_id", "left", "right", 32, 2, "soft")
    found = contrastive.losses(batched, tuple(contrastive.Loss(k) for k in ("infonce", "supcon", "barlow")))
    return found.select(F.col("sample").alias("sample_id"), "batch", "kind", "n", F.round("loss", 6).alias("loss"))


def contrastive_towers(spark: SparkSession, d: str) -> DataFrame:
    """Cosines of held-out subjects' units under towers fitted on the others."""
    v = views(spark, d)
    train, held = (contrastive.batches(v.where(c), "unit_id", "sample_id", "left", "right", 256, 2) for c in ("subject_id > 3", "subject_id <= 3"))
    towers = contrastive.fit(train, held, contrastive.Loss("infonce"), 8, 2, epochs=20, patience=5)
    z = contrastive.embedded(v.where("subject_id <= 3").select("unit_id", "left", "right"), towers, "left", "right")
    return z.select("unit_id", F.round(F.aggregate(F.zip_with("z_left", "z_right", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x), 6).alias("cosine"))


def _status(spark: SparkSession, d: str) -> DataFrame:
    """A user's day as a shard, purchases as its ends and errors as failures."""
    e = events.source(spark, d)
    kind = F.when(F.col("event_type") == "purchase", shards.DONE).when(F.col("event_type") == "error", shards.FAILED).otherwise("seen")
    records = e.select(F.concat_ws("/", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("shard"), F.col("event_id").alias("id"), "ts", kind.alias("kind"))
    place = fresh_path(spark, "shards")
    return shards.run(shards.statuses(records, ATTEMPTS, SILENT, LATE), f"{place}/out", f"{place}/state")


def shard_status(spark: SparkSession, d: str) -> DataFrame:
    return _status(spark, d)


def shard_report(spark: SparkSession, d: str) -> DataFrame:
    """Shards of each user, with what is to be done about failures above a twentieth."""
    got = shards.report(_status(spark, d).withColumn("user_id", F.split("shard", "/")[0].cast("long")), 0.05, ["user_id"])
    return got.withColumn("failure_share", F.round("failure_share", 6))


QUERIES = [grouped_folds, fold_probe, contrastive_losses, contrastive_towers, shard_status, shard_report]

_SHARDS = f"""WITH r AS (SELECT user_id, user_id || '/' || strftime(ts, '%Y-%m-%d') AS shard, epoch_us(ts) // 1000 AS ms, event_id, event_type AS k FROM events WHERE ts IS NOT NULL),
s AS (SELECT user_id, shard, bool_or(k = 'purchase') AS done, count(*) FILTER (k = 'error')::INT AS failures, max(ms) AS last_ms, arg_max(k, (ms, event_id)) AS last FROM r GROUP BY 1, 2), w AS (SELECT max(ms) - 600000 AS w FROM r),
st AS (SELECT user_id, shard, CASE WHEN done THEN 'done' WHEN failures >= {ATTEMPTS} THEN 'failed' WHEN last_ms + {SILENT} <= w THEN 'stalled' WHEN last = 'error' THEN 'retry' ELSE 'running' END AS status, failures, last_ms FROM s, w)"""
_LOSSES = with_("units") + """, q AS (SELECT unit_id, sample_id, v[1:4] AS w, v[1:32] AS a, v[33:64] AS b, row_number() OVER (PARTITION BY sample_id ORDER BY md5('2:' || unit_id), unit_id) - 1 AS place, count(*) OVER (PARTITION BY sample_id) AS m FROM units),
u AS (SELECT sample_id, (place % ceil(m / 32))::BIGINT AS batch, unit_id, list_transform(a, lambda x: x / sqrt(list_dot_product(a, a))) AS a, list_transform(b, lambda x: x / sqrt(list_dot_product(b, b))) AS b, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS w FROM q WHERE m > 1),
p AS (SELECT sample_id, batch, x.unit_id AS i, y.unit_id AS j, list_dot_product(x.a, y.b) / 0.07::DOUBLE AS l, list_dot_product(x.w, y.w) / 0.1::DOUBLE AS t FROM u x JOIN u y USING (sample_id, batch)),
e AS (SELECT *, ln(sum(exp(l)) OVER (PARTITION BY sample_id, batch, i)) AS row, ln(sum(exp(l)) OVER (PARTITION BY sample_id, batch, j)) AS col, exp(t) / sum(exp(t)) OVER (PARTITION BY sample_id, batch, i) AS want, count(*) OVER (PARTITION BY sample_id, batch, i) AS n FROM p),
c AS (SELECT sample_id, batch, any_value(n) AS n, -(sum(2 * l - row - col) FILTER (i = j)) / (2 * any_value(n)) AS infonce, -(sum(want * (l - row)) + sum(want * (r.l2 - r.row2))) / (2 * any_value(n)) AS supcon FROM e JOIN (SELECT sample_id, batch, j AS i, i AS j, l AS l2, col AS row2 FROM e) r USING (sample_id, batch, i, j) GROUP BY 1, 2),
d AS (SELECT sample_id, batch, unit_id, s, a[s] AS x, b[s] AS y FROM u CROSS JOIN range(1, 33) g(s)), z AS (SELECT sample_id, batch, unit_id, s, (x - avg(x) OVER h) / (stddev_samp(x) OVER h + 1e-8) AS x, (y - avg(y) OVER h) / (stddev_samp(y) OVER h + 1e-8) AS y FROM d WINDOW h AS (PARTITION BY sample_id, batch, s)),
k AS (SELECT sample_id, batch, o.s AS s, r.s AS t, avg(o.x * r.y) AS c FROM z o JOIN z r USING (sample_id, batch, unit_id) GROUP BY 1, 2, 3, 4), b AS (SELECT sample_id, batch, sum(CASE WHEN s = t THEN (c - 1) * (c - 1) ELSE 5e-3::DOUBLE * c * c END) AS barlow FROM k GROUP BY 1, 2)"""

ORACLE = {
    "grouped_folds": with_("units") + """, p AS (SELECT subject_id, label, count(*) AS m FROM units WHERE label IS NOT NULL AND subject_id IS NOT NULL GROUP BY 1, 2), s AS (SELECT subject_id, arg_min(label, (-m, label)) AS stratum, sum(m)::BIGINT AS n FROM p GROUP BY 1),
        o AS (SELECT *, row_number() OVER (ORDER BY stratum, n DESC, md5('5:' || subject_id), subject_id) - 1 AS i FROM s) SELECT subject_id, stratum, n, (CASE WHEN i // 3 % 2 = 0 THEN i % 3 ELSE 2 - i % 3 END)::INT AS fold FROM o""",
    "contrastive_losses": _LOSSES + """ SELECT sample_id, batch, kind, n::INT AS n, round(CASE kind WHEN 'infonce' THEN infonce WHEN 'supcon' THEN supcon ELSE barlow END, 6) AS loss FROM c JOIN b USING (sample_id, batch) CROSS JOIN (VALUES ('infonce'), ('supcon'), ('barlow')) x(kind)""",
    "shard_status": _SHARDS + " SELECT shard, status, failures, last_ms FROM st",
    "shard_report": _SHARDS + """, a AS (SELECT user_id, count(*) AS n, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'stalled') AS stalled, count(*) FILTER (status IN ('running', 'retry')) AS open FROM st GROUP BY 1)
        SELECT *, round(failed / n, 6) AS failure_share, CASE WHEN failed > 0 AND done = 0 THEN 'refuse' WHEN failed > 0.05::DOUBLE * n THEN 'ask' ELSE 'go_on' END AS verdict FROM a""",
}
