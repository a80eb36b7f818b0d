"""Queries of the niche join, neighbours and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import gram, nichejoin, similarity, statistics
from tessera.operators.tables import large
from tessera.plans.tables import spots, table, units, views, with_

K = 6


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return similarity.spatial_neighbours(spots(spark, d), K)


def _members(spark: SparkSession, d: str) -> DataFrame:
    return nichejoin.neighbourhood(_edges(spark, d), spots(spark, d).where("value >= 0"), K)


def spatial_knn(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select("sample_id", "unit_id", "neighbour", F.col("pos").cast("long").alias("pos"))


def niche_members(spark: SparkSession, d: str) -> DataFrame:
    return _members(spark, d).select("sample_id", "unit_id", F.col("pos").cast("long").alias("pos"), "member")


def _assay(spark: SparkSession, d: str) -> DataFrame:
    """An assay that lacks a market segment's customers, with values of which some are not a number."""
    return spots(spark, d).where("label <> 'MACHINERY'").select("sample_id", "unit_id", F.col("value").alias("a"), F.when(F.col("value") > 9000, F.lit(float("nan"))).otherwise((F.col("unit_id") % 100).cast("double")).alias("b"))


def niche_pool(spark: SparkSession, d: str) -> DataFrame:
    p = nichejoin.pooled(_members(spark, d), _assay(spark, d), ["a", "b"])
    return p.select("sample_id", "unit_id", "support", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


def niche_tokens(spark: SparkSession, d: str) -> DataFrame:
    assay = spots(spark, d).where("label <> 'MACHINERY'").select("sample_id", "unit_id", F.array("value", (F.col("unit_id") % 5).cast("double")).alias("vec"))
    t = nichejoin.tokens(_members(spark, d), assay, "vec")
    return t.select("sample_id", "unit_id", F.posexplode("tokens").alias("pos", "t")).select("sample_id", "unit_id", F.col("pos").cast("long").alias("pos"), F.col("t")[0].alias("t0"), F.col("t")[1].alias("t1"))


def unit_inventory(spark: SparkSession, d: str) -> DataFrame:
    s = spots(spark, d)
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("unit_id")).distinct()
    return nichejoin.unit_inventory([s, s.join(orders, "unit_id", "left_semi"), s.where("value > 0")])[1]


def anchor_drop(spark: SparkSession, d: str) -> DataFrame:
    s = spots(spark, d)
    return nichejoin.anchor_coverage(s, s.where("value > 1000"), "drop").groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def anchor_dropped(spark: SparkSession, d: str) -> DataFrame:
    s = spots(spark, d)
    return nichejoin.anchor_coverage(s, s.where("value > 1000"), "dropped").select("sample_id", "unit_id")


def anchor_mark(spark: SparkSession, d: str) -> DataFrame:
    s = spots(spark, d)
    return nichejoin.anchor_coverage(s, s.where("value > 1000"), "mark").select("sample_id", "unit_id", "covered")


def centre_labels(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.lit(0).alias("sample_id"), F.col("doc_id").alias("unit_id"), "lang")
    labels = table(spark, d, "labels").select(F.lit(0).alias("sample_id"), F.col("doc_id").alias("unit_id"), "quality")
    return nichejoin.centre_labels(docs, labels, "quality").select("unit_id", "lang", "quality", "quality__present")


def subject_resolution(spark: SparkSession, d: str) -> DataFrame:
    rich = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    subjects = table(spark, d, "nation").join(rich, "n_nationkey", "left_semi").select(F.col("n_nationkey").alias("sample_id"), F.col("n_regionkey").alias("subject_id"))
    return nichejoin.subject_resolution(spots(spark, d), subjects, "mark").groupBy("subject_id", "subject__present").agg(F.count(F.lit(1)).alias("n"))


def zscore_group_pop(spark: SparkSession, d: str) -> DataFrame:
    return nichejoin.standardise(spots(spark, d), ["sample_id"], ["value"], 0, 1e-8, "floor").select("unit_id", F.round("value_z", 6).alias("z"))


def zscore_group_samp(spark: SparkSession, d: str) -> DataFrame:
    return nichejoin.standardise(spots(spark, d), ["sample_id"], ["value"], 1, 1e-9, "add").select("unit_id", F.round("value_z", 6).alias("z"))


def join_funnel(spark: SparkSession, d: str) -> DataFrame:
    stages = [("positive", "value > 0"), ("segment", "label <> 'BUILDING'"), ("covered", "value < 9000")]
    return nichejoin.funnel(spots(spark, d), stages)


def drop_distribution(spark: SparkSession, d: str) -> DataFrame:
    r = nichejoin.drop_distribution(spots(spark, d).withColumn("dropped", F.col("value") < 0), "sample_id", "dropped")
    return r.select("groups", "units", *[F.round(c, 6).alias(c) for c in ("rate", "min_rate", "max_rate", "sd_rate", "overdispersion")], "eliminated")


def knn_top6(spark: SparkSession, d: str) -> DataFrame:
    return similarity.nearest_vectors(units(spark, d), 6).select("unit_id", F.col("pos").cast("long").alias("pos"), "neighbour", F.round("similarity", 6).alias("similarity"))


def knn_purity(spark: SparkSession, d: str) -> DataFrame:
    u = units(spark, d)
    return similarity.purity(similarity.nearest_vectors(u, 6), u).groupBy("label").agg(F.round(F.avg("purity"), 6).alias("purity"), F.count(F.lit(1)).alias("n"))


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    r = similarity.retrieval_metrics(similarity.retrieval(views(spark, d), "left", "right"))
    return r.select("n", *[F.round(c, 6).alias(c) for c in ("mrr", "r1", "r5", "r10", "median_rank", "gap")])


def retrieval_auc(spark: SparkSession, d: str) -> DataFrame:
    v = views(spark, d)
    n = v.count()
    ids = v.select("unit_id", "left").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(10))))
    other = F.when(F.col("j") == 0, F.col("unit_id")).otherwise(statistics.draw(F.lit(0), "unit_id", "j") % n)
    pairs = ids.withColumn("o", other).where((F.col("j") == 0) | (F.col("o") != F.col("unit_id")))
    scored = pairs.join(v.select(F.col("unit_id").alias("o"), "right"), "o").select((F.col("j") == 0).alias("positive"), F.round(V.cosine(F.col("left"), F.col("right")), 12).alias("score"))
    return statistics.auc(scored).select("n_pos", "n_neg", F.round("auc", 6).alias("auc"))


def biology_delta(spark: SparkSession, d: str) -> DataFrame:
    r = similarity.label_delta(units(spark, d), "label", "subject_id")
    return r.select(*[F.round(c, 6).alias(c) for c in ("same", "different", "delta")])


def patient_delta(spark: SparkSession, d: str) -> DataFrame:
    r = similarity.subject_delta(units(spark, d), "subject_id")
    return r.select(*[F.round(c, 6).alias(c) for c in ("same", "different", "delta")])


def mean_pool_l2(spark: SparkSession, d: str) -> DataFrame:
    p = similarity.mean_pool_l2(units(spark, d), ["sample_id"])
    return p.select("sample_id", F.posexplode("v").alias("dim", "x")).select("sample_id", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


def sample_cosines(spark: SparkSession, d: str) -> DataFrame:
    """The triangle of cosines between pooled samples."""
    p = similarity.mean_pool_l2(units(spark, d), ["sample_id"])
    a, b = p.select(F.col("sample_id").alias("a"), F.col("v").alias("va")), p.select(F.col("sample_id").alias("b"), F.col("v").alias("vb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(V.cosine(F.col("va"), F.col("vb")), 6).alias("cosine"))


def linear_cka(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(round(gram.linear_cka(views(spark, d), "left", "right"), 6),)], "cka double")


def participation_ratio(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(round(gram.participation_ratio(units(spark, d), "v"), 4),)], "ratio double")


def canonical_correlations(spark: SparkSession, d: str) -> DataFrame:
    s, _, _ = gram.ridge_cca(views(spark, d), "left", "right", 10)
    return spark.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(s)], "pos long, correlation double")


def principal_components(spark: SparkSession, d: str) -> DataFrame:
    _, _, var = gram.pca(units(spark, d), "v", 10)
    return spark.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(var)], "pos long, variance double")


def joined_views(spark: SparkSession, d: str) -> DataFrame:
    """Feature concatenation, the view mean that is not normalised again, and weights whose missing rows become uniform."""
    v = views(spark, d)
    w = F.when(F.col("unit_id") % 11 == 0, F.array(F.lit(None).cast("double"), F.lit(1.0))).otherwise(F.array(F.lit(0.25), F.lit(0.75)))
    r = v.select("unit_id", V.midpoint(F.col("left"), F.col("right")).alias("m"), V.uniform_if_missing(w, 2).alias("w"), F.size(F.concat("left", "right")).cast("long").alias("width"))
    return r.select("unit_id", F.round(F.col("m")[0], 6).alias("m0"), F.round(V.norm(F.col("m")), 6).alias("norm"), F.col("w")[0].alias("w0"), "width")


def morans_i(spark: SparkSession, d: str) -> DataFrame:
    return statistics.morans_i(spots(spark, d), _edges(spark, d)).select("sample_id", "n", F.round("moran", 6).alias("moran"))


def lattice_spacing(spark: SparkSession, d: str) -> DataFrame:
    """Median nearest-neighbour distance of a sample, and its relative deviation from the declared pitch."""
    s = spots(spark, d)
    near = similarity.spatial_neighbours(s, 1).where("pos = 1")
    other = s.select("sample_id", F.col("unit_id").alias("neighbour"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    dist = near.join(large(s), ["sample_id", "unit_id"]).join(large(other), ["sample_id", "neighbour"]).select("sample_id", F.sqrt((F.col("x") - F.col("nx")) ** 2 + (F.col("y") - F.col("ny")) ** 2).alias("dist"))
    g = dist.groupBy("sample_id").agg(F.median("dist").alias("spacing"), F.min("dist").alias("least"), F.max("dist").alias("most"))
    return g.select("sample_id", *[F.round(c, 6).alias(c) for c in ("spacing", "least", "most")], (F.abs(F.col("spacing") - 2.0) / 2.0 > 0.02).alias("escalate"))


def tile_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Tile centres, rounded half to even, and boxes clamped to the image."""
    cx, cy = F.rint(F.col("x") * 2.5), F.rint(F.col("y") * 2.5)
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(248.0), c))
    return spots(spark, d).select("unit_id", cx.alias("cx"), cy.alias("cy"), clamp(cx - 8).alias("x0"), clamp(cy - 8).alias("y0"), clamp(cx + 8).alias("x1"), clamp(cy + 8).alias("y1"))


QUERIES = [
    spatial_knn, niche_members, niche_pool, niche_tokens, unit_inventory, anchor_drop, anchor_dropped, anchor_mark, centre_labels, subject_resolution, zscore_group_pop, zscore_group_samp, join_funnel,
    drop_distribution, knn_top6, knn_purity, retrieval_metrics, retrieval_auc, biology_delta, patient_delta, mean_pool_l2, sample_cosines, linear_cka, participation_ratio, canonical_correlations,
    principal_components, joined_views, morans_i, lattice_spacing, tile_boxes,
]

_NV = "nv AS (SELECT unit_id, sample_id, subject_id, label, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS u FROM units)"
_TOP = _NV + ",\ntop AS (SELECT * FROM (SELECT a.unit_id, a.label, b.unit_id AS neighbour, b.label AS other, list_dot_product(a.u, b.u) AS s, row_number() OVER (PARTITION BY a.unit_id ORDER BY round(list_dot_product(a.u, b.u), 12) DESC, b.unit_id) AS pos FROM nv a JOIN nv b ON a.unit_id <> b.unit_id) WHERE pos <= 6)"
_PAIRS = _NV + ",\np AS (SELECT a.label = b.label AS l, a.subject_id = b.subject_id AS s, list_dot_product(a.u, b.u) AS c FROM nv a JOIN nv b ON a.unit_id < b.unit_id)"
_LR = "lr AS (SELECT unit_id, v[1:32] AS a, v[33:64] AS b FROM units),\nn2 AS (SELECT unit_id, list_transform(a, lambda x: x / sqrt(list_dot_product(a, a))) AS a, list_transform(b, lambda x: x / sqrt(list_dot_product(b, b))) AS b FROM lr)"
_POOL = _NV + """,
pl AS (SELECT sample_id, i AS dim, avg(u[i]) AS m FROM nv CROSS JOIN range(1, 65) r(i) GROUP BY 1, 2),
pn AS (SELECT sample_id, list(m / n ORDER BY dim) AS q FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY sample_id)) AS n FROM pl) GROUP BY 1)"""
_MOMENTS = """x AS (SELECT unit_id, i, v[i] - avg(v[i]) OVER (PARTITION BY i) AS z FROM units CROSS JOIN range(1, 65) r(i)),
g AS (SELECT a.i, b.i AS j, sum(a.z * b.z) AS c FROM x a JOIN x b USING (unit_id) GROUP BY 1, 2)"""

ORACLE = {
    "spatial_knn": with_("spots", "knn") + "SELECT * FROM knn",
    "niche_members": with_("spots", "knn", "members") + "SELECT * FROM members",
    "niche_pool": with_("spots", "knn", "members") + """SELECT m.sample_id, m.unit_id, count(s.unit_id) AS support, round(avg(s.value), 6) AS a, round(avg(CASE WHEN s.value <= 9000 THEN (s.unit_id % 100)::DOUBLE END), 6) AS b
        FROM members m LEFT JOIN (SELECT * FROM spots WHERE label <> 'MACHINERY') s ON s.sample_id = m.sample_id AND s.unit_id = m.member GROUP BY 1, 2""",
    "niche_tokens": with_("spots", "knn", "members") + """SELECT m.sample_id, m.unit_id, m.pos, s.value AS t0, (s.unit_id % 5)::DOUBLE AS t1 FROM members m JOIN spots s ON s.sample_id = m.sample_id AND s.unit_id = m.member
        WHERE (m.sample_id, m.unit_id) NOT IN (SELECT (sample_id, unit_id) FROM members WHERE member IN (SELECT unit_id FROM spots WHERE label = 'MACHINERY'))""",
    "unit_inventory": with_("spots") + "SELECT n_in, n_out, n_in - n_out AS dropped, 'pass' AS status FROM (SELECT (SELECT count(*) FROM spots) AS n_in, (SELECT count(*) FROM spots WHERE value > 0 AND unit_id IN (SELECT o_custkey FROM orders)) AS n_out)",
    "anchor_drop": with_("spots") + "SELECT sample_id, count(*) AS n, round(sum(value), 4) AS total FROM spots WHERE value > 1000 GROUP BY 1",
    "anchor_dropped": with_("spots") + "SELECT sample_id, unit_id FROM spots WHERE NOT coalesce(value > 1000, false)",
    "anchor_mark": with_("spots") + "SELECT sample_id, unit_id, coalesce(value > 1000, false) AS covered FROM spots",
    "centre_labels": "SELECT d.doc_id AS unit_id, lang, quality, quality IS NOT NULL AS quality__present FROM documents d LEFT JOIN labels USING (doc_id)",
    "subject_resolution": "SELECT n_regionkey AS subject_id, n_regionkey IS NOT NULL AS subject__present, count(*) AS n FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)) ON n_nationkey = c_nationkey GROUP BY 1, 2",
    "zscore_group_pop": with_("spots") + "SELECT unit_id, round((value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w < 1e-8 THEN 1 ELSE stddev_pop(value) OVER w END, 6) AS z FROM spots WINDOW w AS (PARTITION BY sample_id)",
    "zscore_group_samp": with_("spots") + "SELECT unit_id, round((value - avg(value) OVER w) / (coalesce(stddev_samp(value) OVER w, 0) + 1e-9), 6) AS z FROM spots WINDOW w AS (PARTITION BY sample_id)",
    "join_funnel": with_("spots") + """, c AS (SELECT count(*) AS a, count(*) FILTER (value > 0) AS b, count(*) FILTER (value > 0 AND label <> 'BUILDING') AS c, count(*) FILTER (value > 0 AND label <> 'BUILDING' AND value < 9000) AS d FROM spots)
        SELECT *, n_in - n_out AS dropped FROM (SELECT 0 AS stage, 'positive' AS name, a AS n_in, b AS n_out FROM c UNION ALL SELECT 1, 'segment', b, c FROM c UNION ALL SELECT 2, 'covered', c, d FROM c)""",
    "drop_distribution": with_("spots") + """, g AS (SELECT sample_id, count(*) AS n, sum((value < 0)::INT)::DOUBLE AS d FROM spots GROUP BY 1), r AS (SELECT *, d / n AS r, sum(d) OVER () / sum(n) OVER () AS p FROM g)
        SELECT count(*) AS groups, sum(n)::BIGINT AS units, round(any_value(p), 6) AS rate, round(min(r), 6) AS min_rate, round(max(r), 6) AS max_rate, round(stddev_pop(r), 6) AS sd_rate,
        round(sum((d - n * p) * (d - n * p) / (n * p * (1 - p))) / (count(*) - 1), 6) AS overdispersion, count(*) FILTER (d = n) AS eliminated FROM r""",
    "knn_top6": with_("units") + "," + _TOP + " SELECT unit_id, pos, neighbour, round(s, 6) AS similarity FROM top",
    "knn_purity": with_("units") + "," + _TOP + " SELECT label, round(avg(p), 6) AS purity, count(*) AS n FROM (SELECT unit_id, label, avg((label = other)::INT) AS p FROM top GROUP BY 1, 2) GROUP BY 1",
    "retrieval_metrics": with_("units") + "," + _LR + """, s AS (SELECT q.unit_id AS q, c.unit_id AS c, list_dot_product(q.a, c.b) AS s FROM n2 q CROSS JOIN n2 c), m AS (SELECT q, s AS m FROM s WHERE q = c),
        r AS (SELECT q, any_value(m) AS m, 1 + count(*) FILTER (c <> q AND s > m + 1e-12) AS rank, avg(s) FILTER (c <> q) AS o FROM s JOIN m USING (q) GROUP BY 1)
        SELECT count(*) AS n, round(avg(1.0::DOUBLE / rank), 6) AS mrr, round(avg((rank <= 1)::INT), 6) AS r1, round(avg((rank <= 5)::INT), 6) AS r5, round(avg((rank <= 10)::INT), 6) AS r10, round(median(rank), 6) AS median_rank, round(avg(m) - avg(o), 6) AS gap FROM r""",
    "retrieval_auc": with_("units") + "," + _LR + """, n AS (SELECT count(*) AS n FROM units),
        d AS (SELECT unit_id, a, j, CASE WHEN j = 0 THEN unit_id ELSE ('0x' || substr(md5('0:' || unit_id || ':' || j), 1, 8))::BIGINT % n END AS o FROM n2 CROSS JOIN range(0, 11) r(j) CROSS JOIN n),
        s AS (SELECT d.j = 0 AS pos, round(greatest(-1, least(1, list_dot_product(d.a, c.b))), 12) AS s FROM d JOIN n2 c ON c.unit_id = d.o WHERE d.j = 0 OR d.o <> d.unit_id),
        b AS (SELECT s, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS q FROM s GROUP BY 1), w AS (SELECT *, coalesce(sum(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b)
        SELECT sum(p)::BIGINT AS n_pos, sum(q)::BIGINT AS n_neg, round((sum(p * (below + q / 2)) / (sum(p)::DOUBLE * sum(q)))::DOUBLE, 6) AS auc FROM w""",
    "biology_delta": with_("units") + "," + _PAIRS + " SELECT round(avg(c) FILTER (l AND NOT s), 6) AS same, round(avg(c) FILTER (NOT l AND NOT s), 6) AS different, round(avg(c) FILTER (l AND NOT s) - avg(c) FILTER (NOT l AND NOT s), 6) AS delta FROM p",
    "patient_delta": with_("units") + "," + _PAIRS + " SELECT round(avg(c) FILTER (s), 6) AS same, round(avg(c) FILTER (NOT s), 6) AS different, round(avg(c) FILTER (s) - avg(c) FILTER (NOT s), 6) AS delta FROM p",
    "mean_pool_l2": with_("units") + "," + _POOL + " SELECT sample_id, i - 1 AS dim, round(q[i], 6) AS x FROM pn CROSS JOIN range(1, 65) r(i)",
    "sample_cosines": with_("units") + "," + _POOL + " SELECT a.sample_id AS a, b.sample_id AS b, round(list_dot_product(a.q, b.q), 6) AS cosine FROM pn a JOIN pn b ON a.sample_id < b.sample_id",
    "linear_cka": with_("units") + "," + _MOMENTS + " SELECT round(sum(c * c) FILTER (i <= 32 AND j > 32) / (sqrt(sum(c * c) FILTER (i <= 32 AND j <= 32)) * sqrt(sum(c * c) FILTER (i > 32 AND j > 32)) + 1e-12), 6) AS cka FROM g",
    "participation_ratio": with_("units") + "," + _MOMENTS + " SELECT round(pow(sum(c) FILTER (i = j), 2) / sum(c * c), 4) AS ratio FROM g",
    "joined_views": with_("units") + "SELECT unit_id, round((v[1] + v[33]) * 0.5, 6) AS m0, round(sqrt(list_sum([pow((v[i] + v[i + 32]) * 0.5, 2) FOR i IN range(1, 33)])), 6) AS norm, CASE WHEN unit_id % 11 = 0 THEN 0.5 ELSE 0.25 END::DOUBLE AS w0, 64::BIGINT AS width FROM units",
    "morans_i": with_("spots", "knn") + """, z AS (SELECT sample_id, unit_id, value - avg(value) OVER (PARTITION BY sample_id) AS z, count(*) OVER (PARTITION BY sample_id) AS n FROM spots),
        e AS (SELECT sample_id, unit_id, neighbour, 1.0::DOUBLE / count(*) OVER (PARTITION BY sample_id, unit_id) AS w FROM knn WHERE unit_id <> neighbour),
        c AS (SELECT e.sample_id, sum(w * a.z * b.z) AS c, sum(w) AS s0 FROM e JOIN z a ON a.sample_id = e.sample_id AND a.unit_id = e.unit_id JOIN z b ON b.sample_id = e.sample_id AND b.unit_id = e.neighbour GROUP BY 1)
        SELECT sample_id, any_value(n) AS n, round(any_value(n) / any_value(s0) * any_value(c) / sum(z * z), 6) AS moran FROM z JOIN c USING (sample_id) GROUP BY 1""",
    "lattice_spacing": with_("spots") + """, d AS (SELECT a.sample_id, a.unit_id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS dist FROM spots a JOIN spots b ON a.sample_id = b.sample_id AND a.unit_id <> b.unit_id GROUP BY 1, 2)
        SELECT sample_id, round(median(dist), 6) AS spacing, round(min(dist), 6) AS least, round(max(dist), 6) AS most, abs(median(dist) - 2.0) / 2.0 > 0.02 AS escalate FROM d GROUP BY 1""",
    "tile_boxes": with_("spots") + ", c AS (SELECT unit_id, round_even(x * 2.5, 0) AS cx, round_even(y * 2.5, 0) AS cy FROM spots) SELECT unit_id, cx, cy, greatest(0, least(248, cx - 8))::DOUBLE AS x0, greatest(0, least(248, cy - 8))::DOUBLE AS y0, greatest(0, least(248, cx + 8))::DOUBLE AS x1, greatest(0, least(248, cy + 8))::DOUBLE AS y1 FROM c",
}
