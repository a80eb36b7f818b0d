"""Queries of cohort, set, sample and class summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import nulls, profiles, setscore, similarity, statistics
from tessera.operators.tables import materialise
from tessera.plans.evidence import _ring
from tessera.plans.space import _edges, _members
from tessera.plans.studies import _pooled, _subjects
from tessera.plans.tables import counts, spots, table, units, views, with_


def _r(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def cohort_counts(spark: SparkSession, d: str) -> DataFrame:
    c = counts(spark, d).groupBy("sample_id").agg(F.countDistinct("unit_id").alias("n_obs"), F.countDistinct("gene").alias("n_vars"), F.sum("count").alias("total"))
    return _r(profiles.cohort_counts(c), ["total"], 4)


def niche_membership(spark: SparkSession, d: str) -> DataFrame:
    return profiles.membership(_members(spark, d), 6)


def background_floor(spark: SparkSession, d: str) -> DataFrame:
    c = counts(spark, d)
    n = c.count()
    v = setscore.variability(_ring(c), setscore.log_normalised_lists(c, 1e4, n), 2, n)
    return profiles.background(v, 12).groupBy("sample_id", "kept").agg(F.count(F.lit(1)).alias("units"), F.sum("n").alias("genes"))


def foreground_sets(spark: SparkSession, d: str) -> DataFrame:
    c = counts(spark, d)
    n = c.count()
    f = setscore.niche_foreground(_ring(c), setscore.log_normalised_lists(c, 1e4, n), 2, 0.25, 5, digits=9, rows=n)
    return f.select("sample_id", "unit_id", F.concat_ws(",", F.sort_array("top.gene")).alias("genes"))


def niche_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Counts added up over niches, then normalised."""
    c = counts(spark, d)
    n = setscore.log_normalise(setscore.member_sums(_ring(c), c), 1e4)
    return n.groupBy("sample_id", "unit_id").agg(F.count(F.lit(1)).alias("genes"), F.round(F.sum("value"), 4).alias("value"))


def signature_score(spark: SparkSession, d: str) -> DataFrame:
    genes = table(spark, d, "part").where("p_brand = 'Brand#2'").select(F.concat(F.lit("G"), "p_partkey").alias("gene"))
    return _r(profiles.signature(counts(spark, d), genes), ["score"])


def set_cosines(spark: SparkSession, d: str) -> DataFrame:
    """Labels as sets of vectors, each unit against each set."""
    u = units(spark, d)
    nodes = u.select(F.col("unit_id").alias("key"), F.col("unit_id").alias("row"), "v")
    sets = profiles.set_vectors(u.select(F.col("label").alias("set_id"), F.col("unit_id").alias("key")), nodes)
    return _r(profiles.set_cosines(u, sets), ["cosine"])


def confusion_shares(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("truth"), F.col("l_linestatus").alias("guess"))
    return _r(profiles.confusion(li, "truth", "guess"), ["share"])


def compartment_contrasts(spark: SparkSession, d: str) -> DataFrame:
    """Each segment's balances against each other one's."""
    g = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("m"), F.var_samp("c_acctbal").alias("v"))
    a, b = (g.select(*[F.col(c).alias(f"{c}_{x}") for c in g.columns]) for x in "ab")
    z = (F.col("m_a") - F.col("m_b")) / F.sqrt(F.col("v_a") / F.col("n_a") + F.col("v_b") / F.col("n_b"))
    return a.join(b, F.col("c_mktsegment_a") < F.col("c_mktsegment_b")).select(F.col("c_mktsegment_a").alias("first"), F.col("c_mktsegment_b").alias("second"), F.round(z, 6).alias("z"), profiles.contrast_verdict(z, 0.5).alias("verdict"))


def sample_correlations(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sample_id"), "l_quantity", "l_extendedprice")
    return _r(profiles.sample_correlations(statistics.spearman(o, ["sample_id"], "l_quantity", "l_extendedprice")), ["mean", "median", "se"])


def autocorrelation_summary(spark: SparkSession, d: str) -> DataFrame:
    """Moran's I of five features of the customers over their nations."""
    s, edges = spots(spark, d), materialise(_edges(spark, d), "edges")
    features = {"value": F.col("value"), "x": F.col("x"), "y": F.col("y"), "rich": (F.col("value") > 5000).cast("double"), "sum": F.col("x") + F.col("y")}
    m = None
    for name, c in features.items():
        part = statistics.morans_i(s.withColumn("value", c), edges).select("sample_id", F.lit(name).alias("feature"), F.round("moran", 9).alias("moran"))
        m = part if m is None else m.unionByName(part)
    return _r(profiles.autocorrelation_summary(m).withColumn("pos", F.col("pos").cast("long")), ["median", "least", "most", "q25", "q75"])


def auc_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("score"), (F.col("s_nationkey") < 12).alias("positive"))
    return _r(profiles.auc_bootstrap(s, "s_suppkey", 60, 11), ["auc"])


def asymmetry_test(spark: SparkSession, d: str) -> DataFrame:
    """Whether a view is further above the other in biology than in subjects, on the same permutations."""
    made = {}
    for v in ("left", "right"):
        p = _pooled(spark, d, v)
        pair = nulls.pairs(p)
        (ob, nb), (op, np_) = nulls.biology(pair, _subjects(spark, d), 100, 5), nulls.subject(pair, p, 100, 5)
        made[v] = ob.select(F.col("delta").alias("b")).crossJoin(op.select(F.col("delta").alias("p"))).select((F.col("b") - F.col("p")).alias(v)), nulls.paired(nb, np_)  # one row each
    observed = made["left"][0].crossJoin(made["right"][0]).select((F.col("left") - F.col("right")).alias("observed"))  # one row each
    return _r(statistics.permutation_test(nulls.paired(made["left"][1], made["right"][1]), observed, [], "two-sided"), ["observed", "mean", "sd", "z", "p"], 4)


def declarations(spark: SparkSession, d: str) -> DataFrame:
    """Study, cohort and project declarations, the last wins."""
    n, s, r = table(spark, d, "nation"), table(spark, d, "supplier"), table(spark, d, "customer")
    layers = [n.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value")), s.groupBy(F.col("s_nationkey").alias("key")).agg(F.min("s_name").alias("value")), r.where("c_acctbal > 9900").groupBy(F.col("c_nationkey").alias("key")).agg(F.min("c_name").alias("value"))]
    return profiles.merged(layers)


def sample_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of each unit's other view among its own sample's, in both directions, beside a random order."""
    v, out = views(spark, d), None
    for way, (a, b) in {"forth": ("left", "right"), "back": ("right", "left")}.items():
        r = similarity.retrieval_baselines(similarity.retrieval(v, a, b, ["sample_id"]), ["sample_id"]).withColumn("way", F.lit(way))
        out = r if out is None else out.unionByName(r)
    return _r(out, ["mrr", "r1", "r5", "random_mrr", "random_r1", "random_r5"])


QUERIES = [
    cohort_counts, niche_membership, background_floor, foreground_sets, niche_normalised, signature_score, set_cosines, confusion_shares, compartment_contrasts, sample_correlations, autocorrelation_summary,
    auc_bootstrap, asymmetry_test, declarations, sample_retrieval,
]

_C = with_("counts")
_LIB = "lib AS (SELECT *, ln(1 + count * 1e4 / greatest(sum(count) OVER (PARTITION BY sample_id, unit_id), 1)) AS value FROM counts)"
_RING = "ru AS (SELECT sample_id, unit_id, [unit_id, lead(unit_id) OVER w, lead(unit_id, 2) OVER w] AS l FROM (SELECT DISTINCT sample_id, unit_id FROM counts) WINDOW w AS (PARTITION BY sample_id ORDER BY unit_id)), ring AS (SELECT * FROM (SELECT sample_id, unit_id, unnest(l) AS member FROM ru) WHERE member IS NOT NULL)"
_CV = _C + "," + _LIB + "," + _RING + """, m AS (SELECT r.sample_id, r.unit_id, gene, list(value) AS l FROM ring r JOIN lib c ON c.sample_id = r.sample_id AND c.unit_id = r.member GROUP BY 1, 2, 3),
f AS (SELECT sample_id, unit_id, gene, list_concat(l, [0.0::DOUBLE FOR i IN range(3 - len(l))]) AS f FROM m), g AS (SELECT *, list_sort(f)[2] AS med, list_sum(f) / 3 AS mean FROM f),
h AS (SELECT *, round(list_sort([abs(x - med) FOR x IN f])[2] / (mean + 1e-9), 9) AS ratio FROM g)"""


def _asymmetry() -> str:
    from tessera.plans.studies_sql import _biology_null, _dealt, _pool

    both = _pool("x", "[1:32]") + ",\n" + _pool("y", "[33:64]") + ",\n" + _dealt("(SELECT DISTINCT subject_id, label FROM xs)", "subject_id", "label", 100, 5) + ",\n" + _biology_null("x") + ",\n" + _biology_null("y")
    dealt2 = "qb AS (SELECT sample_id AS k, subject_id AS l, row_number() OVER (ORDER BY sample_id) AS place FROM xs), qo AS (SELECT perm, k, row_number() OVER (PARTITION BY perm ORDER BY md5('5:' || perm || ':' || k), k) AS place FROM qb CROSS JOIN range(1, 101) r(perm)), q AS (SELECT perm, qo.k, l FROM qo JOIN qb USING (place))"
    sub = lambda n: f"{n}z AS (SELECT f.perm, round(avg(c) FILTER (f.l = g.l) - avg(c) FILTER (f.l <> g.l), 9) AS v FROM {n}p JOIN q f ON f.k = a JOIN q g ON g.k = b AND g.perm = f.perm GROUP BY 1)"
    obs = lambda n: f"(SELECT round(avg(c) FILTER (la = lb) - avg(c) FILTER (la <> lb), 9) FROM {n}v) - (SELECT round(avg(c) FILTER (sa = sb) - avg(c) FILTER (sa <> sb), 9) FROM {n}p)"
    return f"""WITH {both}, {dealt2}, {sub('x')}, {sub('y')}, o AS (SELECT ({obs('x')}) - ({obs('y')}) AS o), nl AS (SELECT (xn.v - xz.v) - (yn.v - yz.v) AS v FROM xn JOIN xz USING (perm) JOIN yn USING (perm) JOIN yz USING (perm))
    SELECT round(any_value(o), 4) AS observed, count(*) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS sd, round((any_value(o) - avg(v)) / stddev_pop(v), 4) AS z, round((1 + count(*) FILTER (abs(v) >= abs(o)))::DOUBLE / (1 + count(*)), 4) AS p FROM nl, o"""


ORACLE = {
    "cohort_counts": _C + "SELECT count(*) AS sections, sum(o)::BIGINT AS n_obs, max(v) AS n_vars, round(sum(t), 4) AS total FROM (SELECT sample_id, count(DISTINCT unit_id) AS o, count(DISTINCT gene) AS v, sum(count) AS t FROM counts GROUP BY 1)",
    "niche_membership": with_("spots", "knn", "members") + "SELECT sample_id, count(*) FILTER (n = 7) AS full, count(*) FILTER (n <= 6) AS partial FROM (SELECT sample_id, unit_id, count(DISTINCT member) AS n FROM members GROUP BY 1, 2) GROUP BY 1",
    "background_floor": _CV + " SELECT sample_id, n >= 12 AS kept, count(*) AS units, sum(n)::BIGINT AS genes FROM (SELECT sample_id, unit_id, count(*) FILTER (mean > 0) AS n FROM h GROUP BY 1, 2) GROUP BY 1, 2",
    "foreground_sets": _CV + """, k AS (SELECT *, row_number() OVER (PARTITION BY sample_id, unit_id ORDER BY ratio DESC, gene) AS pos, count(*) OVER (PARTITION BY sample_id, unit_id) AS n FROM h WHERE mean > 0)
        SELECT sample_id, unit_id, string_agg(gene, ',' ORDER BY gene) AS genes FROM k WHERE pos <= least(greatest(5, floor(n * 0.25)), n) GROUP BY 1, 2""",
    "niche_normalised": _C + "," + _RING + """, m AS (SELECT r.sample_id, r.unit_id, gene, sum(count) AS c FROM ring r JOIN counts c ON c.sample_id = r.sample_id AND c.unit_id = r.member GROUP BY 1, 2, 3),
        v AS (SELECT *, ln(1 + c * 1e4 / greatest(sum(c) OVER (PARTITION BY sample_id, unit_id), 1)) AS v FROM m) SELECT sample_id, unit_id, count(*) AS genes, round(sum(v), 4) AS value FROM v GROUP BY 1, 2""",
    "signature_score": _C + """, g AS (SELECT 'G' || p_partkey AS gene FROM part WHERE p_brand = 'Brand#2'), l AS (SELECT *, sum(count) OVER (PARTITION BY sample_id, unit_id) AS lib FROM counts)
        SELECT sample_id, unit_id, round(coalesce(sum(ln(1 + count * 1e4 / lib)) FILTER (gene IN (SELECT gene FROM g)), 0) / greatest((SELECT count(*) FROM g), 1), 6) AS score FROM l GROUP BY 1, 2""",
    "set_cosines": with_("units") + """, sd AS (SELECT label AS set_id, i AS dim, avg(v[i]) AS m FROM units CROSS JOIN range(1, 65) r(i) GROUP BY 1, 2), sv AS (SELECT set_id, list(m ORDER BY dim) AS m FROM sd GROUP BY 1)
        SELECT unit_id, set_id, round(list_dot_product(v, m) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(m, m))), 6) AS cosine FROM units CROSS JOIN sv""",
    "confusion_shares": "SELECT l_returnflag AS truth, l_linestatus AS guess, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS share FROM lineitem GROUP BY 1, 2",
    "compartment_contrasts": """WITH g AS (SELECT c_mktsegment AS s, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1), z AS (SELECT a.s AS first, b.s AS second, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS z FROM g a JOIN g b ON a.s < b.s)
        SELECT first, second, round(z, 6) AS z, CASE WHEN z >= 0.5 THEN 'pass' WHEN z <= -0.5 THEN 'inverted' ELSE 'not_separated' END AS verdict FROM z""",
    "sample_correlations": """WITH r AS (SELECT l_suppkey AS k, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1)::DOUBLE / 2 AS a, rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_suppkey, l_extendedprice) - 1)::DOUBLE / 2 AS b FROM lineitem),
        c AS (SELECT k, count(*) AS n, corr(a, b) AS rho FROM r GROUP BY 1) SELECT count(*) AS samples, round(avg(rho), 6) AS mean, round(median(rho), 6) AS median, round(stddev_samp(rho) / sqrt(count(*)), 6) AS se FROM c WHERE n >= 30""",
    "autocorrelation_summary": with_("spots", "knn") + """, ft AS (SELECT sample_id, unit_id, f, CASE f WHEN 'value' THEN value WHEN 'x' THEN x WHEN 'y' THEN y WHEN 'rich' THEN (value > 5000)::INT ELSE x + y END::DOUBLE AS value FROM spots CROSS JOIN (VALUES ('value'), ('x'), ('y'), ('rich'), ('sum')) t(f)),
        z AS (SELECT f, sample_id, unit_id, value - avg(value) OVER (PARTITION BY f, sample_id) AS z, count(*) OVER (PARTITION BY f, sample_id) AS n FROM ft), e AS (SELECT sample_id, unit_id, neighbour, 1.0::DOUBLE / count(*) OVER (PARTITION BY sample_id, unit_id) AS w FROM knn WHERE unit_id <> neighbour),
        c AS (SELECT a.f, e.sample_id, sum(w * a.z * b.z) AS c, sum(w) AS s0 FROM e JOIN z a ON a.sample_id = e.sample_id AND a.unit_id = e.unit_id JOIN z b ON b.f = a.f AND b.sample_id = e.sample_id AND b.unit_id = e.neighbour GROUP BY 1, 2),
        i AS (SELECT f, sample_id, round(CASE WHEN sum(z * z) > 0 THEN any_value(n) / any_value(s0) * any_value(c) / sum(z * z) ELSE 0 END, 9) AS i FROM z JOIN c USING (f, sample_id) GROUP BY 1, 2),
        g AS (SELECT f AS feature, median(i) AS m, min(i) AS lo, max(i) AS hi, quantile_cont(i, 0.25) AS a, quantile_cont(i, 0.75) AS b FROM i GROUP BY 1)
        SELECT feature, round(m, 6) AS median, round(lo, 6) AS least, round(hi, 6) AS most, round(a, 6) AS q25, round(b, 6) AS q75, row_number() OVER (ORDER BY m DESC, feature) AS pos, CASE WHEN (SELECT count(*) FROM g WHERE m > 0.3) >= 3 THEN 'pass' ELSE 'fail' END AS status FROM g""",
    "auc_bootstrap": """WITH s AS (SELECT s_acctbal AS score, s_nationkey < 12 AS pos, row_number() OVER (ORDER BY s_suppkey) - 1 AS place, count(*) OVER () AS n FROM supplier),
        dr AS (SELECT rep, ('0x' || substr(md5('11:' || rep || ':' || i), 1, 8))::BIGINT % (SELECT max(n) FROM s) AS place FROM range(1, 61) r(rep) CROSS JOIN range(0, 100000) q(i) WHERE i < (SELECT max(n) FROM s)),
        b AS (SELECT rep, score, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS q FROM dr JOIN s USING (place) GROUP BY 1, 2), w AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY rep ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b)
        SELECT rep, round((sum(p * (below + q / 2)) / nullif(sum(p)::DOUBLE * sum(q), 0))::DOUBLE, 6) AS auc FROM w GROUP BY 1""",
    "asymmetry_test": _asymmetry(),
    "declarations": """WITH l AS (SELECT n_nationkey AS key, n_name AS value, 0 AS layer FROM nation UNION ALL SELECT s_nationkey, min(s_name), 1 FROM supplier GROUP BY 1 UNION ALL SELECT c_nationkey, min(c_name), 2 FROM customer WHERE c_acctbal > 9900 GROUP BY 1)
        SELECT key, arg_max(value, layer) AS value, max(layer) AS layer FROM l GROUP BY 1""",
    "sample_retrieval": with_("units") + """, n2 AS (SELECT sample_id, unit_id, list_transform(v[1:32], lambda x: x / greatest(sqrt(list_dot_product(v[1:32], v[1:32])), 1e-12)) AS a, list_transform(v[33:64], lambda x: x / greatest(sqrt(list_dot_product(v[33:64], v[33:64])), 1e-12)) AS b FROM units),
        s AS (SELECT p.sample_id, p.unit_id AS q, q.unit_id AS c, round(list_dot_product(p.a, q.b), 12) AS s FROM n2 p JOIN n2 q ON p.sample_id = q.sample_id), w AS (SELECT 'forth' AS way, sample_id, q, c, s FROM s UNION ALL SELECT 'back', sample_id, c, q, s FROM s),
        m AS (SELECT way, q, s AS m FROM w WHERE q = c), r AS (SELECT way, sample_id, q, 1 + count(*) FILTER (c <> q AND s - m > 1e-12) AS rank FROM w JOIN m USING (way, q) GROUP BY 1, 2, 3),
        g AS (SELECT way, sample_id, count(*) AS n, avg(1.0::DOUBLE / rank) AS mrr, avg((rank <= 1)::INT) AS r1, avg((rank <= 5)::INT) AS r5 FROM r GROUP BY 1, 2)
        SELECT way, sample_id, n, round(mrr, 6) AS mrr, round(r1, 6) AS r1, round(r5, 6) AS r5, round(list_sum([1.0::DOUBLE / i FOR i IN range(1, n + 1)]) / n, 6) AS random_mrr, round(least(1, 1.0::DOUBLE / n), 6) AS random_r1, round(least(1, 5.0::DOUBLE / n), 6) AS random_r5 FROM g""",
}
