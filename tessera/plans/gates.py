"""Queries of guarded proposals, gates on hypotheses and batch structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import alignment, artifacts, batches, coherence, hierarchy, permute, promotion, similarity
from tessera.operators.tables import fresh_path
from tessera.plans.tables import counts, table, units, views, with_


def _r(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _methods(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select((F.col("s_nationkey") % 9).alias("task_id"), (F.col("s_suppkey") % 5).alias("method_id"), "s_acctbal")
    return s.groupBy("task_id", "method_id").agg(F.round(F.avg("s_acctbal"), 2).alias("m"), F.count(F.lit(1)).alias("n"))


def _guards(spark: SparkSession, d: str) -> DataFrame:
    tasks = table(spark, d, "nation").select((F.col("n_nationkey") % 9).alias("task_id")).distinct().select("task_id", F.when(F.col("task_id") % 4 == 0, "G3").when(F.col("task_id") % 4 < 3, F.when(F.col("task_id") % 2 == 1, "G3").otherwise("G4")).alias("guard"), F.when(F.col("task_id") % 3 == 0, 1.5).alias("floor"))
    inputs = _methods(spark, d).select("task_id", "method_id", (F.col("m") / 1000).alias("biology_z"), F.when(F.col("method_id") != 4, (F.col("n") % 5).cast("double")).alias("confounder_z"))
    return promotion.task_guards(tasks, inputs)


def task_guards(spark: SparkSession, d: str) -> DataFrame:
    return _r(_guards(spark, d), ["value"])


def guarded_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' groups as methods of nine tasks: a blocked one never wins."""
    half = F.lit(1500.0) / F.sqrt(F.col("n").cast("double"))
    c = _methods(spark, d).select("task_id", F.lit(0).alias("axis"), (F.col("task_id") % 2 == 0).alias("higher_is_better"), "method_id", F.col("m").alias("value"), F.round(F.col("m") - half, 2).alias("ci_lo"), F.round(F.col("m") + half, 2).alias("ci_hi"))
    bars = c.select("task_id", "axis").distinct().withColumn("floor", F.when(F.col("task_id") % 3 == 0, 4800.0).when(F.col("task_id") % 3 == 1, 4000.0))
    return promotion.propose(c, bars, _guards(spark, d)).withColumn("tied", F.concat_ws(",", "tied"))


def hypothesis_gates(spark: SparkSession, d: str) -> DataFrame:
    """The gates on labels, held-out subjects and ratios, their statuses counted."""
    s = table(spark, d, "supplier")
    labels = s.select(F.col("s_suppkey").alias("label"), (F.abs("s_acctbal") / 10000).alias("nmi"))
    runs = s.select(F.col("s_suppkey").alias("method_id"), F.lit(8).alias("n_subjects"), (F.col("s_acctbal") / 10000).alias("probe"))
    few = runs.withColumn("n_subjects", F.when(F.col("method_id") == 3, 7).otherwise(8))
    ratios = s.select(F.col("s_suppkey").alias("method_id"), F.col("s_acctbal").alias("ratio"), F.lit(0.0).alias("ci_lo"), F.lit(1.0).alias("ci_hi"), (F.col("s_acctbal") / 1000).alias("biology_z"), (F.col("s_nationkey") % 6).cast("double").alias("confounder_z"))
    parts = [
        promotion.label_gate(labels).select(F.lit("label").alias("gate"), F.concat_ws("/", "status", "reference_status").alias("status"), F.lit(1).alias("pos")),
        promotion.held_out_gate(runs, 8).select(F.lit("held_out").alias("gate"), F.concat_ws("/", "status", F.concat_ws(",", "test_subjects")).alias("status"), F.lit(1).alias("pos")),
        promotion.held_out_gate(few, 8).select(F.lit("held_out_few").alias("gate"), F.concat_ws("/", "status", F.concat_ws(",", "test_subjects")).alias("status"), F.lit(1).alias("pos")),
        promotion.held_out_gate(runs, 8, 9).select(F.lit("held_out_least").alias("gate"), "status", F.lit(1).alias("pos")),
        promotion.ratio_gate(ratios, 1.2).select(F.lit("ratio").alias("gate"), "status", "pos"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("gate", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("places"))


def _pathways(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("method_id"), F.when(F.col("l_linestatus") == "O", "z_he").otherwise("z_st").alias("view"), F.col("l_returnflag").alias("test")).agg(F.avg("l_discount").alias("x"), F.count(F.lit(1)).alias("n"))
    rows = li.select("method_id", "view", "test", (F.col("n") > 5).alias("testable"), F.round(F.col("x") / 0.1, 6).alias("q"), F.lit(7).alias("n_test"), ((F.col("method_id") % 3 != 0) | (F.col("view") == "z_he")).alias("view_clean"))
    features = table(spark, d, "supplier").where("s_acctbal < 5000").select(F.col("s_suppkey").alias("method_id"), F.lit("pathway").alias("feature"))
    return promotion.pathway_gate(rows, features, "z_he", "pathway", alpha=0.5)


def pathway_runs(spark: SparkSession, d: str) -> DataFrame:
    return _pathways(spark, d)[0].withColumns({c: F.concat_ws(",", c) for c in ("significant", "excluded")})


def pathway_guards(spark: SparkSession, d: str) -> DataFrame:
    return _pathways(spark, d)[1]


def pack_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' comments as fields of a pack."""
    names = F.array(*[F.lit(x) for x in ("value", "metric", "note", "floor", "winner", "other", "caveat")])
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("task_id"), F.get(names, (F.col("s_suppkey") % 7).cast("int")).alias("field"))
    return promotion.provenance(s).withColumns({c: F.concat_ws(",", c) for c in ("computed", "declared", "human")})


def _batches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nations as samples: their region is technical, a third of their keys biological, and one variable is the same for all."""
    n = table(spark, d, "nation")
    c = counts(spark, d)
    held = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("sample_id")), "o_custkey").select("sample_id", F.col("o_orderkey").alias("unit_id"))
    one = lambda name, kind, value: n.select(F.col("n_nationkey").alias("sample_id"), F.lit(name).alias("variable"), F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    v = one("region", "technical", F.when(F.col("n_nationkey") != 4, F.col("n_regionkey"))).unionByName(one("third", "biological", F.col("n_nationkey") % 3)).unionByName(one("flat", "technical", F.lit("x")))
    return batches.batch_structure(c, held, v, most_components=100)


def batch_structure(spark: SparkSession, d: str) -> DataFrame:
    return _r(_batches(spark, d)[0], ["silhouette"], 3)


def batch_verdict(spark: SparkSession, d: str) -> DataFrame:
    return _batches(spark, d)[1].select("n_samples", "n_components", "status", "reason")


def kruskal_test(spark: SparkSession, d: str) -> DataFrame:
    return _r(hierarchy.kruskal(table(spark, d, "customer").select("c_mktsegment", F.round("c_acctbal", -1).alias("x")), "c_mktsegment", "x"), ["statistic", "p"])


def ward_tree(spark: SparkSession, d: str) -> DataFrame:
    """Pooled samples merged by Ward's rule, with each merge's height."""
    samples = similarity.mean_pool_l2(units(spark, d).withColumn("sample_id", F.col("unit_id") % 40), ["sample_id"]).select(F.col("sample_id").alias("unit_id"), "v")
    return hierarchy.ward(samples).select("kept", "gone", "size", F.round("height", 6).alias("height"))


def stratified_draw(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 9900, "rare").otherwise(F.col("c_mktsegment")).alias("class"))
    return coherence.stratified(c, "class", "c_custkey", 60, 3).select("c_custkey", "class")


def coherence_z(spark: SparkSession, d: str) -> DataFrame:
    u = units(spark, d).withColumn("label", F.col("label") % 4)
    return _r(coherence.coherence(u, "label", "unit_id", 120, 30, 6), ["same", "different", "delta", "null_mean", "null_sd", "z", "p"], 5)


def random_control(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings through a random projection to three dimensions."""
    z = coherence.random_projection(units(spark, d).select("unit_id", "v"), "v", 3, 17)
    return z.select("unit_id", *[F.round(F.col("z")[i], 6).alias(f"z{i}") for i in range(3)])


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Nations as small files, addressed by content."""
    place = fresh_path(spark, "artifacts")
    n = table(spark, d, "nation").where("n_nationkey <> 3").select(F.concat(F.lit("run"), "n_regionkey").alias("run"), F.concat(F.lit("m"), "n_nationkey").alias("name"), F.concat("n_name", F.lit("|"), "n_nationkey").alias("text"))

    def put(batches):
        from pyarrow import fs as pafs

        system, root = pafs.FileSystem.from_uri(place)
        for batch in batches:
            for run, name, text in zip(*(batch.column(c).to_pylist() for c in ("run", "name", "text")), strict=True):
                system.create_dir(f"{root}/{run}", recursive=True)
                with system.open_output_stream(f"{root}/{run}/{name}.txt") as f:
                    f.write(text.encode())
            yield batch.select(["name"])

    n.mapInArrow(put, "name string").count()
    return artifacts.addressed(spark, place)


def pinned_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Pins of nations: some changed, one missing, some undeclared, some without content."""
    key = F.col("n_nationkey")
    want = F.sha2(F.concat(F.when(key % 5 == 1, F.lit("other")).otherwise(F.col("n_name")), F.lit("|"), "n_nationkey"), 256)
    declared = table(spark, d, "nation").where(key % 7 != 6).select(F.concat(F.lit("run"), "n_regionkey", F.lit("/m"), "n_nationkey", F.lit(".txt")).alias("path"), F.when(key % 5 != 2, want).alias("sha256"))
    return artifacts.pins(declared, _files(spark, d))


def grid_scope(spark: SparkSession, d: str) -> DataFrame:
    """Regions as runs and nations as metrics; a metric's artifact lies with the run of its own region."""
    n = table(spark, d, "nation")
    grid = table(spark, d, "region").select(F.concat(F.lit("run"), "r_regionkey").alias("run")).join(n.select(F.concat(F.lit("m"), "n_nationkey").alias("metric")))  # a grid
    templates = n.where("n_nationkey % 6 <> 5").select(F.concat(F.lit("m"), "n_nationkey").alias("metric"), F.concat(F.lit("{run}/m"), "n_nationkey", F.lit(".txt")).alias("template"))
    off = n.where("n_nationkey % 8 = 7").select(F.concat(F.lit("m"), "n_nationkey").alias("metric"), F.lit("not measured").alias("reason"))
    return artifacts.scope(grid, templates, off, _files(spark, d)).withColumn("lacking", F.concat_ws(",", "lacking"))


def aligned_cosines(spark: SparkSession, d: str) -> DataFrame:
    """Held-out units' two views after Procrustes and CCA fitted on the others, two dimensions each."""
    v = views(spark, d).select("unit_id", "subject_id", F.slice("left", 1, 2).alias("left"), F.slice("right", 1, 2).alias("right"))
    train, test = v.where("subject_id > 3"), v.where("subject_id <= 3")
    fit = alignment.fitted(train, "left", "right", "procrustes", 2)
    return alignment.transformed(test.select("unit_id", "left", "right"), fit, "left", "right").select("unit_id", F.round(V.dot(F.col("z_left"), F.col("z_right")), 6).alias("cosine"))


def three_way_split(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("subject_id"), "c_mktsegment")
    return alignment.three_way_split(c, "c_mktsegment", 0.2, 0.25, 7)


def batch_effect(spark: SparkSession, d: str) -> DataFrame:
    return _r(batches.effect_ratio(units(spark, d), "subject_id"), ["inter", "intra", "ratio"])


def cosine_silhouettes(spark: SparkSession, d: str) -> DataFrame:
    """Of the label within each sample and over all."""
    u = units(spark, d)
    within = batches.cosine_silhouettes(u, "label", ["sample_id"])
    return _r(within.unionByName(batches.cosine_silhouettes(u, "label", []).withColumn("sample_id", F.lit(None).cast("long"))), ["silhouette"])


QUERIES = [aligned_cosines, three_way_split, batch_effect, cosine_silhouettes, stratified_draw, coherence_z, random_control, pinned_artifacts, grid_scope, kruskal_test, ward_tree, task_guards, guarded_proposals, hypothesis_gates, pathway_runs, pathway_guards, pack_provenance, batch_structure, batch_verdict]

_METHODS = """g AS (SELECT s_nationkey % 9 AS task_id, s_suppkey % 5 AS method_id, round(avg(s_acctbal), 2) AS m, count(*) AS n FROM supplier GROUP BY 1, 2),
gt AS (SELECT DISTINCT n_nationkey % 9 AS task_id FROM nation), gi AS (SELECT g.task_id, method_id, CASE WHEN task_id % 4 = 0 OR task_id % 4 = 1 THEN 'G3' WHEN task_id % 4 = 2 THEN 'G4' END AS guard, CASE WHEN task_id % 3 = 0 THEN 1.5 END AS floor, m / 1000 AS b, CASE WHEN method_id <> 4 THEN (n % 5)::DOUBLE END AS c FROM g JOIN gt USING (task_id)),
gr AS (SELECT *, guard = 'G3' AND c IS NOT NULL AS can, CASE WHEN c = 0 THEN 'infinity'::DOUBLE ELSE b / c END AS r FROM gi WHERE guard IS NOT NULL),
gu AS (SELECT task_id, method_id, guard, CASE WHEN can THEN r END AS value, CASE WHEN NOT can THEN 'not_run' WHEN r >= 1 AND coalesce(r >= floor, true) THEN 'pass' ELSE 'fail' END AS status FROM gr)"""
_PATHS = """r AS (SELECT l_suppkey AS method_id, CASE WHEN l_linestatus = 'O' THEN 'z_he' ELSE 'z_st' END AS view, l_returnflag AS test, round(avg(l_discount) / 0.1::DOUBLE, 6) AS q, count(*) > 5 AS testable, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
t AS (SELECT *, method_id % 3 <> 0 OR view = 'z_he' AS clean, method_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 5000) AND view <> 'z_he' AS derived FROM r), w AS (SELECT DISTINCT method_id, view FROM t WHERE clean = derived)"""
_BATCH = with_("counts") + """, un AS (SELECT c_nationkey AS sample_id, count(DISTINCT o_orderkey) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1), pb AS (SELECT gene, sample_id, ln(1 + sum(count) / any_value(n)) AS m FROM counts JOIN un USING (sample_id) GROUP BY 1, 2),
sq AS (SELECT sample_id, sum(m * m) AS s FROM pb GROUP BY 1), dp AS (SELECT a.sample_id AS a, b.sample_id AS b, sum(a.m * b.m) AS d FROM pb a JOIN pb b USING (gene) GROUP BY 1, 2),
ds AS (SELECT x.sample_id AS a, y.sample_id AS b, sqrt(greatest(x.s + y.s - 2 * coalesce(d, 0), 0)) AS d FROM sq x JOIN sq y ON x.sample_id <> y.sample_id LEFT JOIN dp ON dp.a = x.sample_id AND dp.b = y.sample_id),
vr AS (SELECT n_nationkey AS k, 'region' AS variable, 'technical' AS kind, CASE WHEN n_nationkey <> 4 THEN n_regionkey END AS v FROM nation UNION ALL SELECT n_nationkey, 'third', 'biological', n_nationkey % 3 FROM nation),
lb AS (SELECT vr.* FROM vr JOIN un ON un.sample_id = k WHERE v IS NOT NULL), mn AS (SELECT p.variable, p.kind, p.k, p.v AS own, q.v AS other, avg(d) AS d FROM lb p JOIN lb q ON q.variable = p.variable AND q.k <> p.k JOIN ds ON ds.a = p.k AND ds.b = q.k GROUP BY 1, 2, 3, 4, 5),
sl AS (SELECT variable, kind, k, max(d) FILTER (own = other) AS a, min(d) FILTER (own <> other) AS b FROM mn GROUP BY 1, 2, 3), sv AS (SELECT variable, kind, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 4) AS s FROM sl GROUP BY 1, 2)"""

_P = permute.PRIME


def _uniform(at: str, key: int) -> str:
    mixed = lambda x, k: f"((((({x}) + {k}) % {_P} * {permute.FIRST}) % {_P}) * ((({x}) + {k}) % {_P} * {permute.FIRST} % {_P}) % {_P} * {permute.SECOND} + {k}) % {_P}"
    return f"(({mixed(mixed(at, key), 40503)}) + 1)::DOUBLE / {_P + 1}"


ORACLE = {
    "aligned_cosines": with_("units") + """, t AS (SELECT unit_id, subject_id, v[1] AS a, v[2] AS b, v[33] AS c, v[34] AS d FROM units), m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(d) AS md, covar_pop(a, c) AS p, covar_pop(a, d) AS q, covar_pop(b, c) AS r, covar_pop(b, d) AS s FROM t WHERE subject_id > 3),
        w AS (SELECT *, CASE WHEN p * s - q * r > 0 THEN atan2(q - r, p + s) ELSE atan2(q + r, p - s) END AS f, CASE WHEN p * s - q * r > 0 THEN 1 ELSE -1 END AS g FROM m),
        z AS (SELECT unit_id, (a - ma) * cos(f) + (b - mb) * (CASE WHEN g > 0 THEN -sin(f) ELSE sin(f) END) AS x, (a - ma) * sin(f) + (b - mb) * g * cos(f) AS y, c - mc AS u, d - md AS v FROM t, w WHERE subject_id <= 3)
        SELECT unit_id, round((x * u + y * v) / sqrt((x * x + y * y) * (u * u + v * v)), 6) AS cosine FROM z""",
    "three_way_split": """WITH s AS (SELECT c_custkey AS k, c_mktsegment AS g, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('7:' || c_custkey), c_custkey) AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer), a AS (SELECT *, i <= ceil(n * 0.25::DOUBLE) AS t FROM s),
        r AS (SELECT k, row_number() OVER (PARTITION BY g ORDER BY md5('8:' || k), k) AS i, count(*) OVER (PARTITION BY g) AS n FROM a WHERE NOT t)
        SELECT k AS subject_id, g AS stratum, CASE WHEN t THEN 'test' WHEN r.i <= ceil(r.n * (0.2::DOUBLE / 0.75)) THEN 'validation' ELSE 'train' END AS part FROM a LEFT JOIN r USING (k)""",
    "batch_effect": with_("units") + """, m AS (SELECT subject_id AS g, i, avg(v[i]) AS m FROM units CROSS JOIN range(1, 65) t(i) GROUP BY 1, 2), c AS (SELECT g, list(m ORDER BY i) AS c FROM m GROUP BY 1), n AS (SELECT g, c, sqrt(list_dot_product(c, c)) AS n FROM c),
        o AS (SELECT avg(1 - list_dot_product(a.c, b.c) / (a.n * b.n)) AS inter FROM n a JOIN n b ON a.g < b.g), w AS (SELECT g, avg(1 - list_dot_product(v, c) / (sqrt(list_dot_product(v, v)) * n)) AS d FROM units JOIN n ON g = subject_id GROUP BY 1)
        SELECT (SELECT count(*) FROM n) AS subjects, round(inter, 6) AS inter, round(avg(d), 6) AS intra, round(inter / avg(d), 6) AS ratio FROM w, o GROUP BY inter""",
    "cosine_silhouettes": with_("units") + """, u AS (SELECT sample_id, unit_id, label, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS u FROM units WHERE label IS NOT NULL), d AS (SELECT p.sample_id AS ps, q.sample_id AS qs, p.unit_id, p.label AS own, q.label AS other, 1 - list_dot_product(p.u, q.u) AS d FROM u p JOIN u q ON p.unit_id <> q.unit_id),
        e AS (SELECT ps AS k, unit_id, own, other, avg(d) AS d FROM d WHERE ps = qs GROUP BY 1, 2, 3, 4 UNION ALL SELECT NULL, unit_id, own, other, avg(d) FROM d GROUP BY 2, 3, 4), f AS (SELECT k, unit_id, own, max(d) FILTER (own = other) AS a, min(d) FILTER (own <> other) AS b FROM e GROUP BY 1, 2, 3)
        SELECT k AS sample_id, count(*) AS n, count(DISTINCT own) AS classes, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM f GROUP BY 1""",
    "stratified_draw": """WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal > 9900 THEN 'rare' ELSE c_mktsegment END AS class FROM customer), q AS (SELECT *, count(*) OVER (PARTITION BY class) AS n, count(*) OVER () AS a, row_number() OVER (PARTITION BY class ORDER BY md5('3:' || c_custkey), c_custkey) AS r FROM c)
        SELECT c_custkey, class FROM q WHERE r <= least(n, greatest(2, round_even(n * (60.0::DOUBLE / a), 0)))""",
    "coherence_z": "WITH RECURSIVE " + with_("units")[5:] + """, c AS (SELECT unit_id, label % 4 AS c, v FROM units WHERE label IS NOT NULL), q AS (SELECT *, count(*) OVER (PARTITION BY c) AS k, count(*) OVER () AS a, row_number() OVER (PARTITION BY c ORDER BY md5('6:' || unit_id), unit_id) AS r FROM c),
        s AS (SELECT unit_id, c, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS u, row_number() OVER (ORDER BY unit_id) - 1 AS place, count(*) OVER () AS n, 0 AS one FROM q WHERE r <= least(k, greatest(2, round_even(k * (120.0::DOUBLE / a), 0)))),
        """ + permute.sql("s", "one", 30, 6, "pm") + """, lb AS (SELECT perm, pm.place, s.c FROM pm JOIN s ON s.place = partner), pr AS (SELECT a.place AS a, b.place AS b, list_dot_product(a.u, b.u) AS d FROM s a JOIN s b ON a.place < b.place),
        g AS (SELECT x.perm, avg(d) FILTER (x.c = y.c) AS same, avg(d) FILTER (x.c <> y.c) AS different, count(*) FILTER (x.c = y.c) AS ns, count(*) FILTER (x.c <> y.c) AS nd FROM pr JOIN lb x ON x.place = a JOIN lb y ON y.place = b AND y.perm = x.perm GROUP BY 1),
        o AS (SELECT *, same - different AS delta FROM g WHERE perm = 0), z AS (SELECT avg(g.same - g.different) AS m, stddev_pop(g.same - g.different) AS sd, (1 + count(*) FILTER (abs(g.same - g.different) >= abs(o.delta)))::DOUBLE / (1 + count(*)) AS p FROM g, o WHERE g.perm > 0)
        SELECT (SELECT count(*) FROM s) AS n, round(same, 5) AS same, round(different, 5) AS different, round(delta, 5) AS delta, ns AS n_same, nd AS n_different, round(m, 5) AS null_mean, round(sd, 5) AS null_sd, round((delta - m) / (sd + 1e-12), 5) AS z, round(p, 5) AS p FROM o, z""",
    "random_control": with_("units") + f""", g AS (SELECT a // 3 + 1 AS i, a % 3 AS j, sqrt(-2 * ln({_uniform('a', 35)})) * cos(2 * pi() * {_uniform('a', 36)}) / sqrt(3) AS w FROM range(0, 192) t(a)), x AS (SELECT unit_id, j, sum(v[i] * w) AS z FROM units CROSS JOIN g GROUP BY 1, 2),
        n AS (SELECT unit_id, sqrt(sum(z * z)) AS n FROM x GROUP BY 1) SELECT unit_id, round(max(z / n) FILTER (j = 0), 6) AS z0, round(max(z / n) FILTER (j = 1), 6) AS z1, round(max(z / n) FILTER (j = 2), 6) AS z2 FROM x JOIN n USING (unit_id) GROUP BY 1""",
    "pinned_artifacts": """SELECT 'run' || n_regionkey || '/m' || n_nationkey || '.txt' AS path, CASE WHEN n_nationkey % 7 = 6 THEN 'undeclared' WHEN n_nationkey = 3 THEN 'missing' WHEN n_nationkey % 5 = 2 THEN 'unpinned' WHEN n_nationkey % 5 = 1 THEN 'changed' ELSE 'pinned' END AS status FROM nation""",
    "grid_scope": """SELECT 'run' || r_regionkey AS run, 'm' || n_nationkey AS metric, CASE WHEN n_nationkey % 8 = 7 THEN 'not_available' WHEN n_nationkey % 6 = 5 THEN 'undeclared' WHEN n_regionkey = r_regionkey AND n_nationkey <> 3 THEN 'fillable' ELSE 'missing' END AS status,
        CASE WHEN n_nationkey % 6 = 5 OR (n_regionkey = r_regionkey AND n_nationkey <> 3) THEN '' ELSE 'run' || r_regionkey || '/m' || n_nationkey || '.txt' END AS lacking FROM region CROSS JOIN nation""",
    "kruskal_test": """WITH v AS (SELECT c_mktsegment AS g, round(c_acctbal, -1) AS x FROM customer), t AS (SELECT x, count(*) AS t FROM v GROUP BY 1), k AS (SELECT x, t, sum(t) OVER (ORDER BY x) - t + (t + 1) / 2 AS r FROM t),
        s AS (SELECT g, sum(r) AS r, count(*) AS n FROM v JOIN k USING (x) GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n FROM v), h AS (SELECT (12 / (n * (n + 1)) * (SELECT sum(r * r / n) FROM s) - 3 * (n + 1)) / (1 - (SELECT sum(pow(t, 3) - t) FROM t) / (pow(n, 3) - n)) AS h, n FROM n)
        SELECT n::BIGINT AS n, 5 AS groups, round(h, 6) AS statistic, round(exp(-h / 2) * (1 + h / 2), 6) AS p FROM h""",
    "task_guards": f"WITH {_METHODS} SELECT task_id, method_id, guard, round(value, 6) AS value, status, status = 'fail' AS contraindicated FROM gu",
    "guarded_proposals": f"""WITH {_METHODS}, c AS (SELECT g.task_id, g.method_id, m AS value, round(m - 1500 / sqrt(n), 2) AS lo, round(m + 1500 / sqrt(n), 2) AS hi, g.task_id % 2 = 0 AS up, CASE g.task_id % 3 WHEN 0 THEN 4800 WHEN 1 THEN 4000 END AS floor, coalesce(status = 'fail', false) AS blocked FROM g LEFT JOIN gu USING (task_id, method_id)),
        p AS (SELECT *, floor IS NULL OR CASE WHEN up THEN value > floor ELSE value < floor END AS clears, CASE WHEN up THEN -value ELSE value END AS o FROM c),
        a AS (SELECT task_id, count(*) FILTER (clears) AS nc, max(floor) AS floor, arg_min(method_id, (o, method_id)) AS best, arg_min(value, (o, method_id)) AS best_value FROM p GROUP BY 1),
        q AS (SELECT *, row_number() OVER w AS pos, first_value(value) OVER w AS fv, first_value(lo) OVER w AS fl, first_value(hi) OVER w AS fh FROM p WHERE clears AND NOT blocked WINDOW w AS (PARTITION BY task_id ORDER BY o, method_id)),
        l AS (SELECT task_id, list(method_id ORDER BY pos) FILTER (pos = 1 OR value = fv OR (lo <= fh AND fl <= hi)) AS lead, round(abs(max(value) FILTER (pos = 1) - max(value) FILTER (pos = 2)), 4) AS margin FROM q GROUP BY 1)
        SELECT task_id, 0 AS axis, CASE WHEN lead IS NULL THEN 'refuse' WHEN len(lead) > 1 THEN 'tie' ELSE 'recommend' END AS outcome, CASE WHEN len(lead) = 1 THEN lead[1] END AS winner, CASE WHEN len(lead) > 1 THEN array_to_string(lead, ',') ELSE '' END AS tied, margin,
        CASE WHEN lead IS NULL THEN CASE WHEN floor IS NOT NULL AND nc = 0 THEN 'no candidate clears the floor' ELSE 'every candidate is contraindicated by a guard' END END AS refusal, best, best_value FROM a LEFT JOIN l USING (task_id)""",
    "hypothesis_gates": """WITH r AS (SELECT CASE WHEN s_nationkey % 6 = 0 THEN 'infinity'::DOUBLE ELSE s_acctbal / 1000 / (s_nationkey % 6) END AS v, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS pos FROM supplier)
        SELECT 'label' AS gate, CASE WHEN abs(s_acctbal) / 10000 <= 0.5::DOUBLE THEN 'pass/biological' ELSE 'fail/diagnostic' END AS status, count(*) AS n, count(*) AS places FROM supplier GROUP BY 2
        UNION ALL SELECT 'held_out', 'pass/8', 1, 1 UNION ALL SELECT 'held_out_few', 'fail/7,8', 1, 1 UNION ALL SELECT 'held_out_least', 'fail', 1, 1
        UNION ALL SELECT 'ratio', CASE WHEN v >= 1.2 THEN 'pass' ELSE 'fail' END, count(*), sum(pos)::BIGINT FROM r GROUP BY 2""",
    "pathway_runs": f"""WITH {_PATHS}, wr AS (SELECT method_id, count(*) AS n FROM w GROUP BY 1) SELECT method_id, count(*) FILTER (view = 'z_he' AND testable) AS n_testable, count(*) FILTER (view = 'z_he' AND testable AND q < 0.5) AS n_significant,
        coalesce(string_agg(test, ',' ORDER BY test) FILTER (view = 'z_he' AND testable AND q < 0.5), '') AS significant, coalesce(string_agg(test, ',' ORDER BY test) FILTER (view = 'z_he' AND NOT testable), '') AS excluded, false AS circular, coalesce(any_value(wr.n), 0) AS n_disagreeing FROM t LEFT JOIN wr USING (method_id) GROUP BY 1""",
    "pathway_guards": f"WITH {_PATHS} SELECT 'pass' AS held_out, CASE WHEN count(*) = 0 THEN 'pass' ELSE 'flag_disagreement' END AS circular_supervision, count(*) AS n_disagreeing, count(*) FILTER (view = 'z_he') > 0 AS headline_affected FROM w",
    "pack_provenance": """WITH f AS (SELECT DISTINCT s_nationkey AS task_id, ['value', 'metric', 'note', 'floor', 'winner', 'other', 'caveat'][s_suppkey % 7 + 1] AS field FROM supplier), k AS (SELECT *, CASE WHEN field IN ('value', 'winner') THEN 1 WHEN field IN ('metric', 'floor') THEN 2 WHEN field IN ('note', 'caveat') THEN 3 END AS kind FROM f)
        SELECT task_id, coalesce(string_agg(field, ',' ORDER BY field) FILTER (kind = 1), '') AS computed, coalesce(string_agg(field, ',' ORDER BY field) FILTER (kind = 2), '') AS declared, coalesce(string_agg(field, ',' ORDER BY field) FILTER (kind = 3), '') AS human, count(*) FILTER (kind = 3) > 0 AS human_present FROM k GROUP BY 1""",
    "batch_structure": _BATCH + " SELECT variable, kind, count(DISTINCT v)::INT AS n_groups, round(any_value(s), 3) AS silhouette, '' AS note FROM lb JOIN sv USING (variable, kind) GROUP BY 1, 2 UNION ALL SELECT 'flat', 'technical', 1, NULL, 'too few groups or samples'",
    "batch_verdict": _BATCH + " SELECT (SELECT count(*) FROM un) AS n_samples, ((SELECT count(*) FROM un) - 1)::INT AS n_components, CASE WHEN max(s) FILTER (kind = 'technical') <= greatest(0.1, coalesce(max(s) FILTER (kind = 'biological'), 0.1)) THEN 'pass' ELSE 'fail' END AS status, '' AS reason FROM sv",
}
