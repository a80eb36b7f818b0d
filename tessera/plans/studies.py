"""Queries of permutation tests, readers, gates, carried columns, splits and fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import cells, evidence, learning, nulls, similarity, statistics, units
from tessera.plans.space import _edges
from tessera.plans.studies_sql import ORACLE as ORACLE
from tessera.plans.tables import spots, table, views
from tessera.plans.tables import units as vectors


def _r(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# permutation tests of pooled samples --------------------------------------------------------------------------------


def _pooled(spark: SparkSession, d: str, vec: str = "v") -> DataFrame:
    """Forty samples of fourteen subjects, whose label is the subject's; one kind of subject has none."""
    rows = views(spark, d).withColumn("sample_id", F.col("unit_id") % 40)
    p = similarity.mean_pool_l2(rows, ["sample_id"], vec).withColumn("subject_id", F.col("sample_id") % 14)
    return p.withColumn("label", F.when(F.col("subject_id") % 4 < 3, F.col("subject_id") % 4)).select("sample_id", "subject_id", "label", "v")


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return _pooled(spark, d).select("subject_id", "label").distinct()


_TEST = ["same", "different", "delta", "null_mean", "null_sd", "z", "z_standard", "p", "skew", "kurtosis", "q05", "q95", "percentile"]


def biology_perm_test(spark: SparkSession, d: str) -> DataFrame:
    observed, null = nulls.biology(nulls.pairs(_pooled(spark, d)), _subjects(spark, d), 200, 5)
    return _r(nulls.test(observed, null, "biology"), _TEST, 4)


def patient_perm_test(spark: SparkSession, d: str) -> DataFrame:
    p = _pooled(spark, d)
    observed, null = nulls.subject(nulls.pairs(p), p, 200, 6)
    return _r(nulls.test(observed, null, "patient"), _TEST, 4)


def paired_perm_test(spark: SparkSession, d: str) -> DataFrame:
    """Whether one view separates the label more than the other, on the same permutations."""
    (oa, na), (ob, nb) = (nulls.biology(nulls.pairs(_pooled(spark, d, v)), _subjects(spark, d), 200, 5) for v in ("left", "right"))
    observed = oa.select(F.col("delta").alias("a")).crossJoin(ob.select(F.col("delta").alias("b"))).select((F.col("a") - F.col("b")).alias("observed"))  # one row each
    return _r(statistics.permutation_test(nulls.paired(na, nb), observed, [], "two-sided"), ["observed", "mean", "sd", "z", "p"], 4)


def geometric_faithfulness(spark: SparkSession, d: str) -> DataFrame:
    p = _pooled(spark, d)
    observed, null = nulls.geometric_faithfulness(nulls.pairs(_pooled(spark, d, "left")), nulls.pairs(_pooled(spark, d, "right")), p, 100, 8)
    r = statistics.permutation_test(null, observed.select(F.col("delta").alias("observed")), []).crossJoin(observed.select("n_pairs", "pearson"))  # one row each
    return _r(r, ["observed", "mean", "sd", "z", "p", "pearson"], 4)


def morans_test(spark: SparkSession, d: str) -> DataFrame:
    return _r(nulls.morans_test(spots(spark, d), _edges(spark, d), 20, 3), ["moran", "null_mean", "null_sd", "z", "p"], 5)


def ari_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("g"), "l_returnflag", "l_linestatus")
    return _r(statistics.ari_bootstrap(li, "g", "l_returnflag", "l_linestatus", 50, 4), ["ari"])


# readers and gates ---------------------------------------------------------------------------------------------------


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' shipments as a method's measurements in two views."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("method_id"), F.when(F.col("l_linestatus") == "O", "z_he").otherwise("z_st").alias("view"), F.col("l_returnflag").alias("test"))
    g = li.agg(F.avg("l_discount").alias("x"), F.avg("l_tax").alias("y"), F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("s"))
    return g.withColumns({"p": F.round(F.col("x") / 0.1, 6), "testable": F.col("n") > 5, "n_test": F.lit(14)})


def evidence_readers(spark: SparkSession, d: str) -> DataFrame:
    r = _results(spark, d)
    per = r.where("view = 'z_he'").groupBy("method_id").agg((F.sum("x") / F.count(F.lit(1)) * 10).alias("auc"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    ratio = per.select("method_id", (F.col("auc") / (F.col("hi") + 1)).alias("ratio"), "lo", "hi")
    ari = r.where("test = 'A'").select("method_id", "view", F.col("y").alias("ari"))
    gaps = r.where("test = 'N' AND view = 'z_he'").select("method_id", F.col("x").alias("ari"), (F.col("x") - 0.1).alias("lo"), (F.col("x") + 0.1).alias("hi"))
    biology = r.select("method_id", F.lit("raw_he").alias("view"), F.when(F.col("view") == "z_he", "time").otherwise("other").alias("label"), F.when(F.col("test") == "A", "biology").when(F.col("test") == "R", "patient").alias("test_type"), F.col("s").alias("z")).where("test_type = 'patient' AND label = 'other' OR test_type = 'biology' AND label = 'time' OR test_type = 'biology' AND label = 'other'")
    made = [
        evidence.read("auc_interval", per), evidence.read("ratio_interval", ratio), evidence.read("coherence", ari, intervals=gaps), evidence.read("raw_floor", biology),
        evidence.read("coherence_reference", ari.where("view = 'z_st'")), evidence.read("significant_count", r.withColumn("q", F.col("p")), alpha=0.5), evidence.read("signature_z", r.where("test = 'N'").select("method_id", "view", F.col("s").alias("z"), (F.col("p") < 0.5).alias("significant"))),
    ]
    return evidence.union(made)


def pathway_fdr(spark: SparkSession, d: str) -> DataFrame:
    r = _results(spark, d).select("method_id", "view", "test", "testable", "p")
    bh = lambda df, family: statistics.bh_fdr(df.withColumn("__key", F.concat_ws("/", "method_id", "view", "test")), family, "__key", 0.05)
    return _r(evidence.pathway_families(r, bh), ["q_headline", "q_all"])


def pathway_gate(spark: SparkSession, d: str) -> DataFrame:
    circular = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("method_id"), F.lit("z_he").alias("view"))
    return evidence.pathway_gate(_results(spark, d).withColumn("q", F.col("p")), circular, alpha=0.5)


def capacity_gate(spark: SparkSession, d: str) -> DataFrame:
    size, known = F.col("p_size").cast("double"), lambda kind, x: F.when(F.col("p_type") != kind, F.lit(x))
    plans = table(spark, d, "part").select(F.col("p_partkey").alias("plan_id"), size.alias("disk_gb"), known("SMALL", 50.0).alias("free_gb"), (size / 2).alias("memory_gb"), known("LARGE", 20.0).alias("available_gb"), (F.col("p_retailprice") / 100).alias("hours"), known("PROMO", 10.0).alias("limit_hours"))
    r = evidence.capacity(plans)
    return r.groupBy("verdict", F.concat_ws(",", "blocked_by").alias("blocked_by"), F.concat_ws(",", "not_checked").alias("not_checked"), F.size("checks").alias("checks")).agg(F.count(F.lit(1)).alias("n"))


def ablation_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Matched methods: a supplier and the next one of its nation."""
    s = table(spark, d, "supplier")
    c = s.select(F.lit(0).alias("task_id"), F.lit(0).alias("axis"), F.col("s_suppkey").alias("method_id"), F.col("s_acctbal").alias("value"), (F.col("s_acctbal") - 2000).alias("ci_lo"), (F.col("s_acctbal") + 2000).alias("ci_hi"))
    nxt = F.lead("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    return evidence.ablations(c, s.select(F.col("s_suppkey").alias("with_id"), nxt.alias("without_id")).where("without_id IS NOT NULL"))


def encoder_fit(spark: SparkSession, d: str) -> DataFrame:
    """Parts as encoders, some of them unknown or without expectations, against nations as platforms."""
    p, size = table(spark, d, "part"), F.col("p_size")
    encoders = p.where(size % 13 != 4).select(F.col("p_partkey").alias("encoder"), F.when(F.col("p_type").isin("SMALL", "LARGE"), "he").otherwise("st").alias("modality"), (size % 7 != 5).alias("expects"), F.when(size % 10 != 3, size * 4.0).alias("footprint"), F.when(size % 2 == 0, F.array(F.lit("BUILDING"), F.lit("MACHINERY"))).otherwise(F.array(F.lit("FURNITURE"))).alias("classes"))
    region = F.col("n_regionkey")
    platforms = table(spark, d, "nation").select(F.col("n_nationkey").alias("platform"), F.when(region != 1, 20.0 + 3 * F.col("n_nationkey")).alias("tile"), F.when(region == 0, "BUILDING").when(region == 2, "FURNITURE").when(region == 3, "AUTOMOBILE").when(region == 4, "MACHINERY").alias("class"))
    return evidence.fit(p.select(F.col("p_partkey").alias("encoder")), encoders, platforms, table(spark, d, "customer").select(F.col("c_nationkey").alias("platform")))


def task_families(spark: SparkSession, d: str) -> DataFrame:
    return evidence.routable(table(spark, d, "nation").select(F.col("n_nationkey").alias("task_id")), table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("task_id")))


# units ------------------------------------------------------------------------------------------------------------------


def carry_per_unit(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.lit(0).alias("sample_id"), F.col("doc_id").alias("unit_id"))
    labels = table(spark, d, "labels").select(F.lit(0).alias("sample_id"), F.col("doc_id").alias("unit_id"), "quality", F.when(F.col("quality") == 1, F.col("toxic")).alias("toxic"))
    return units.carry(docs, labels, ["quality", "toxic"]).drop("sample_id")


def patient_split(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("segment"))
    return units.split_subjects(c, "segment", 0.2, 42)


def dominant_class(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(*[F.avg((F.col("l_returnflag") == k).cast("double")).alias(k) for k in "ANR"])
    return li.select("l_orderkey", units.dominant({k: F.col(k) for k in "ANR"}, 0.5).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def parsed_keys(spark: SparkSession, d: str) -> DataFrame:
    """Key suffixes, yes and no, files named in prose and templates expanded over a grid."""
    p = table(spark, d, "part").select("p_partkey", F.concat("p_brand", F.when(F.col("p_size") > 25, "__cluster_").otherwise("_"), "p_type").alias("key"), F.concat(F.lit(" "), F.upper(F.when(F.col("p_size") > 40, "yes").when(F.col("p_size") > 10, "no"))).alias("answer"), F.concat(F.lit("see runs/"), "p_type", F.lit("/{run}.json and table.tsv, not this.one")).alias("prose"))
    p = p.select("p_partkey", units.key_suffix(F.col("key")).alias("suffix"), units.truthy(F.col("answer")).cast("string").alias("yes"), F.explode(units.named_files(F.col("prose"))).alias("file"))
    runs = table(spark, d, "region").select(F.col("r_name").alias("run"))
    return units.expanded(p, "file", runs, "run").groupBy("suffix", "yes", "file", "run").agg(F.count(F.lit(1)).alias("n"))


def slice_difference(spark: SparkSession, d: str) -> DataFrame:
    """A space against itself with vectors moved and some missing."""
    cached = vectors(spark, d)
    moved = cached.where("label <> 3").withColumn("v", F.when(F.col("label") == 5, F.transform("v", lambda x: x * 1.5)).otherwise(F.transform("v", lambda x: x + 0.25)))
    return _r(units.slice_difference(moved, cached, ["unit_id"], "v"), ["max_abs", "mean_abs", "max_rel", "min_cosine", "mean_cosine"])


def _coarse(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A space encoded with one digit, the space itself, and how their neighbours agree."""
    cached = vectors(spark, d)
    computed = cached.withColumn("v", F.transform("v", lambda x: F.round(x, 1)))
    near = lambda u: similarity.nearest_vectors(u, 6)
    return computed, cached, units.agreement_shares(units.neighbour_agreement(near(computed), near(cached), cached))


def neighbour_agreement(spark: SparkSession, d: str) -> DataFrame:
    return _r(_coarse(spark, d)[2], ["set_agreement", "set_exact", "ordered"])


def slice_acceptance(spark: SparkSession, d: str) -> DataFrame:
    """The coarse encoding by the declared limits, and by loose ones."""
    computed, cached, shares = _coarse(spark, d)
    diff = units.slice_difference(computed, cached, ["unit_id"], "v")
    return units.accepted(diff, shares).withColumn("rule", F.lit("strict")).unionByName(units.accepted(diff, shares, 1.0, 0.5, 0.0).withColumn("rule", F.lit("loose")))


def attention_profile(spark: SparkSession, d: str) -> DataFrame:
    e = vectors(spark, d).select("label", F.slice("v", 1, 7).alias("w"))
    return _r(units.attention_profile(e, "label", "w").withColumn("pos", F.col("pos").cast("long")), ["mean", "std"])


def projection_profile(spark: SparkSession, d: str) -> DataFrame:
    e = vectors(spark, d).select("label", F.round(F.col("v")[0] + F.col("v")[1], 9).alias("x"))
    return _r(units.profile_by_class(e, "label", "x").withColumn("pos", F.col("pos").cast("long")), ["mean", "std"])


def section_status(spark: SparkSession, d: str) -> DataFrame:
    """Brands as checks; small parts are sections that couldn't be measured, and make up whole checks."""
    c = table(spark, d, "part").select(F.concat("p_brand", (F.col("p_size") <= 5).cast("int")).alias("check_id"), F.when(F.col("p_size") > 5, F.col("p_size") > 15).alias("passed"))
    return units.per_section(c, "all").withColumn("rule", F.lit("all")).unionByName(units.per_section(c, "fraction", 0.75).withColumn("rule", F.lit("fraction")))


def ordered_trace(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    r = e.select(F.concat("event_type", F.lit("::"), "user_id").alias("step"), F.when(F.col("value") < 9, F.col("value")).alias("duration"), F.col("event_id").alias("at"))
    return _r(units.trace(r).withColumn("place", F.col("place").cast("long")), ["duration"], 4)


def loaded_features(spark: SparkSession, d: str) -> DataFrame:
    """Features side by side, rows with a missing element dropped, weights with one made uniform, by declared roles."""
    e = units.mapped(table(spark, d, "embeddings"), {"unit": "vec_id", "features": "embedding", "class": "label"})
    odd = F.col("class") == 4
    rows = e.select("unit", F.concat(F.slice("features", 1, 3), F.when(odd, F.array(F.lit(float("nan")))).otherwise(F.slice("features", 4, 1))).cast("array<double>").alias("x"), F.when(F.col("class") == 2, F.array(F.lit(None).cast("double"), F.lit(1.0))).otherwise(F.array(F.lit(0.25), F.lit(0.75))).alias("w"))
    kept = rows.where(~V.has_missing(F.col("x"))).select("unit", "x", V.uniform_if_missing(F.col("w"), 2).alias("w"))
    return kept.select("unit", F.round(V.norm(F.col("x")), 6).alias("norm"), F.col("w")[0].alias("w0"), F.size("x").cast("long").alias("width"))


# fitted models --------------------------------------------------------------------------------------------------------------


def cluster_agreement(spark: SparkSession, d: str) -> DataFrame:
    return learning.cluster_agreement(vectors(spark, d), "label", 10, 42)


def linear_probe(spark: SparkSession, d: str) -> DataFrame:
    u = vectors(spark, d)
    return learning.linear_probe(u, "label", units.split_subjects(u.withColumn("one", F.lit(1)), "one", 0.3, 1))


def _parts(spark: SparkSession, d: str, u: DataFrame) -> DataFrame:
    """`u` with part: test for four subjects of all runs' union."""
    out = cells.held_out(u, "subject_id", 4, 1).withColumn("part", F.lit("test"))
    return u.join(out, "subject_id", "left").withColumn("part", F.coalesce("part", F.lit("train")))


def transfer_test(spark: SparkSession, d: str) -> DataFrame:
    """A direction fitted to the label on some subjects, tested on others, against permuted labels: one cell of all dimensions."""
    u = _parts(spark, d, vectors(spark, d)).select("unit_id", "part", F.col("v").alias("z"), F.array(F.col("label").cast("double")).alias("y"))
    return _r(cells.study(u, [], "unit_id", 40, 9), ["r_full", "r_train", "r_test", "z_full", "z_test"])


def cca_cells(spark: SparkSession, d: str) -> DataFrame:
    """Two runs, two views, two targets: each cell's correlation over all its units and on held-out subjects, against nulls."""
    u = _parts(spark, d, views(spark, d)).withColumn("run", F.col("label") % 2)
    z = F.explode(F.create_map(F.lit("left"), F.slice("left", 1, 2), F.lit("right"), F.slice("right", 1, 2))).alias("view", "z")
    y = F.explode(F.create_map(F.lit("third"), F.array(F.col("v")[2]), F.lit("sum"), F.array(F.col("v")[0] + F.col("v")[39]))).alias("target", "y")
    rows = u.select("unit_id", "run", "part", "v", z).select("unit_id", "run", "part", "view", "z", y)
    return _r(cells.study(rows, ["run", "view", "target"], "unit_id", 20, 7), ["r_full", "r_train", "r_test", "z_full", "p_full", "z_test", "p_test"], 5)


def cca_transfer(spark: SparkSession, d: str) -> DataFrame:
    """Correlations of held-out rows along directions fitted on the others."""
    v = views(spark, d)
    s = units.split_subjects(v.withColumn("one", F.lit(1)), "one", 0.3, 1)
    train, test = (v.join(s.where(F.col("part") == p).select("subject_id"), "subject_id") for p in ("train", "test"))
    r = learning.cca_scores(train, test, "left", "right", 3, 1e-4)
    return r.agg(*[F.round(F.corr(F.col("cca_left")[i], F.col("cca_right")[i]), 6).alias(f"r{i}") for i in range(3)])


def cka_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Each draw's CKA of three dimensions of either view."""
    v = views(spark, d).select("unit_id", F.slice("left", 1, 3).alias("left"), F.slice("right", 1, 3).alias("right"))
    return _r(learning.cka_draws(v, "unit_id", "left", "right", 30, 2), ["value"])


QUERIES = [
    biology_perm_test, patient_perm_test, paired_perm_test, geometric_faithfulness, morans_test, ari_bootstrap, evidence_readers, pathway_fdr, pathway_gate, capacity_gate, ablation_pairs, encoder_fit,
    task_families, carry_per_unit, patient_split, dominant_class, parsed_keys, slice_difference, neighbour_agreement, slice_acceptance, attention_profile, projection_profile, section_status, ordered_trace, loaded_features,
    cluster_agreement, linear_probe, transfer_test, cca_cells, cca_transfer, cka_bootstrap,
]
