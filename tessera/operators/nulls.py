"""Permutation nulls of pair statistics, and what is said of them.  Pairs are of samples (pooled vectors), which are few
beside the units; labels that belong to a subject are dealt to subjects, never to samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators.permute import numbered, partner
from tessera.operators.ranks import midranks
from tessera.operators.statistics import null_shape, permuted
from tessera.operators.tables import large, materialise, maybe_broadcast


def pairs(samples: DataFrame, vec: str = "v") -> DataFrame:
    """(a, b, subject_a, subject_b, label_a, label_b, cosine) of all unordered pairs of samples (sample_id, subject_id,
    label, vec); cosines are rounded to 9 digits, so that equal arrangements have equal means."""
    side = lambda x: samples.select(F.col("sample_id").alias(x), F.col("subject_id").alias(f"subject_{x}"), F.col("label").alias(f"label_{x}"), F.col(vec).alias(f"v_{x}"))
    return side("a").join(side("b"), F.col("a") < F.col("b")).withColumn("cosine", F.round(V.cosine(F.col("v_a"), F.col("v_b")), 9)).drop("v_a", "v_b")


def _delta(rows: DataFrame, keys: list[str], same: Column) -> DataFrame:
    """(keys, n_same, n_different, same, different, delta) of rows (total, n): sums of cosines and of pairs."""
    of = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    g = rows.groupBy(*keys).agg(of("n", same).alias("n_same"), of("n", ~same).alias("n_different"), of("total", same).alias("t_same"), of("total", ~same).alias("t_different"))
    g = g.withColumns({"same": F.when(F.col("n_same") > 0, F.col("t_same") / F.col("n_same")), "different": F.when(F.col("n_different") > 0, F.col("t_different") / F.col("n_different"))})
    return g.select(*keys, "n_same", "n_different", "same", "different", F.round(F.col("same") - F.col("different"), 9).alias("delta"))


def biology(pair: DataFrame, subjects: DataFrame, n: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(observed, nulls (perm, value)) of the label's delta over pairs across subjects with both labels known.  subjects
    (subject_id, label): the label is dealt to subjects anew while the compared pairs stay; pairs are added up by pair of
    subjects first, so a permutation costs subjects squared."""
    valid = pair.where("subject_a <> subject_b AND label_a IS NOT NULL AND label_b IS NOT NULL")
    observed = _delta(valid.select(F.col("cosine").alias("total"), F.lit(1).alias("n"), "label_a", "label_b"), [], F.col("label_a") == F.col("label_b"))
    sums = valid.groupBy("subject_a", "subject_b").agg(F.sum("cosine").alias("total"), F.count(F.lit(1)).alias("n"))
    dealt = permuted(subjects, "subject_id", "label", n, seed)
    side = lambda x: dealt.select("perm", F.col("subject_id").alias(f"subject_{x}"), F.col("label").alias(f"label_{x}"))
    both = sums.join(side("a"), "subject_a").join(side("b"), ["perm", "subject_b"])
    return observed, _delta(both, ["perm"], F.col("label_a").eqNullSafe(F.col("label_b"))).select("perm", F.col("delta").alias("value"))


def subject(pair: DataFrame, samples: DataFrame, n: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(observed, nulls) of the subjects' delta; subjects are dealt to samples anew."""
    observed = _delta(pair.select(F.col("cosine").alias("total"), F.lit(1).alias("n"), "subject_a", "subject_b"), [], F.col("subject_a") == F.col("subject_b"))
    dealt = permuted(samples.select("sample_id", "subject_id"), "sample_id", "subject_id", n, seed)
    side = lambda x: dealt.select("perm", F.col("sample_id").alias(x), F.col("subject_id").alias(f"s_{x}"))
    both = pair.select("a", "b", F.col("cosine").alias("total"), F.lit(1).alias("n")).join(side("a"), "a").join(side("b"), ["perm", "b"])
    return observed, _delta(both, ["perm"], F.col("s_a") == F.col("s_b")).select("perm", F.col("delta").alias("value"))


def test(observed: DataFrame, nulls: DataFrame, kind: str) -> DataFrame:
    """One row: the observed delta and its parts, z (observed over the null's deviation, the historical form), z_standard,
    p (one-sided, at least 1 / (1 + n)), the null's shape, the share of nulls below, and why it can't be tested, if so."""
    v, o = F.col("value"), F.col("delta")
    rows = nulls.crossJoin(observed)  # observed is one row
    g = rows.groupBy(*observed.columns).agg(F.count(v).alias("n_permutations"), F.avg(v).alias("null_mean"), F.stddev_pop(v).alias("null_sd"), F.count_if(F.coalesce(v >= o, F.lit(False))).alias("beyond"), F.avg((v < o).cast("double")).alias("percentile"))
    sd = F.when(F.col("null_sd") > 0, F.col("null_sd"))
    reason = F.when((F.col("n_same") == 0) & (F.col("n_different") == 0), "no pairs").when(F.col("n_same") == 0, "no pairs of a kind").otherwise("")
    g = g.withColumns({"z": o / sd, "z_standard": (o - F.col("null_mean")) / sd, "p": (1 + F.col("beyond")) / (1 + F.col("n_permutations")), "kind": F.lit(kind), "untestable": reason}).drop("beyond")
    return g.crossJoin(null_shape(nulls, []).select("skew", "kurtosis", "q05", "q95"))  # one row each


def paired(nulls_a: DataFrame, nulls_b: DataFrame) -> DataFrame:
    """(perm, value): differences of two nulls whose permutations are the same."""
    return nulls_a.join(nulls_b.select("perm", F.col("value").alias("other")), "perm").select("perm", (F.col("value") - F.col("other")).alias("value"))


def geometric_faithfulness(a: DataFrame, b: DataFrame, samples: DataFrame, n: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(observed (delta: Spearman's rho, pearson, n_same: pairs), nulls) of two spaces' pairs (a, b, cosine): the first
    one's samples are relabelled as a whole.  Relabelling keeps the ranks, so they are computed once."""
    first = midranks(a.select("a", "b", "cosine"), [], "cosine", "ra")
    second = midranks(b.select("a", "b", F.col("cosine").alias("other")), [], "other", "rb")
    both = first.join(second, ["a", "b"])
    observed = both.agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.corr("ra", "rb"), 9).alias("delta"), F.corr("cosine", "other").alias("pearson"))
    dealt = permuted(samples.select("sample_id", F.col("sample_id").alias("other_id")), "sample_id", "other_id", n, seed)
    side = lambda x: dealt.select("perm", F.col("sample_id").alias(x), F.col("other_id").alias(f"o_{x}"))
    moved = second.join(side("a"), "a").join(side("b"), ["perm", "b"]).select("perm", "rb", F.least("o_a", "o_b").alias("a"), F.greatest("o_a", "o_b").alias("b"))
    return observed, moved.join(first, ["a", "b"]).groupBy("perm").agg(F.round(F.corr("ra", "rb"), 9).alias("value"))


def normal_tail(z: Column) -> Column:
    """The upper tail of the normal distribution, to 7.5e-8, by the usual five-term expansion."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / F.lit(2.5066282746310002) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def morans_test(values: DataFrame, edges: DataFrame, n: int, seed: int) -> DataFrame:
    """(sample_id, n, moran, null_mean, null_sd, z, p): Moran's I, its nulls by dealing a sample's values to its units anew (a
    unit's partner is computed, see `permute`), and p from both tails of the normal distribution.  A sample whose nulls
    don't vary, as one that is constant or of mutual neighbours only, has z 0 and p 1."""
    z = materialise(numbered(values.select("sample_id", "unit_id", "value"), ["sample_id"], ["unit_id"]), "moran-values")
    means = maybe_broadcast(large(materialise(z.groupBy("sample_id").agg(F.avg("value").alias("mean")), "means")))
    z = z.join(means, "sample_id").select("sample_id", "unit_id", "place", "n", (F.col("value") - F.col("mean")).alias("z"))
    perms = F.explode(F.sequence(F.lit(0), F.lit(n))).alias("perm")  # 0 is the observed order
    order = z.select("sample_id", "unit_id", "place", "n", perms).select("perm", "sample_id", "unit_id", partner(F.col("place"), F.col("n"), F.col("perm"), seed).alias("place"))
    dealt = order.join(large(z.select("sample_id", "place", "z")), ["sample_id", "place"]).select("perm", "sample_id", "unit_id", "z")
    weights = edges.where("unit_id <> neighbour").withColumn("w", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("sample_id", "unit_id")))
    other = dealt.select("perm", "sample_id", F.col("unit_id").alias("neighbour"), F.col("z").alias("zn"))
    cross = weights.join(large(dealt), ["sample_id", "unit_id"]).join(large(other), ["perm", "sample_id", "neighbour"]).groupBy("perm", "sample_id").agg(F.sum(F.col("w") * F.col("z") * F.col("zn")).alias("c"), F.sum("w").alias("s0"))
    own = z.groupBy("sample_id").agg(F.sum(F.col("z") * F.col("z")).alias("zz"), F.first("n").alias("n"))
    i = cross.join(own, "sample_id").select("perm", "sample_id", "n", F.when(F.col("zz") > 0, F.col("n") / F.col("s0") * F.col("c") / F.col("zz")).otherwise(0.0).alias("i"))
    g = i.groupBy("sample_id", "n").agg(F.max(F.when(F.col("perm") == 0, F.col("i"))).alias("moran"), F.avg(F.when(F.col("perm") > 0, F.col("i"))).alias("null_mean"), F.stddev_pop(F.when(F.col("perm") > 0, F.col("i"))).alias("null_sd"))
    score = F.when(F.col("null_sd") > 1e-9, (F.col("moran") - F.col("null_mean")) / F.col("null_sd")).otherwise(0.0)
    return g.withColumn("z", score).withColumn("p", F.when(F.col("null_sd") > 1e-9, 2 * normal_tail(F.abs(F.col("z")))).otherwise(1.0))
