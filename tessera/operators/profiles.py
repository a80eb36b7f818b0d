"""Summaries of cohorts, sets, samples and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators.permute import numbered
from tessera.operators.ranks import before
from tessera.operators.statistics import draw
from tessera.operators.tables import materialise


def cohort_counts(sections: DataFrame) -> DataFrame:
    """(sections, n_obs, n_vars, total) of sections (sample_id, n_obs, n_vars, total): sums, but for the widest gene axis."""
    return sections.agg(F.count(F.lit(1)).alias("sections"), F.sum("n_obs").alias("n_obs"), F.max("n_vars").alias("n_vars"), F.sum("total").alias("total"))


def membership(members: DataFrame, k: int) -> DataFrame:
    """(sample_id, full, partial): niches with all of their k + 1 different members, and those padded."""
    per = members.groupBy("sample_id", "unit_id").agg(F.countDistinct("member").alias("n"))
    return per.groupBy("sample_id").agg(F.count_if(F.col("n") == k + 1).alias("full"), F.count_if(F.col("n") <= k).alias("partial"))


def background(means: DataFrame, least: int) -> DataFrame:
    """(sample_id, unit_id, n, kept): a unit's genes of positive mean, kept if there are at least `least`."""
    g = means.groupBy("sample_id", "unit_id").agg(F.count_if(F.col("mean") > 0).alias("n"))
    return g.withColumn("kept", F.col("n") >= least)


def gene_sets(foreground: DataFrame) -> DataFrame:
    """(sample_id, unit_id, genes): the sorted names of each unit's foreground."""
    return foreground.groupBy("sample_id", "unit_id").agg(F.array_sort(F.collect_set("gene")).alias("genes"))


def signature(counts: DataFrame, genes: DataFrame, target: float = 1e4) -> DataFrame:
    """(sample_id, unit_id, score): mean over the signature's genes of log1p(target * count / library), genes without a count
    as zero."""
    n = genes.select("gene").distinct().count()
    library = counts.groupBy("sample_id", "unit_id").agg(F.sum("count").alias("library"))
    some = counts.join(genes.select("gene").distinct(), "gene", "left_semi").join(library, ["sample_id", "unit_id"])
    sums = some.groupBy("sample_id", "unit_id").agg(F.sum(F.log1p(F.col("count") * target / F.col("library"))).alias("s"))
    return library.join(sums, ["sample_id", "unit_id"], "left").select("sample_id", "unit_id", (F.coalesce("s", F.lit(0.0)) / max(n, 1)).alias("score"))


def set_vectors(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(set_id, v): mean of a set's members' vectors, of length one.  members: set_id, key; nodes: key, v, of which the first
    of a key counts."""
    first = nodes.groupBy("key").agg(F.min_by("v", "row").alias("v"))
    rows = members.join(first, "key")
    return V.collected(V.by_dimension(rows, ["set_id"], "v"), ["set_id"]).select("set_id", V.l2_normalise(F.col("v")).alias("v"))


def set_cosines(units: DataFrame, sets: DataFrame) -> DataFrame:
    """(unit_id, set_id, cosine) of every unit and set vector; sets are few and sent to the units' tasks as one row."""
    held = sets.agg(F.collect_list(F.struct("set_id", "v")).alias("sets"))
    rows = units.select("unit_id", F.col("v").alias("__x")).crossJoin(F.broadcast(held))  # held is one row
    return rows.select("unit_id", "__x", F.explode("sets").alias("s")).select("unit_id", "s.set_id", V.cosine(F.col("__x"), F.col("s.v")).alias("cosine"))


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(truth, guess, n, share): counts, and shares of the truth's row."""
    cells = df.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(truth)))


def contrast_verdict(z: Column, bar: float = 1.96) -> Column:
    return F.when(z >= bar, "pass").when(z <= -bar, "inverted").otherwise("not_separated")


def sample_correlations(rhos: DataFrame, least: int = 30) -> DataFrame:
    """(samples, mean, median, se) of samples' correlations (n, rho), of those with at least `least` rows."""
    some = rhos.where((F.col("n") >= least) & F.col("rho").isNotNull())
    return some.agg(F.count(F.lit(1)).alias("samples"), F.avg("rho").alias("mean"), F.median("rho").alias("median"), (F.stddev_samp("rho") / F.sqrt(F.count(F.lit(1)))).alias("se"))


def autocorrelation_summary(morans: DataFrame, top: int = 5, bar: float = 0.3, needed: int = 3) -> DataFrame:
    """(feature, median, least, most, q25, q75, pos, status): features (sample_id, feature, moran) by their median over
    samples; the cohort passes if `needed` of the `top` medians are above `bar`."""
    q = lambda p: F.percentile("moran", F.lit(p))
    g = morans.groupBy("feature").agg(F.median("moran").alias("median"), F.min("moran").alias("least"), F.max("moran").alias("most"), q(0.25).alias("q25"), q(0.75).alias("q75"))
    g = g.withColumn("pos", F.row_number().over(Window.orderBy(F.col("median").desc(), "feature")))  # one row a feature
    hits = g.where(F.col("pos") <= top).agg(F.count_if(F.col("median") > bar).alias("hits"))
    return g.crossJoin(hits).withColumn("status", F.when(F.col("hits") >= needed, "pass").otherwise("fail")).drop("hits")  # hits is one row


def auc_bootstrap(scores: DataFrame, key: str, reps: int, seed: int) -> DataFrame:
    """(rep, auc) of scores (key, score, positive) drawn again with replacement: a row's multiplicity weighs it in the sum of
    midranks, so that rows are never copied; null where only one kind was drawn.  Rows are numbered and ranked in ranges."""
    placed = materialise(numbered(scores, [], [key]).drop("n"), "auc-scores")
    n = placed.count()
    draws = scores.sparkSession.range(1, reps + 1).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("i"))
    draws = draws.select("rep", (draw(F.lit(seed), "rep", "i") % max(n, 1)).alias("place")).groupBy("rep", "place").agg(F.count(F.lit(1)).alias("m"))
    weigh = lambda c: F.sum(F.when(c, F.col("m")).otherwise(0))
    bins = draws.join(placed, "place").groupBy("rep", "score").agg(weigh(F.col("positive")).alias("p"), weigh(~F.col("positive")).alias("q"))
    wins = before(bins, ["rep"], "score", "q", "below").groupBy("rep").agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)), F.sum("p") * F.sum("q")).alias("auc"))
    return wins


def merged(layers: list[DataFrame]) -> DataFrame:
    """(key, value, layer) of declarations (key, value) in layers, the last that names a key wins."""
    each = [x.select("key", "value").withColumn("layer", F.lit(i)) for i, x in enumerate(layers)]
    out = each[0]
    for x in each[1:]:
        out = out.unionByName(x)
    return out.groupBy("key").agg(F.max_by("value", "layer").alias("value"), F.max("layer").alias("layer"))
