"""Tests, nulls, agreement and resampling.  Every draw is an order of md5 strings, so it can be repeated anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranks import RUN, before, value_ranks
from tessera.operators.tables import dealt, large, materialise, maybe_broadcast


def draw(*parts: Column | str) -> Column:
    """A number below 2^32 from the md5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(p) if isinstance(p, str) else p for p in parts])), 1, 8), 16, 10).cast("long")


def permuted(labels: DataFrame, key: str, label: str, n: int, seed: int) -> DataFrame:
    """(perm, key, label): the labels dealt to the keys in `n` seeded orders.  labels: one row a key; each permutation is
    a partition of its own."""
    perms = labels.sparkSession.range(1, n + 1).withColumnRenamed("id", "perm")
    base = labels.select(F.col(key).alias("k"), F.col(label).alias("l")).withColumn("place", F.row_number().over(Window.orderBy("k")))
    every = base.crossJoin(F.broadcast(perms))  # n rows a key: the permutations themselves
    order = every.withColumn("to", F.row_number().over(Window.partitionBy("perm").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "perm", "k")), "k")))
    return order.select("perm", "k", F.col("to").alias("place")).join(base.select("place", "l"), "place").select("perm", F.col("k").alias(key), F.col("l").alias(label))


def permutation_test(nulls: DataFrame, observed: DataFrame, keys: list[str], tail: str = "greater") -> DataFrame:
    """(keys, observed, n, mean, sd, z, p): missing nulls are left out; sd is of the population, z null where it is 0;
    p = (1 + as extreme) / (1 + n)."""
    v, o = F.col("value"), F.col("observed")
    beyond = {"greater": v >= o, "less": v <= o, "two-sided": F.abs(v) >= F.abs(o)}[tail]
    there = nulls.where(v.isNotNull() & ~F.isnan(v))
    if keys:
        rows = there.join(F.broadcast(observed) if observed.limit(100_001).count() <= 100_000 else observed, keys)
    else:
        rows = there.crossJoin(observed)  # one row
    out = rows.groupBy(*keys, "observed").agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.count_if(beyond).alias("b"))
    return out.select(*keys, "observed", "n", "mean", "sd", F.when(F.col("sd") > 0, (o - F.col("mean")) / F.col("sd")).alias("z"), ((1 + F.col("b")) / (1 + F.col("n"))).alias("p"))


def null_shape(nulls: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, skew, kurtosis, q05, q95): bias-corrected moments and exact quantiles."""
    v = F.col("value")
    r = nulls.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.skewness(v).alias("s"), F.kurtosis(v).alias("k"), F.percentile(v, F.lit(0.05)).alias("q05"), F.percentile(v, F.lit(0.95)).alias("q95"))
    n = F.col("n").cast("double")
    return r.select(*keys, "n", (F.sqrt(n * (n - 1)) / (n - 2) * F.col("s")).alias("skew"), ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("k") + 6)).alias("kurtosis"), "q05", "q95")


def bh_fdr(p: DataFrame, family: list[str], test: str, alpha: float) -> DataFrame:
    """p with q and rejected: Benjamini-Hochberg within a family; missing p-values are not of it and get no q."""
    there = F.col("p").isNotNull() & ~F.isnan("p")
    w = Window.partitionBy(*family)
    some = p.where(there).withColumn("__i", F.row_number().over(w.orderBy("p", test))).withColumn("__raw", F.col("p") * F.count(F.lit(1)).over(w) / F.col("__i"))
    some = some.withColumn("q", F.least(F.lit(1.0), F.min("__raw").over(w.orderBy(F.col("__i").desc()).rowsBetween(Window.unboundedPreceding, 0))))
    some = some.withColumn("rejected", F.col("q") <= alpha).drop("__i", "__raw")
    return some.unionByName(p.where(~there).withColumns({"q": F.lit(None).cast("double"), "rejected": F.lit(False)}))


def group_bootstrap(rows: DataFrame, group: str, value: str, reps: int, seed: int, level: float = 0.95) -> DataFrame:
    """(groups, mean, lo, hi): interval of the mean when groups, not rows, are drawn again.  Rows are added up by group
    first; a draw only changes how often a group's sums count."""
    parts = rows.groupBy(group).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count(value).alias("n"))
    parts = parts.withColumn("place", F.row_number().over(Window.orderBy(group)) - 1)  # one row a group
    g = parts.count()
    point = parts.agg((F.sum("s") / F.sum("n")).alias("mean"))
    if g < 2:
        return point.select(F.lit(g).cast("long").alias("groups"), "mean", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    reps_df = rows.sparkSession.range(1, reps + 1).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(g - 1))).alias("i"))
    draws = reps_df.select("rep", (draw(F.lit(seed), "rep", "i") % g).cast("int").alias("place")).groupBy("rep", "place").agg(F.count(F.lit(1)).alias("m"))
    stats = draws.join(parts, "place").groupBy("rep").agg((F.sum(F.col("m") * F.col("s")) / F.sum(F.col("m") * F.col("n"))).alias("v"))
    tail = (1 - level) / 2
    ends = stats.agg(F.percentile("v", F.lit(tail)).alias("lo"), F.percentile("v", F.lit(1 - tail)).alias("hi"))
    return point.crossJoin(ends).select(F.lit(g).cast("long").alias("groups"), "mean", "lo", "hi")  # one row each


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """(ari, nmi) of two labellings, from the counts of their table; nmi by the arithmetic mean of the entropies."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumns({"na": F.sum("n").over(Window.partitionBy("a")), "nb": F.sum("n").over(Window.partitionBy("b"))})
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    t = cells.agg(F.sum("n").alias("t")).select(F.col("t").cast("double").alias("t"))
    one = cells.crossJoin(t)  # t is one row
    s = one.agg(
        F.first("t").alias("t"), F.sum(two("n")).alias("sij"), F.sum(F.col("n") / F.col("na") * two("na")).alias("sa"), F.sum(F.col("n") / F.col("nb") * two("nb")).alias("sb"),
        F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"), (-F.sum(F.col("n") / F.col("t") * F.log(F.col("na") / F.col("t")))).alias("ha"), (-F.sum(F.col("n") / F.col("t") * F.log(F.col("nb") / F.col("t")))).alias("hb"),
    )
    expected = F.col("sa") * F.col("sb") / two("t")
    most = (F.col("sa") + F.col("sb")) / 2
    return s.select(F.when(most == expected, 1.0).otherwise((F.col("sij") - expected) / (most - expected)).alias("ari"), F.when(F.col("ha") + F.col("hb") == 0, 1.0).otherwise(2 * F.col("mi") / (F.col("ha") + F.col("hb"))).alias("nmi"))


def welch(df: DataFrame, group: str, value: str, first: object, second: object, tail: str = "greater") -> DataFrame:
    """(n1, n2, mean1, mean2, z) of two groups, sample variances; tail less turns the sign; null without a standard
    error."""
    def of(g: object, i: int) -> list[Column]:
        v = F.when(F.col(group) == F.lit(g), F.col(value).cast("double"))
        return [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"mean{i}"), F.var_samp(v).alias(f"v{i}")]

    r = df.agg(*of(first, 1), *of(second, 2))
    se, sign = F.sqrt(F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2")), -1.0 if tail == "less" else 1.0
    return r.select("n1", "n2", "mean1", "mean2", F.when(se > 0, sign * (F.col("mean1") - F.col("mean2")) / se).alias("z"))


def morans_i(values: DataFrame, edges: DataFrame) -> DataFrame:
    """(sample_id, n, moran): spatial autocorrelation with weights 1 / k over each unit's listed neighbours (itself left
    out); a constant sample has 0."""
    means = maybe_broadcast(large(materialise(values.groupBy("sample_id").agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n")), "means")))  # Spark may take the units for the smaller side
    z = values.join(means, "sample_id").select("sample_id", "unit_id", "n", (F.col("value") - F.col("m")).alias("z"))
    weights = edges.where("unit_id <> neighbour").withColumn("w", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("sample_id", "unit_id")))
    other = z.select("sample_id", F.col("unit_id").alias("neighbour"), F.col("z").alias("zn"))
    cross = weights.join(large(z.drop("n")), ["sample_id", "unit_id"]).join(large(other), ["sample_id", "neighbour"]).groupBy("sample_id").agg(F.sum(F.col("w") * F.col("z") * F.col("zn")).alias("c"), F.sum("w").alias("s0"))
    own = z.groupBy("sample_id").agg(F.sum(F.col("z") * F.col("z")).alias("zz"), F.first("n").alias("n"))
    i = F.when(F.col("zz") > 0, F.col("n") / F.col("s0") * F.col("c") / F.col("zz")).otherwise(0.0)
    return own.join(cross, "sample_id").select("sample_id", "n", i.alias("moran"))


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, n, rho): correlation of average ranks within groups, missing values first.  Groups of up to RUN rows are ranked
    each in one task, which holds few of them; if one is larger, all are ranked in ranges of the values' order."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    if (sizes[1] or 0) <= RUN:
        w = Window.partitionBy(*keys)

        def ranks(c: str) -> Column:
            return F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2

        rows = dealt(df.select(*keys, a, b), sizes[0] or 0, *keys) if keys else df
        return rows.select(*keys, ranks(a).alias("ra"), ranks(b).alias("rb")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("ra", "rb").alias("rho"))
    whole = lambda *c: F.struct(F.lit(0).alias("__all"), *c)  # never missing, so that missing keys and values join too
    rows = df.select(whole(*keys).alias("__k"), whole(a).alias("__x"), whole(b).alias("__y"))
    for c in ("__x", "__y"):
        rows = rows.join(maybe_broadcast(large(materialise(value_ranks(rows.select("__k", c), ["__k"], c, f"{c}r"), "ranks"))), ["__k", c])
    return rows.groupBy("__k").agg(F.count(F.lit(1)).alias("n"), F.corr("__xr", "__yr").alias("rho")).select(*[F.col(f"__k.{k}") for k in keys], "n", "rho")


def auc(scores: DataFrame) -> DataFrame:
    """(n_pos, n_neg, auc) by midranks of scores (score, positive).  Equal scores are counted together first; the order of
    scores is summed in ranges of equal numbers of them, whatever their spread."""
    bins = scores.groupBy(F.col("score").alias("s")).agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("q"))
    wins = before(bins, [], "s", "q", "below")
    return wins.agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)), F.sum("p") * F.sum("q")).alias("auc"))


def ari_bootstrap(df: DataFrame, group: str, a: str, b: str, reps: int, seed: int) -> DataFrame:
    """(rep, ari): agreement of two labellings when groups are drawn again; the counts of each group are taken once."""
    cells = df.groupBy(group, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    places = cells.select(group).distinct().withColumn("place", F.row_number().over(Window.orderBy(group)) - 1)  # one row a group
    g = places.count()
    draws = df.sparkSession.range(1, reps + 1).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(max(g - 1, 0)))).alias("i"))
    draws = draws.select("rep", (draw(F.lit(seed), "rep", "i") % max(g, 1)).cast("int").alias("place")).groupBy("rep", "place").agg(F.count(F.lit(1)).alias("m"))
    n = draws.join(places, "place").join(cells, group).groupBy("rep", "a", "b").agg(F.sum(F.col("m") * F.col("n")).cast("double").alias("n"))
    two = lambda c: c * (c - 1) / 2
    pairs = lambda *k: n.groupBy("rep", *k).agg(F.sum("n").alias("x")).groupBy("rep").agg(F.sum(two(F.col("x"))).alias("s_" + "_".join(["t", *k])))
    s = pairs("a", "b").join(pairs("a"), "rep").join(pairs("b"), "rep").join(pairs(), "rep")
    expected, most = F.col("s_t_a") * F.col("s_t_b") / F.col("s_t"), (F.col("s_t_a") + F.col("s_t_b")) / 2
    return s.select("rep", F.when(most == expected, 1.0).otherwise((F.col("s_t_a_b") - expected) / (most - expected)).alias("ari"))


def ratio_interval(df: DataFrame, a: str, b: str) -> DataFrame:
    """df with ratio, lo and hi: a / b with the interval of two z-scores' ratio; null where b is 0."""
    r = F.when(F.col(b) != 0, F.col(a) / F.col(b))
    half = 1.96 * F.abs(r) * F.sqrt(1 / (F.col(a) * F.col(a)) + 1 / (F.col(b) * F.col(b)))
    half = F.when(F.col(a) != 0, half).otherwise(1.96 / F.abs(F.col(b)))
    return df.withColumns({"ratio": r, "lo": r - half, "hi": r + half})


def hanley_mcneil(df: DataFrame, auc_column: str, pos: str, neg: str) -> DataFrame:
    """df with se, lo and hi of an area under the curve."""
    a, m, n = F.col(auc_column), F.col(pos), F.col(neg)
    q1, q2 = a / (2 - a), 2 * a * a / (1 + a)
    se = F.sqrt((a * (1 - a) + (m - 1) * (q1 - a * a) + (n - 1) * (q2 - a * a)) / (m * n))
    return df.withColumns({"se": se, "lo": F.greatest(F.lit(0.0), a - 1.96 * se), "hi": F.least(F.lit(1.0), a + 1.96 * se)})


def f1_scores(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(accuracy, macro_f1, weighted_f1) from the confusion counts."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("t").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called")), F.struct(F.col("g").alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called")))).alias("s")).select("s.*")
    per = sides.groupBy("c").agg(F.sum("support").alias("support"), F.sum("called").alias("called")).join(cells.where("t = g").select(F.col("t").alias("c"), F.col("n").alias("hit")), "c", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    per = per.withColumn("f1", 2 * F.col("hit") / (F.col("support") + F.col("called")))
    return per.agg((F.sum("hit") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def gini(df: DataFrame, keys: list[str], value: str, top_fraction: float) -> DataFrame:
    """(keys, n, gini, top_mass): inequality of values and the share of the ceil(top_fraction * n) largest."""
    w = Window.partitionBy(*keys)
    r = df.select(*keys, F.col(value).cast("double").alias("x")).withColumns({"i": F.row_number().over(w.orderBy("x")), "n": F.count(F.lit(1)).over(w), "j": F.row_number().over(w.orderBy(F.col("x").desc()))})
    return r.groupBy(*keys).agg(F.first("n").alias("n"), (2 * F.sum(F.col("i") * F.col("x")) / (F.first("n") * F.sum("x")) - (F.first("n") + 1) / F.first("n")).alias("gini"), (F.sum(F.when(F.col("j") <= F.ceil(F.col("n") * top_fraction), F.col("x")).otherwise(0.0)) / F.sum("x")).alias("top_mass"))
