"""From tables of results to candidates: readers by declared name, task families, what can't be routed, gates on hypotheses.

A reader turns a table of results into (method_id, value, ci_lo, ci_hi, source); which one a task uses is declared."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_readers: dict[str, Callable[..., DataFrame]] = {}
CANDIDATE = ["method_id", "value", "ci_lo", "ci_hi", "source"]


def reader(name: str) -> Callable:
    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _readers[name] = f
        return f

    return register


def read(name: str, results: DataFrame, **options: object) -> DataFrame:
    """The candidates of the reader of that name; an unknown name is refused."""
    if name not in _readers:
        raise KeyError(f"no reader {name!r}; there are {sorted(_readers)}")
    return _readers[name](results, **options).select(F.lit(name).alias("reader"), *CANDIDATE)


def _candidate(df: DataFrame, value: Column, digits: int, lo: Column | None = None, hi: Column | None = None, source: Column | None = None) -> DataFrame:
    bound = lambda c: F.lit(None).cast("double") if c is None else F.round(c, digits)
    return df.select("method_id", F.round(value.cast("double"), digits).alias("value"), bound(lo).alias("ci_lo"), bound(hi).alias("ci_hi"), (F.lit(None).cast("string") if source is None else source).alias("source"))


@reader("auc_interval")
def _auc(results: DataFrame) -> DataFrame:
    """results: method_id, auc, lo, hi."""
    return _candidate(results.where("auc IS NOT NULL"), F.col("auc"), 4, F.col("lo"), F.col("hi"))


@reader("ratio_interval")
def _ratio(results: DataFrame) -> DataFrame:
    """results: method_id, ratio, lo, hi."""
    return _candidate(results.where("ratio IS NOT NULL"), F.col("ratio"), 3, F.col("lo"), F.col("hi"))


@reader("coherence")
def _coherence(results: DataFrame, intervals: DataFrame, view: str = "z_he") -> DataFrame:
    """results: method_id, view, ari; intervals: method_id, ari, lo, hi.  A method that only the intervals have takes its
    value from there, and says so."""
    point = results.where(F.col("view") == view).select("method_id", F.col("ari").alias("point"))
    both = point.join(intervals, "method_id", "full_outer")
    return _candidate(both, F.coalesce("point", "ari"), 3, F.col("lo"), F.col("hi"), F.when(F.col("point").isNotNull(), "table").otherwise("intervals"))


@reader("raw_floor")
def _raw_floor(results: DataFrame, view: str = "raw_he", label: str = "time") -> DataFrame:
    """results: method_id, view, label, test_type, z.  Biology's z over the subject's on features that no method touched."""
    rows = results.where(F.col("view") == view)
    z = lambda kind, more: F.first(F.when((F.col("test_type") == kind) & more, F.col("z")), ignorenulls=True)
    g = rows.groupBy("method_id").agg(z("biology", F.col("label") == label).alias("b"), z("patient", F.lit(True)).alias("s")).where("b IS NOT NULL AND s <> 0")
    return _candidate(g, F.col("b") / F.col("s"), 4, source=F.lit(view))


@reader("coherence_reference")
def _reference(results: DataFrame) -> DataFrame:
    """results: method_id, ari of the untouched modality: reported, never decisive."""
    return _candidate(results, F.col("ari"), 3)


@reader("significant_count")
def _significant(results: DataFrame, view: str = "z_he", alpha: float = 0.05) -> DataFrame:
    """results: method_id, view, testable, q.  How many testable tests survive; a method without testable ones is left out."""
    g = results.where((F.col("view") == view) & F.col("testable")).groupBy("method_id").agg(F.count_if(F.coalesce(F.col("q") < alpha, F.lit(False))).alias("n"))
    return _candidate(g, F.col("n"), 0)


@reader("signature_z")
def _signature(results: DataFrame, view: str = "z_he") -> DataFrame:
    """results: method_id, view, z, significant.  A signature that fails its own test has 0, not a rank."""
    rows = results.where(F.col("view") == view)
    return _candidate(rows, F.when(F.coalesce("significant", F.lit(True)), F.col("z")).otherwise(0.0), 1)


def readers() -> list[str]:
    return sorted(_readers)


def pack(families: DataFrame, proposals: DataFrame) -> DataFrame:
    """(task_id, axis, outcome, winner, margin, authored) of every declared family; one without candidates is not_available
    and nobody's choice."""
    rows = families.select("task_id").distinct().join(proposals, "task_id", "left")
    return rows.select("task_id", "axis", F.coalesce("outcome", F.lit("not_available")).alias("outcome"), "winner", "margin", F.col("outcome").isNotNull().alias("authored"))


def routable(families: DataFrame, candidates: DataFrame) -> DataFrame:
    """(task_id, routable): whether a family has evidence."""
    have = candidates.select("task_id").distinct().withColumn("routable", F.lit(True))
    return families.select("task_id").distinct().join(have, "task_id", "left").select("task_id", F.coalesce("routable", F.lit(False)).alias("routable"))


def pathway_families(results: DataFrame, bh: Callable[[DataFrame, list[str]], DataFrame], view: str = "z_he") -> DataFrame:
    """results (method_id, view, test, testable, p) with q_headline, over the testable tests of one view in all methods,
    and q_all, over every row.  bh: gives q for (rows, family)."""
    keys = ["method_id", "view", "test"]
    head = bh(results.where((F.col("view") == view) & F.col("testable")).withColumn("family", F.lit(0)), ["family"]).select(*keys, F.col("q").alias("q_headline"))
    every = bh(results.withColumn("family", F.lit(0)), ["family"]).select(*keys, F.col("q").alias("q_all"))
    return results.join(head, keys, "left").join(every, keys, "left")


def pathway_gate(results: DataFrame, circular: DataFrame, view: str = "z_he", alpha: float = 0.05) -> DataFrame:
    """(method_id, n_testable, n_significant, same_split, circular, status) of results (method_id, view, testable, q, n_test):
    fail if the view is circular for the method (circular: method_id, view) or if methods were tested on different rows."""
    rows = results.where(F.col("view") == view)
    splits = rows.agg(F.countDistinct("n_test").alias("splits"))
    g = rows.groupBy("method_id").agg(F.count_if("testable").alias("n_testable"), F.count_if(F.col("testable") & F.coalesce(F.col("q") < alpha, F.lit(False))).alias("n_significant"))
    bad = circular.where(F.col("view") == view).select("method_id", F.lit(True).alias("circular")).distinct()
    g = g.crossJoin(splits).join(bad, "method_id", "left").withColumns({"same_split": F.col("splits") == 1, "circular": F.coalesce("circular", F.lit(False))})  # splits is one row
    return g.select("method_id", "n_testable", "n_significant", "same_split", "circular", F.when(F.col("circular") | ~F.col("same_split"), "fail").otherwise("pass").alias("status"))


def capacity(plans: DataFrame, disk_share: float = 0.9, memory_share: float = 0.8) -> DataFrame:
    """plans (plan_id, disk_gb, free_gb, memory_gb, available_gb, hours, limit_hours) with checks (resource, fits) of what
    has a limit, all strictly below it, and verdict, blocked_by and not_checked of them.  Disk or memory without a figure
    was not looked at; a walltime without one has no limit and needs no look."""
    c = F.col
    some = lambda name, known, ok: F.when(known, F.struct(F.lit(name).alias("resource"), ok.alias("fits")))
    limited = c("limit_hours").isNotNull() & (c("limit_hours") != 0)
    checks = F.array_compact(F.array(some("disk", c("free_gb").isNotNull(), c("disk_gb") < disk_share * c("free_gb")), some("memory", c("available_gb").isNotNull(), c("memory_gb") < memory_share * c("available_gb")), some("walltime", limited, c("hours") < c("limit_hours"))))
    blocked = F.transform(F.filter("checks", lambda x: ~x["fits"]), lambda x: x["resource"])
    missing = F.array_except(F.array(F.lit("disk"), F.lit("memory")), F.transform("checks", lambda x: x["resource"]))
    return plans.withColumn("checks", checks).withColumns({"blocked_by": blocked, "not_checked": missing}).withColumn("verdict", F.when(F.size("blocked_by") == 0, "fits").otherwise("does_not_fit"))


def ablations(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """(with_id, without_id, task_id, axis, delta, separated) of matched methods: whether a part moves a result beyond the
    intervals."""
    side = lambda x: candidates.select("task_id", "axis", F.col("method_id").alias(f"{x}_id"), *[F.col(c).alias(f"{x}_{c}") for c in ("value", "ci_lo", "ci_hi")])
    both = pairs.join(side("with"), "with_id").join(side("without"), ["task_id", "axis", "without_id"])
    apart = (F.col("with_ci_lo") > F.col("without_ci_hi")) | (F.col("without_ci_lo") > F.col("with_ci_hi"))
    return both.select("with_id", "without_id", "task_id", "axis", F.round(F.col("with_value") - F.col("without_value"), 6).alias("delta"), apart.alias("separated"))


def fit(declared: DataFrame, encoders: DataFrame, platforms: DataFrame, samples: DataFrame) -> DataFrame:
    """(encoder, platform, n_samples, relation, ratio, shortfall_pct) of what each declared encoder was built on and each
    platform supplies.  encoders: encoder, modality (he, st), expects, footprint, classes; platforms: platform, tile, class;
    samples: platform.  A tile encoder's unit differs by a margin, which is stated as a ratio and never judged; a molecular
    one's by kind, which membership decides.  An encoder that nobody knows, or that expects nothing, has one row."""
    known = declared.select("encoder").join(encoders, "encoder", "left")
    pairs = known.join(platforms.select("platform", "tile", "class"), F.coalesce("expects", F.lit(False)), "left")  # a grid: what is declared against what there is
    tile = F.when(F.col("tile").isNull(), "not_stated").when(F.col("footprint").isNull(), "encoder_states_none").otherwise("comparable")
    kind = F.when(F.col("class").isNull(), "not_stated").when(F.array_contains("classes", F.col("class")), "in_class").otherwise("out_of_class")
    relation = F.when(F.col("modality").isNull(), "undeclared_encoder").when(~F.col("expects"), "encoder_states_none").when(F.col("modality") == "he", tile).otherwise(kind)
    ratio = F.col("tile") / F.col("footprint")
    made = pairs.withColumn("relation", relation).withColumns({"ratio": F.when(F.col("relation") == "comparable", F.round(ratio, 3)), "shortfall_pct": F.when(F.col("relation") == "comparable", F.when(ratio < 1, F.round((1 - ratio) * 100, 1)).otherwise(0.0))})
    return made.join(samples.groupBy("platform").agg(F.count(F.lit(1)).alias("n_samples")), "platform", "left").select("encoder", "platform", "n_samples", "relation", "ratio", "shortfall_pct")


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
