"""The niche join: assays of a sample's units, pooled over each unit's neighbourhood, with every dropped row counted.

One plan covers the whole cohort; samples are a grouping column, not a loop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.tables import large

UNIT = ["sample_id", "unit_id"]


def unit_inventory(assays: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(units in every assay, a row (n_in, n_out, dropped, status)).  n_in is the largest assay; an empty assay makes the
    step not applicable."""
    keys = [a.select(*UNIT).distinct() for a in assays]
    both = reduce(lambda x, y: x.join(y, UNIT, "left_semi"), keys)
    sizes = reduce(DataFrame.unionByName, [k.agg(F.count(F.lit(1)).alias("n")) for k in keys]).agg(F.max("n").alias("n_in"), F.min("n").alias("least"))
    out = sizes.crossJoin(both.agg(F.count(F.lit(1)).alias("n_out")))  # one row each
    return both, out.select("n_in", "n_out", (F.col("n_in") - F.col("n_out")).alias("dropped"), F.when(F.col("least") == 0, "not_applicable").otherwise("pass").alias("status"))


def neighbourhood(edges: DataFrame, present: DataFrame, k: int) -> DataFrame:
    """(sample_id, unit_id, pos, member): exactly k + 1 members of each present unit, the unit first.  Neighbours that are
    not present are passed over; missing places are filled with the unit itself."""
    here = present.select(*UNIT).distinct()
    others = edges.where("pos > 0").join(large(here.withColumnRenamed("unit_id", "neighbour")), ["sample_id", "neighbour"], "left_semi")
    lists = others.groupBy(*UNIT).agg(F.array_sort(F.collect_list(F.struct("pos", "neighbour"))).alias("l"))
    own = here.join(large(lists), UNIT, "left").withColumn("l", F.slice(F.transform(F.coalesce("l", F.array().cast("array<struct<pos:int,neighbour:bigint>>")), lambda x: x["neighbour"]), 1, k))
    members = F.concat(F.array("unit_id"), "l", F.array_repeat("unit_id", F.lit(k) - F.size("l")))
    return own.select(*UNIT, F.posexplode(members).alias("pos", "member"))


def pooled(members: DataFrame, assay: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of each column over a unit's members, with multiplicity, missing values passed over; `support` counts the
    members that have a row."""
    rows = assay.select("sample_id", F.col("unit_id").alias("member"), *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns])
    return members.join(large(rows.withColumn("__row", F.lit(1))), ["sample_id", "member"], "left").groupBy(*UNIT).agg(F.count("__row").alias("support"), *[F.avg(c).alias(c) for c in columns])


def tokens(members: DataFrame, assay: DataFrame, vec: str) -> DataFrame:
    """(sample_id, unit_id, tokens): the members' vectors in order, the unit's own first; a unit with a member without
    a vector is refused, that is, left out."""
    rows = assay.select("sample_id", F.col("unit_id").alias("member"), F.col(vec).alias("__v"))
    made = members.join(large(rows), ["sample_id", "member"], "left").groupBy(*UNIT).agg(F.array_sort(F.collect_list(F.struct("pos", "__v"))).alias("l"))
    return made.where(~F.exists("l", lambda x: x["__v"].isNull())).select(*UNIT, F.transform("l", lambda x: x["__v"]).alias("tokens"))


def centre_labels(units: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """units with `name` and `{name}__present`: an absent label is null and marked, never a number."""
    found = labels.select(*UNIT, F.col(name)).dropDuplicates(UNIT)
    return units.join(found, UNIT, "left").withColumn(f"{name}__present", F.col(name).isNotNull())


def anchor_coverage(units: DataFrame, anchor: DataFrame, policy: str) -> DataFrame:
    """policy drop: only units in the anchor assay; mark: all, with a column covered; dropped: those not in it."""
    keys = anchor.select(*UNIT).distinct()
    if policy == "mark":
        return units.join(keys.withColumn("covered", F.lit(True)), UNIT, "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
    return units.join(keys, UNIT, {"drop": "left_semi", "dropped": "left_anti"}[policy])


def subject_resolution(units: DataFrame, subjects: DataFrame, policy: str) -> DataFrame:
    """units with subject_id by sample.  A sample with several subjects raises; without one, policy `mark` keeps it with
    subject__present false and `refuse` raises."""
    several = subjects.groupBy("sample_id").agg(F.countDistinct("subject_id").alias("n")).where("n > 1")
    if not several.isEmpty():
        raise ValueError("a sample has several subjects")
    out = units.join(subjects.dropDuplicates(["sample_id"]), "sample_id", "left").withColumn("subject__present", F.col("subject_id").isNotNull())
    if policy == "refuse" and not out.where("NOT subject__present").isEmpty():
        raise ValueError("a sample has no subject")
    return out


def standardise(df: DataFrame, group: list[str], columns: list[str], ddof: int, eps: float, policy: str) -> DataFrame:
    """z-scores within groups.  policy floor: a deviation below eps counts as 1; add: eps is added to it.  The two chains
    that use this differ in ddof and policy on purpose."""
    w = Window.partitionBy(*group)
    spread = F.stddev_pop if ddof == 0 else F.stddev_samp
    out = df
    for c in columns:
        sd = spread(c).over(w)
        by = F.when(sd < eps, 1.0).otherwise(sd) if policy == "floor" else F.coalesce(sd, F.lit(0.0)) + eps
        out = out.withColumn(f"{c}_z", (F.col(c) - F.avg(c).over(w)) / by)
    return out


def funnel(df: DataFrame, stages: list[tuple[str, str]]) -> DataFrame:
    """(stage, name, n_in, n_out, dropped) of conditions applied one after the other, in one pass."""
    kept, sums = F.lit(True), []
    for _, condition in stages:
        kept = kept & F.coalesce(F.expr(condition), F.lit(False))
        sums.append(F.sum(kept.cast("long")))
    row = df.agg(F.count(F.lit(1)).alias("c0"), *[F.coalesce(s, F.lit(0)).alias(f"c{i + 1}") for i, s in enumerate(sums)])
    each = F.array(*[F.struct(F.lit(i).alias("stage"), F.lit(n).alias("name"), F.col(f"c{i}").alias("n_in"), F.col(f"c{i + 1}").alias("n_out")) for i, (n, _) in enumerate(stages)])
    return row.select(F.explode(each).alias("s")).select("s.*").withColumn("dropped", F.col("n_in") - F.col("n_out"))


def drop_distribution(df: DataFrame, group: str, dropped: str) -> DataFrame:
    """(groups, units, rate, min_rate, max_rate, sd_rate, overdispersion, eliminated): how evenly drops fall on groups;
    overdispersion is chi-square over its degrees of freedom, null where it can't be tested."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(dropped).cast("double")).alias("d"))
    w = Window.partitionBy()  # one row a group
    rate = F.sum("d").over(w) / F.sum("n").over(w)
    g = g.withColumns({"r": F.col("d") / F.col("n"), "p": rate})
    chi = F.sum((F.col("d") - F.col("n") * F.col("p")) ** 2 / (F.col("n") * F.col("p") * (1 - F.col("p"))))
    return g.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("units"), F.first("p").alias("rate"), F.min("r").alias("min_rate"), F.max("r").alias("max_rate"), F.stddev_pop("r").alias("sd_rate"), F.when((F.count(F.lit(1)) > 1) & (F.first("p") > 0) & (F.first("p") < 1), chi / (F.count(F.lit(1)) - 1)).alias("overdispersion"), F.sum((F.col("d") == F.col("n")).cast("long")).alias("eliminated"))
