"""What units carry and how labels, keys and slices of them are made and compared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V

UNIT = ["sample_id", "unit_id"]


def carry(units: DataFrame, assay: DataFrame, columns: list[str]) -> DataFrame:
    """units with an assay's columns as they are, never pooled, and `{column}__present`."""
    rows = assay.select(*UNIT, *columns, F.lit(True).alias("__row")).dropDuplicates(UNIT)
    out = units.join(rows, UNIT, "left")
    return out.withColumns({f"{c}__present": F.col("__row").isNotNull() & F.col(c).isNotNull() for c in columns}).drop("__row")


def mapped(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Columns under the names of their roles (role: column); what is missing is named, all at once."""
    if missing := sorted(f"{r} ({c})" for r, c in roles.items() if c not in df.columns):
        raise ValueError(f"no column for: {', '.join(missing)}")
    return df.select(*[F.col(c).alias(r) for r, c in roles.items()])


def stacked(tables: list[DataFrame]) -> DataFrame:
    """Tables one under the other; columns must agree by name."""
    return reduce(DataFrame.unionByName, tables)


def truthy(value: Column, yes: tuple[str, ...] = ("yes", "y", "true", "1")) -> Column:
    """A closed list of what counts as yes; null stays null."""
    return F.lower(F.trim(value)).isin(*yes)


def dominant(fractions: dict[str, Column], least: float, mixed: str = "mixed") -> Column:
    """The class of the largest fraction, ties to the first name; `mixed` below `least`; null if all are missing."""
    each = [F.when(c.isNotNull() & ~F.isnan(c), F.struct(c.alias("x"), F.lit(-i).alias("i"), F.lit(n).alias("n"))) for i, (n, c) in enumerate(sorted(fractions.items()))]
    top = F.array_max(F.filter(F.array(*each), lambda s: s.isNotNull()))
    return F.when(top.isNull(), None).when(top["x"] < least, F.lit(mixed)).otherwise(top["n"])


def key_suffix(key: Column, mark: str = "__cluster_") -> Column:
    """What follows the last `mark`; null without one."""
    return F.when(F.contains(key, F.lit(mark)), F.substring_index(key, mark, -1))


def named_files(text: Column) -> Column:
    """Paths of artifacts that prose names: words with a slash or not that end in a known suffix."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_./{}-]+\.(?:json|parquet|tsv|csv))"), F.lit(1)))


def expanded(templates: DataFrame, column: str, values: DataFrame, name: str) -> DataFrame:
    """Templates with `{name}` replaced by each of the values; those without it once, as they are."""
    hole = F.lit("{" + name + "}")
    some = templates.where(F.contains(F.col(column), hole)).join(values.select(name).distinct())  # a grid: every template with every value
    plain = templates.where(~F.contains(F.col(column), hole)).withColumn(name, F.lit(None).cast(values.schema[name].dataType))
    return some.withColumn(column, F.replace(F.col(column), hole, F.col(name).cast("string"))).unionByName(plain)


def slice_difference(computed: DataFrame, cached: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """One row on an encoding against the cached one of the same rows: rows in both and in one only, the largest and the
    mean absolute difference of elements, the largest one over its cached row's norm, and the least and mean cosine."""
    side = lambda df, x: df.select(*keys, F.col(vec).alias(f"__{x}"))
    both = side(computed, "a").join(side(cached, "b"), keys, "full_outer")
    dot = lambda x, y: F.aggregate(F.zip_with(F.col(x), F.col(y), lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    there = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    apart = F.zip_with("__a", "__b", lambda p, q: F.abs(p - q))
    row = F.greatest(F.sqrt(dot("__b", "__b")), F.lit(1e-12))
    each = both.select(
        F.col("__a").isNull().alias("no_a"), F.col("__b").isNull().alias("no_b"), F.when(there, F.array_max(apart)).alias("most"), F.when(there, F.aggregate(apart, F.lit(0.0), lambda s, x: s + x)).alias("total"),
        F.when(there, F.size("__a")).alias("width"), F.when(there, row).alias("row"), F.when(there, dot("__a", "__b") / F.greatest(F.sqrt(dot("__a", "__a")) * row, F.lit(1e-12))).alias("cosine"),
    )
    return each.agg(
        F.count("most").alias("rows"), F.count_if("no_b").alias("only_computed"), F.count_if("no_a").alias("only_cached"), F.max("most").alias("max_abs"), (F.sum("total") / F.sum("width")).alias("mean_abs"),
        F.max(F.col("most") / F.col("row")).alias("max_rel"), F.min("cosine").alias("min_cosine"), F.avg("cosine").alias("mean_cosine"),
    )


def neighbour_agreement(computed: DataFrame, cached: DataFrame, cached_vectors: DataFrame, tolerance: float = 1e-6, vec: str = "v") -> DataFrame:
    """(unit_id, same, tied, ordered): whether the two lists of neighbours (unit_id, pos, neighbour) of a unit are one set,
    whether they differ by ties only, and whether they agree in order.  A tie is judged in the cached space: every
    neighbour that one list alone has must be as similar there as the cached list's last one, within `tolerance`."""
    a, b = (df.select("unit_id", "neighbour", F.col("pos").alias(x)) for df, x in ((computed, "pa"), (cached, "pb")))
    both = a.join(b, ["unit_id", "neighbour"], "full_outer")
    last = F.max("pb").over(Window.partitionBy("unit_id")) == F.col("pb")
    due = both.withColumn("last", F.coalesce(last, F.lit(False)))
    # similarities of what the lists don't share, and of the boundary
    asked = due.where("pa IS NULL OR pb IS NULL OR last").select("unit_id", "neighbour")
    held = cached_vectors.select("unit_id", V.l2_normalise(F.col(vec)).alias("u"))
    near = asked.join(held, "unit_id").join(held.select(F.col("unit_id").alias("neighbour"), F.col("u").alias("w")), "neighbour").select("unit_id", "neighbour", V.dot(F.col("u"), F.col("w")).alias("s"))
    rows = due.join(near, ["unit_id", "neighbour"], "left")
    edge = F.max(F.when(F.col("last"), F.col("s"))).over(Window.partitionBy("unit_id"))
    one_only = F.col("pa").isNull() | F.col("pb").isNull()
    g = rows.withColumn("edge", edge).groupBy("unit_id").agg(
        F.every(~one_only).alias("same"), F.every(~one_only | F.coalesce(F.abs(F.col("s") - F.col("edge")) <= tolerance, F.lit(False))).alias("close"), F.every(F.coalesce(F.col("pa") == F.col("pb"), F.lit(False))).alias("ordered")
    )
    return g.select("unit_id", "same", (~F.col("same") & F.col("close")).alias("tied"), "ordered")


def agreement_shares(agreement: DataFrame) -> DataFrame:
    """(rows, set_agreement, set_exact, by_tie, ordered) over all units: ties count as agreed, and are told apart."""
    share = lambda c: F.avg(c.cast("double"))
    return agreement.agg(F.count(F.lit(1)).alias("rows"), share(F.col("same") | F.col("tied")).alias("set_agreement"), share(F.col("same")).alias("set_exact"), F.count_if("tied").alias("by_tie"), share(F.col("ordered")).alias("ordered"))


def accepted(difference: DataFrame, shares: DataFrame, most_drift: float = 1e-5, least_cosine: float = 1 - 1e-6, least_agreement: float = 0.999) -> DataFrame:
    """(accepted, failed) of an encoding: bounded drift over the row norm, cosines, and neighbours kept, each on its own."""
    row = difference.select("max_rel", "min_cosine").crossJoin(shares.select("set_agreement"))  # one row each
    tests = {"drift": F.col("max_rel") <= most_drift, "cosine": F.col("min_cosine") >= least_cosine, "neighbours": F.col("set_agreement") >= least_agreement}
    failed = F.concat_ws(",", *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in tests.items()])
    return row.select((failed == "").alias("accepted"), failed.alias("failed"))


def split_subjects(units: DataFrame, stratum: str, share: float, seed: int) -> DataFrame:
    """(subject_id, stratum, part): whole subjects to `test` or `train`, in hash order, ceil(share * n) of each stratum's to
    test where every stratum has two subjects or more, else of all together."""
    s = units.groupBy("subject_id").agg(F.min(stratum).alias("stratum"))
    sizes = s.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("stratum")))
    flat = sizes.agg(F.min("n").alias("least"))
    order = F.md5(F.concat_ws(":", F.lit(seed), "subject_id"))
    by = lambda *k: F.row_number().over(Window.partitionBy(*k).orderBy(order, "subject_id"))
    total = F.count(F.lit(1)).over(Window.partitionBy())  # one row a subject
    made = sizes.crossJoin(flat).withColumns({"place": F.when(F.col("least") >= 2, by("stratum")).otherwise(by()), "of": F.when(F.col("least") >= 2, F.col("n")).otherwise(total)})  # flat is one row
    return made.select("subject_id", "stratum", F.when(F.col("place") <= F.ceil(F.col("of") * share), "test").otherwise("train").alias("part"))


def profile_by_class(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, mean, std, pos): largest mean in absolute value first."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return g.withColumn("pos", F.row_number().over(Window.orderBy(F.abs(F.col("mean")).desc(), group)))  # one row a group


def attention_profile(df: DataFrame, group: str, weights: str) -> DataFrame:
    """(group, pos, n, mean, std) of each token position's weight."""
    return df.select(group, F.posexplode(weights).alias("pos", "w")).groupBy(group, "pos").agg(F.count("w").alias("n"), F.avg("w").alias("mean"), F.stddev_samp("w").alias("std"))


def per_section(checks: DataFrame, rule: str, fraction: float = 1.0) -> DataFrame:
    """(check_id, sections, measured, passed, status): one status for a cohort from its sections' (check_id, passed; null is
    not measured).  rule all: every measured section passes; fraction: at least that share of them.  Where no section
    could be measured nothing is said of the cohort: not_applicable."""
    g = checks.groupBy("check_id").agg(F.count(F.lit(1)).alias("sections"), F.count("passed").alias("measured"), F.count_if(F.coalesce("passed", F.lit(False))).alias("passed"))
    ok = F.col("passed") == F.col("measured") if rule == "all" else F.col("passed") >= F.col("measured") * fraction
    return g.withColumn("status", F.when(F.col("measured") == 0, "not_applicable").when(ok, "pass").otherwise("fail"))


def trace(records: DataFrame) -> DataFrame:
    """(step, place, n, duration, untimed): steps in the order of their first record; a missing duration is untimed."""
    g = records.groupBy(F.substring_index("step", "::", 1).alias("step")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("duration").alias("duration"), F.count_if(F.col("duration").isNull()).alias("untimed"))
    return g.withColumn("place", F.row_number().over(Window.orderBy("first", "step"))).drop("first")  # one row a step
