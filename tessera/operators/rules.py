"""Rules over evidence: candidates against floors, ties, guards and contraindications, to a decision or a refusal.

candidates: task_id, axis, higher_is_better, method_id, value, ci_lo, ci_hi.  bars: task_id, axis, floor.  Evidence is small
(methods times tasks), but nothing here collects it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXIS = ["task_id", "axis"]


def beats(value: Column, floor: Column, higher: Column) -> Column:
    """Strictly better than the floor; without one, always."""
    return floor.isNull() | F.when(higher, value > floor).otherwise(value < floor)


def overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    return (lo1 <= hi2) & (lo2 <= hi1)


def ties_with(v1: Column, lo1: Column, hi1: Column, v2: Column, lo2: Column, hi2: Column, equal_ties: bool) -> Column:
    """equal_ties: equal values tie in any case, else intervals must overlap (the rule for proposals); otherwise intervals
    decide where both are there, and equality only where one is missing (the rule for routing)."""
    have = lo1.isNotNull() & hi1.isNotNull() & lo2.isNotNull() & hi2.isNotNull()
    crossing = F.when(have, overlap(lo1, hi1, lo2, hi2))
    return F.coalesce((v1 == v2) | F.coalesce(crossing, F.lit(False)), F.lit(False)) if equal_ties else F.coalesce(crossing, v1 == v2)


def leaders(candidates: DataFrame, bars: DataFrame, equal_ties: bool) -> DataFrame:
    """candidates with passes (the floor), pos among those that pass, and leads: first or tied with it."""
    c = candidates.join(bars.select(*AXIS, "floor"), AXIS, "left").withColumn("passes", beats(F.col("value"), F.col("floor"), F.col("higher_is_better")))
    w = Window.partitionBy(*AXIS, "passes").orderBy(F.when(F.col("higher_is_better"), -F.col("value")).otherwise(F.col("value")), "method_id")
    c = c.withColumn("pos", F.when(F.col("passes"), F.row_number().over(w)))
    first = lambda x: F.first(x).over(w)
    tied = ties_with(F.col("value"), F.col("ci_lo"), F.col("ci_hi"), first("value"), first("ci_lo"), first("ci_hi"), equal_ties)
    return c.withColumn("leads", F.coalesce(F.col("passes") & ((F.col("pos") == 1) | tied), F.lit(False)))


def propose(candidates: DataFrame, bars: DataFrame) -> DataFrame:
    """(task_id, axis, outcome, winner, margin): recommend the one leader, tie of several, refuse where none passes.
    margin: the lead over the next that passes."""
    ranked = leaders(candidates, bars, True)
    at = lambda k: F.max(F.when(F.col("pos") == k, F.col("value")))
    out = ranked.groupBy(*AXIS).agg(F.count_if("passes").alias("eligible"), F.count_if("leads").alias("leading"), F.max(F.when(F.col("pos") == 1, F.col("method_id"))).alias("first"), F.round(F.abs(at(1) - at(2)), 4).alias("margin"))
    outcome = F.when(F.col("eligible") == 0, "refuse").when(F.col("leading") > 1, "tie").otherwise("recommend")
    return out.select(*AXIS, outcome.alias("outcome"), F.when(outcome == "recommend", F.col("first")).alias("winner"), "margin")


def resolve(requests: DataFrame, families: DataFrame, candidates: DataFrame, bars: DataFrame, contraindicated: DataFrame) -> DataFrame:
    """(request_id, task_id, outcome, reason, method_id, shortfall) of requests (request_id, task_id, proposed, override), by
    the ordered rules: a task that is no family, or has no evidence, escalates; a proposed method that is contraindicated
    for the task is refused, or taken as an override; an axis that no method clears refuses the task; axes whose leaders
    have none in common escalate; several in common tie; one is recommended.  Contraindicated methods are out before
    methods are ranked, so they lead nothing.  shortfall: the leader of the first axis doesn't beat its reference, which is
    only reported.  bars: task_id, axis, floor, reference."""
    banned = contraindicated.where("applies").select("task_id", "method_id").distinct()
    axes = candidates.groupBy("task_id").agg(F.countDistinct("axis").alias("axes"), F.min("axis").alias("lead_axis"))
    ranked = leaders(candidates.join(banned, ["task_id", "method_id"], "left_anti"), bars, False).where("leads")
    led = ranked.groupBy("task_id").agg(F.countDistinct("axis").alias("led"))
    every = ranked.groupBy("task_id", "method_id").agg(F.countDistinct("axis").alias("on")).join(axes, "task_id").where("on = axes")
    common = every.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.min("method_id").alias("method"))
    best = ranked.where("pos = 1").join(axes, "task_id").where("axis = lead_axis").join(bars.select(*AXIS, "reference"), AXIS, "left")
    short = best.select("task_id", (~beats(F.col("value"), F.col("reference"), F.col("higher_is_better"))).alias("short"))
    known = families.select("task_id").distinct().withColumn("known", F.lit(True))
    bad = banned.select("task_id", F.col("method_id").alias("proposed"), F.lit(True).alias("bad"))
    t = requests.join(known, "task_id", "left").join(axes, "task_id", "left").join(led, "task_id", "left").join(common, "task_id", "left").join(short, "task_id", "left").join(bad, ["task_id", "proposed"], "left")
    reason = (
        F.when(F.col("known").isNull(), "unknown_family").when(F.col("axes").isNull(), "no_evidence").when(F.col("bad") & F.col("override"), "against_the_evidence").when(F.col("bad"), "contraindicated")
        .when(F.coalesce("led", F.lit(0)) < F.col("axes"), "axis_without_leader").when(F.col("n").isNull(), "axes_disagree").when(F.col("n") > 1, "several_lead").otherwise("leads_every_axis")
    )
    outcome = (
        F.when(reason.isin("unknown_family", "no_evidence", "axes_disagree"), "escalate").when(reason == "against_the_evidence", "override").when(reason.isin("contraindicated", "axis_without_leader"), "refuse")
        .when(reason == "several_lead", "tie").otherwise("recommend")
    )
    method = F.when(outcome == "recommend", F.col("method")).when(outcome == "override", F.col("proposed"))
    return t.select("request_id", "task_id", outcome.alias("outcome"), reason.alias("reason"), method.alias("method_id"), (outcome.isin("recommend", "tie") & F.coalesce("short", F.lit(False))).alias("shortfall"))


def matrix(candidates: DataFrame, bars: DataFrame, contraindicated: DataFrame) -> DataFrame:
    """(method_id, task_id, cell): contraindicated before below_floor before admissible; what does not apply wins."""
    c = candidates.join(bars.select(*AXIS, "floor"), AXIS, "left")
    below = c.groupBy("method_id", "task_id").agg(F.max((~beats(F.col("value"), F.col("floor"), F.col("higher_is_better"))).cast("int")).alias("below"))
    marks = contraindicated.groupBy("method_id", "task_id").agg(F.max(F.col("applies").cast("int")).alias("on"), F.max((~F.col("applies")).cast("int")).alias("off"))
    cell = F.when(F.col("off") == 1, "does_not_apply").when(F.col("on") == 1, "contraindicated").when(F.col("below") == 1, "below_floor").otherwise("admissible")
    return below.join(marks, ["method_id", "task_id"], "left").select("method_id", "task_id", cell.alias("cell"))


def guards(evidence: DataFrame, nmi_most: float = 0.5, drop_most: float = 0.5, ratio_least: float = 1.0, cosine_most: float = 0.5, alpha: float = 0.05, nulls_least: int = 20) -> DataFrame:
    """(method_id, guard, status) of the six guards.  evidence: method_id, nmi, within, across, biology_z,
    confounder_z, ratio_floor, off_cosine, p, n_nulls, circular.  A guard whose evidence is missing has not run; a score of
    0 within subjects can't drop, and a confounder of 0 makes the ratio infinite."""
    c = F.col
    ratio = F.when(c("confounder_z") == 0, F.when(c("biology_z").isNotNull(), F.lit(float("inf")))).otherwise(c("biology_z") / c("confounder_z"))
    tests = {
        "G1": c("nmi") <= nmi_most,
        "G2": F.when(c("within") == 0, F.when(c("across").isNotNull(), True)).otherwise((c("within") - c("across")) / F.abs(c("within")) <= drop_most),
        "G3": (ratio >= ratio_least) & (c("ratio_floor").isNull() | (ratio >= c("ratio_floor"))),
        "G4": c("off_cosine") <= cosine_most,
        "G5": F.when(c("n_nulls") >= nulls_least, c("p") < alpha),
        "G6": ~c("circular"),
    }
    each = F.array(*[F.struct(F.lit(g).alias("guard"), F.when(t, "pass").when(~t, "fail").otherwise("not_run").alias("status")) for g, t in tests.items()])
    return evidence.select("method_id", F.explode(each).alias("g")).select("method_id", "g.*")


def verdicts(statuses: DataFrame, evaluable: DataFrame) -> DataFrame:
    """(method_id, verdict): not_run without a statistic (evaluable: method_id, ran); diagnostic if a guard failed;
    biological if one ran and none failed; unguarded, which is no pass, if none ran."""
    s = statuses.groupBy("method_id").agg(F.count_if(F.col("status") == "fail").alias("fail"), F.count_if(F.col("status") != "not_run").alias("ran_guards"))
    verdict = F.when(~F.coalesce("ran", F.lit(False)), "not_run").when(F.col("fail") > 0, "diagnostic").when(F.col("ran_guards") > 0, "biological").otherwise("unguarded")
    return evaluable.join(s, "method_id", "left").select("method_id", verdict.alias("verdict"))


def rule_status(rule: Column, value: Column, unresolved: tuple[str, ...] = ("",), acceptable: tuple[str, ...] = ("in_class",), uncertain: tuple[str, ...] = ("uncertain",)) -> Column:
    """What a check's rule says of its value, a string: a struct of status (pass, fail, not_run) and noted, whether there
    is something to say beside a pass."""
    number = value.try_cast("double")
    fits = F.map_values(F.from_json(value, "map<string,string>"))
    bad = F.exists(fits, lambda f: ~F.coalesce(f.isin(*acceptable, *uncertain), F.lit(False)))
    doubt = F.exists(fits, lambda f: F.coalesce(f.isin(*uncertain), F.lit(False)))
    made = lambda status, noted: F.struct(F.lit(status).alias("status"), F.lit(noted).alias("noted"))
    plain = lambda ok: F.when(value.isNull(), made("not_run", True)).when(ok, made("pass", False)).otherwise(made("fail", True))
    return (
        F.when(rule == "is_true", plain(value == "true")).when(rule == "is_false", plain(value == "false")).when(rule == "present_and_positive", plain(F.coalesce(number > 0, F.lit(False))))
        .when(rule == "resolved_string", F.when(value.isNull() | value.isin(*unresolved), made("fail", True)).otherwise(made("pass", False)))
        .when(rule == "all_encoders_assessed", F.when(F.coalesce(F.size(fits), F.lit(0)) <= 0, made("not_run", True)).when(bad, made("fail", True)).when(doubt, made("pass", True)).otherwise(made("pass", False)))
        .otherwise(made("not_run", True))
    )


def admissibility(checks: DataFrame, risks: DataFrame | None = None, **lists: tuple[str, ...]) -> DataFrame:
    """(cohort, violations, cautions, escalations, notes, gate) of checks (cohort, check_id, rule, authority, required,
    present, value, calibrated).  A criterion calibrated by cohort that this one has no record for is escalated, not
    evaluated, and is a caution; an optional check with a null value is not applicable, a caution; one that is absent, or
    required and failed or not measured, is a violation if required, else a caution; whatever else has something to say is
    a caution.  Advisory checks leave notes and never move the gate.  risks (cohort): recorded ones are a caution."""
    c = checks.withColumn("ruled", rule_status(F.col("rule"), F.col("value"), **lists))
    open_ = (F.col("authority") == "cohort_calibrated") & ~F.col("calibrated")
    gates = F.col("authority") != "advisory"
    void = ~F.col("required") & F.col("value").isNull()
    kind = (
        F.when(open_, "escalate").when(void, F.when(gates, "caution").otherwise("note")).when(~F.col("present"), F.when(~gates, "note").when(F.col("required"), "violation").otherwise("caution"))
        .when(~gates, F.when(F.col("ruled.noted") | (F.col("ruled.status") != "pass"), "note")).when(F.col("required") & F.col("ruled.status").isin("fail", "not_run"), "violation").when(F.col("ruled.noted"), "caution")
    )
    n = lambda *k: F.count_if(F.coalesce(F.col("kind").isin(*k), F.lit(False)))
    s = c.withColumn("kind", kind).groupBy("cohort").agg(n("violation").alias("violations"), n("caution", "escalate").alias("cautions"), n("escalate").alias("escalations"), n("note").alias("notes"))
    if risks is not None:
        s = s.join(risks.select("cohort").distinct().withColumn("risk", F.lit(1)), "cohort", "left").withColumn("cautions", F.col("cautions") + F.coalesce("risk", F.lit(0))).drop("risk")
    gate = F.when(F.col("violations") > 0, "stop").when(F.col("cautions") > 0, "proceed_with_caution").otherwise("proceed")
    return s.select("cohort", "violations", "cautions", "escalations", "notes", gate.alias("gate"))


def pack_diff(curated: DataFrame, rebuilt: DataFrame, tolerance: float = 5e-4) -> DataFrame:
    """(task_id, method_id, change) of two packs (task_id, method_id, value, ci_lo, ci_hi)."""
    a = curated.select("task_id", "method_id", *[F.col(c).alias(f"a_{c}") for c in ("value", "ci_lo", "ci_hi")], F.lit(1).alias("in_a"))
    b = rebuilt.select("task_id", "method_id", *[F.col(c).alias(f"b_{c}") for c in ("value", "ci_lo", "ci_hi")], F.lit(1).alias("in_b"))
    moved = lambda c: F.coalesce(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) > tolerance, F.col(f"a_{c}").isNull() != F.col(f"b_{c}").isNull())
    change = F.when(F.col("in_a").isNull(), "absent_from_curated").when(F.col("in_b").isNull(), "not_reachable_by_rebuild").when(moved("value"), "value_moved").when(moved("ci_lo") | moved("ci_hi"), "interval_moved").otherwise("same")
    return a.join(b, ["task_id", "method_id"], "full_outer").select("task_id", "method_id", change.alias("change"))


def grid_coverage(declared: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """(declared, scored, missing, undeclared)."""
    d, s = declared.select(*keys).distinct().withColumn("d", F.lit(1)), scored.select(*keys).distinct().withColumn("s", F.lit(1))
    return d.join(s, keys, "full_outer").agg(F.count("d").alias("declared"), F.count("s").alias("scored"), F.count_if(F.col("s").isNull()).alias("missing"), F.count_if(F.col("d").isNull()).alias("undeclared"))


def zero_filled(df: DataFrame, column: str, vocabulary: list[str]) -> DataFrame:
    """(column, n) for every word of a closed vocabulary; words outside it are counted under their own name."""
    words = df.sparkSession.createDataFrame([(w,) for w in vocabulary], f"{column} string")
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(words, column, "full_outer").select(column, F.coalesce("n", F.lit(0)).alias("n"))
