"""From candidates to proposals that guards can block, who wrote what in a pack, and the gates on hypotheses.

candidates: task_id, axis, higher_is_better, method_id, value, ci_lo, ci_hi.  Blocked methods win nothing and tie with
nothing; a family that nobody can answer is refused with the reason and the best that was measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import rules

#: The fields of a task that are computed, declared, or written by people.
COMPUTED = ("value", "ci", "candidates", "margin", "outcome", "winner", "tied", "refusal", "clears_floor", "guards", "ranking")
DECLARED = ("metric", "source", "floor", "higher_is_better", "unit", "reader")
HUMAN = ("note", "caveat", "interpretation")


def ratio(biology: Column, confounder: Column) -> Column:
    """Biology over the confounder; infinite where the confounder is 0."""
    return F.when(confounder == 0, F.when(biology.isNotNull(), F.lit(float("inf")))).otherwise(biology / confounder)


def task_guards(tasks: DataFrame, inputs: DataFrame) -> DataFrame:
    """(task_id, method_id, guard, value, status, contraindicated) of each task's declared guard (tasks: task_id, guard,
    floor; without one, none) on each method's inputs (task_id, method_id, biology_z, confounder_z).  Only the ratio guard,
    G3, finds its inputs there: below 1 or below the floor it contraindicates.  Any other, or missing inputs, has not run
    and blocks nothing."""
    r = ratio(F.col("biology_z"), F.col("confounder_z"))
    can = (F.col("guard") == "G3") & F.col("biology_z").isNotNull() & F.col("confounder_z").isNotNull()
    ok = (r >= 1) & (F.col("floor").isNull() | (r >= F.col("floor")))
    rows = tasks.where("guard IS NOT NULL").select("task_id", "guard", "floor").join(inputs, "task_id")
    status = F.when(~can, "not_run").when(ok, "pass").otherwise("fail")
    return rows.select("task_id", "method_id", "guard", F.when(can, r).alias("value"), status.alias("status"), (status == "fail").alias("contraindicated"))


def propose(candidates: DataFrame, bars: DataFrame, guards: DataFrame) -> DataFrame:
    """(task_id, axis, outcome, winner, tied, margin, refusal, best, best_value): floor first, then guards (task_id,
    method_id, contraindicated), then rank among what is left, with equal values or crossing intervals as ties."""
    key, names = ["task_id", "method_id"], candidates.columns
    banned = guards.where("contraindicated").select(*key).distinct().withColumn("blocked", F.lit(True))
    c = candidates.join(bars.select(*rules.AXIS, "floor"), rules.AXIS, "left").join(banned, key, "left")
    c = c.withColumns({"blocked": F.coalesce("blocked", F.lit(False)), "clears": rules.beats(F.col("value"), F.col("floor"), F.col("higher_is_better"))})
    order = F.struct(F.when(F.col("higher_is_better"), -F.col("value")).otherwise(F.col("value")), "method_id")
    all_ = c.groupBy(*rules.AXIS).agg(F.count_if("clears").alias("clear"), F.max("floor").alias("floor"), F.min_by("method_id", order).alias("best"), F.min_by("value", order).alias("best_value"))
    left = rules.leaders(c.where("NOT blocked").select(*names), bars, True)
    at = lambda k: F.max(F.when(F.col("pos") == k, F.col("value")))
    lead = F.transform(F.array_sort(F.collect_list(F.when(F.col("leads"), F.struct("pos", "method_id")))), lambda s: s["method_id"])
    made = left.groupBy(*rules.AXIS).agg(F.count_if("passes").alias("eligible"), lead.alias("leading"), F.round(F.abs(at(1) - at(2)), 4).alias("margin"))
    rows = all_.join(made, rules.AXIS, "left").withColumn("eligible", F.coalesce("eligible", F.lit(0)))
    outcome = F.when(F.col("eligible") == 0, "refuse").when(F.size("leading") > 1, "tie").otherwise("recommend")
    why = F.when(F.col("floor").isNotNull() & (F.col("clear") == 0), "no candidate clears the floor").otherwise("every candidate is contraindicated by a guard")
    return rows.select(
        *rules.AXIS, outcome.alias("outcome"), F.when(outcome == "recommend", F.col("leading")[0]).alias("winner"), F.when(outcome == "tie", F.col("leading")).alias("tied"), F.when(outcome != "refuse", F.col("margin")).alias("margin"),
        F.when(outcome == "refuse", why).alias("refusal"), "best", "best_value",
    )


def provenance(fields: DataFrame) -> DataFrame:
    """(task_id, computed, declared, human, human_present) of a pack's fields (task_id, field), each list in order; a field
    of no kind is in none."""
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("field").isin(*kind), F.col("field"))))
    g = fields.groupBy("task_id").agg(of(COMPUTED).alias("computed"), of(DECLARED).alias("declared"), of(HUMAN).alias("human"))
    return g.withColumn("human_present", F.size("human") > 0)


def authored(candidates: DataFrame) -> DataFrame:
    """(task_id, method_id, reason) of measurements that a person typed: candidates (task_id, method_id, value, ci as JSON
    text) whose value is no number or whose interval isn't two numbers.  A pack with any is refused."""
    number = F.col("value").rlike(r"^\s*-?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
    ends = F.from_json("ci", "array<double>")
    pair = F.col("ci").isNull() | F.coalesce((F.size(ends) == 2) & F.forall(ends, lambda x: x.isNotNull()), F.lit(False))
    reason = F.when(~F.coalesce(number, F.lit(False)), "value is not a number").when(~pair, "ci is not an interval")
    return candidates.select("task_id", "method_id", reason.alias("reason")).where("reason IS NOT NULL")


def label_gate(labels: DataFrame, most: float = 0.5) -> DataFrame:
    """(label, nmi, status, claims_biology, reference_status) of labels that clusters are scored against (label, nmi with
    the confounder): one that encodes the confounder makes every score, the reference's too, diagnostic."""
    ok = F.col("nmi") <= most
    return labels.select("label", "nmi", F.when(ok, "pass").otherwise("fail").alias("status"), ok.alias("claims_biology"), F.when(ok, "biological").otherwise("diagnostic").alias("reference_status"))


def held_out_gate(runs: DataFrame, subjects: int, least: int = 5) -> DataFrame:
    """One row (n_runs, test_subjects, cross_subject, status, strongest): every run must have been tested on the same
    `subjects` held-out subjects, at least `least`.  runs: method_id, n_subjects, probe; the probe says how much of a space
    is the subject, and is reported, never judged."""
    g = runs.agg(F.count(F.lit(1)).alias("n_runs"), F.array_sort(F.collect_set("n_subjects")).alias("test_subjects"), F.count_if(F.col("n_subjects").isNull()).alias("absent"), F.max("probe").alias("strongest"))
    ok = (F.size("test_subjects") == 1) & (F.col("absent") == 0) & (F.get("test_subjects", F.lit(0)) == subjects) & F.lit(subjects >= least)
    ok = F.coalesce(ok, F.lit(False))
    return g.select("n_runs", "test_subjects", ok.alias("cross_subject"), F.when(ok, "pass").otherwise("fail").alias("status"), "strongest")


def ratio_gate(runs: DataFrame, floor: float | None = None) -> DataFrame:
    """(method_id, ratio, ci_lo, ci_hi, value, status, pos) of runs (method_id, ratio, ci_lo, ci_hi, biology_z,
    confounder_z): the ratio guard on the two z's, and the ranking by the recorded ratio."""
    from pyspark.sql import Window

    value = ratio(F.col("biology_z"), F.col("confounder_z"))
    ok = (value >= 1) & (F.lit(True) if floor is None else value >= floor)
    w = Window.orderBy(F.desc("ratio"), "method_id")  # one row a method
    return runs.select("method_id", "ratio", "ci_lo", "ci_hi", value.alias("value"), F.when(ok, "pass").otherwise("fail").alias("status"), F.row_number().over(w).alias("pos"))


def pathway_gate(results: DataFrame, features: DataFrame, view: str, pathway_feature: str, clean_view: str | None = None, alpha: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(runs (method_id, n_testable, n_significant, significant, excluded, circular, n_disagreeing), guards (held_out,
    circular_supervision, n_disagreeing, headline_affected), one row) of results (method_id, view, test, testable, q,
    n_test, view_clean).  A view is circular if the run's features (method_id, feature) hold what the pathways were made of
    and it isn't the clean view; that is derived here, and where the recorded view_clean says otherwise the pair of run and
    view is reported, as a record written before the run was added would be wrong."""
    clean = clean_view or view
    carries = features.where(F.col("feature") == pathway_feature).select("method_id", F.lit(True).alias("carries")).distinct()
    rows = results.join(carries, "method_id", "left").withColumn("derived", F.coalesce("carries", F.lit(False)) & (F.col("view") != clean))
    wrong = rows.where(F.col("view_clean") == F.col("derived")).select("method_id", "view").distinct()
    per_run = wrong.groupBy("method_id").agg(F.count(F.lit(1)).alias("n_disagreeing"))
    head = F.col("view") == view
    good = head & F.col("testable") & F.coalesce(F.col("q") < alpha, F.lit(False)) & ~F.coalesce(F.isnan("q"), F.lit(False))
    names = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("test"))))
    g = rows.groupBy("method_id").agg(F.count_if(head & F.col("testable")).alias("n_testable"), F.count_if(good).alias("n_significant"), names(good).alias("significant"), names(head & ~F.col("testable")).alias("excluded"), F.coalesce(F.max(F.when(head, F.col("derived"))), F.lit(False)).alias("circular"))
    runs = g.join(per_run, "method_id", "left").withColumn("n_disagreeing", F.coalesce("n_disagreeing", F.lit(0)))
    splits = rows.where(head).agg(F.countDistinct("n_test").alias("splits"))
    off = wrong.agg(F.count(F.lit(1)).alias("n_disagreeing"), F.count_if(F.col("view") == view).alias("of_view"))
    guards = splits.crossJoin(off).select(F.when(F.col("splits") == 1, "pass").otherwise("fail").alias("held_out"), F.when(F.col("n_disagreeing") == 0, "pass").otherwise("flag_disagreement").alias("circular_supervision"), "n_disagreeing", (F.col("of_view") > 0).alias("headline_affected"))  # one row each
    return runs, guards
