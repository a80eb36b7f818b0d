"""Whether technical origin explains more of the samples' expression than biology does."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import gram, similarity
from tessera.operators.tables import dealt, materialise, maybe_broadcast

SCHEMA = "variable string, kind string, n_groups int, silhouette double, note string"
STATUS = "n_samples long, n_components int, max_technical double, max_biological double, status string, reason string"


def sample_components(counts: DataFrame, units: DataFrame, most: int) -> tuple[list, np.ndarray]:
    """(samples in order, coordinates): principal components of the logged mean expression of samples (counts: sample_id,
    unit_id, gene, count; units: sample_id, unit_id, those without counts too).  Genes far outnumber samples, so each gene
    is a row with a place for each sample, and the products of samples, samples x samples, are added up over genes; the
    components are their eigenvectors after centring.  Rows are dealt by gene once.  Samples are counted on the driver, genes and units never."""
    sizes = maybe_broadcast(materialise(units.groupBy("sample_id").agg(F.countDistinct("unit_id").alias("n_units")), "samples"))
    names = sorted(r[0] for r in sizes.select("sample_id").collect())
    of = F.array(*[F.lit(x) for x in names])
    means = dealt(counts, counts.count(), "gene").groupBy("gene", "sample_id").agg(F.sum("count").alias("c")).join(sizes, "sample_id").select("gene", "sample_id", F.log1p(F.col("c") / F.col("n_units")).alias("m"))
    wide = means.groupBy("gene").agg(F.map_from_entries(F.collect_list(F.struct("sample_id", "m"))).alias("held"))  # at most one entry a sample
    vec = wide.select(F.transform(of, lambda s: F.coalesce(F.try_element_at("held", s), F.lit(0.0))).alias("vec"))
    genes, _, products, _ = gram.moments(vec, ["vec"])
    s = len(names)
    centre = np.eye(s) - 1 / max(s, 1)
    values, vectors = np.linalg.eigh(centre @ products @ centre) if genes else (np.zeros(s), np.eye(s))
    k = min(most, s - 1, genes)
    top = np.argsort(values)[::-1][:k]
    return names, vectors[:, top] * np.sqrt(np.maximum(values[top], 0))


def silhouette(x: np.ndarray, labels: list) -> float:
    """The mean of (b - a) / max(a, b) on Euclidean distances; an element alone in its group has 0."""
    names, code = np.unique(np.array(labels, dtype=str), return_inverse=True)
    apart = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * x @ x.T, 0))
    np.fill_diagonal(apart, 0)
    member = np.eye(len(names))[code]
    total, n = apart @ member, member.sum(axis=0)
    rows = np.arange(len(x))
    a = total[rows, code] / np.maximum(n[code] - 1, 1)
    mean = total / n
    mean[rows, code] = np.inf
    b, alone = mean.min(axis=1), n[code] == 1
    top = np.maximum(a, b)
    return float(np.where(alone | (top == 0), 0, (b - a) / np.where(top == 0, 1, top)).mean())


def batch_structure(counts: DataFrame, units: DataFrame, variables: DataFrame, most_components: int = 10, most_silhouette: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(variables with their silhouettes as SCHEMA, one row of STATUS).  variables: sample_id, variable, kind (technical,
    biological), value.  A variable with fewer than two groups or three labelled samples has no silhouette and says so.
    Pass: the largest technical silhouette is at most `most_silhouette`, or at most the largest biological one; without an
    assessable technical variable, fail; below three samples, not_run, which is no absence of an effect."""
    spark = counts.sparkSession
    names, x = sample_components(counts, units, most_components)
    if len(names) < 3:
        return spark.createDataFrame([], SCHEMA), spark.createDataFrame([(len(names), 0, None, None, "not_run", "fewer than 3 samples")], STATUS)
    place, held = {n: i for i, n in enumerate(names)}, {}
    for r in variables.where("value IS NOT NULL").collect():  # samples times variables
        if r["sample_id"] in place:
            held.setdefault((r["variable"], r["kind"]), {})[place[r["sample_id"]]] = str(r["value"])
    for r in variables.select("variable", "kind").distinct().collect():
        held.setdefault((r["variable"], r["kind"]), {})
    found = []
    for (variable, kind), own in sorted(held.items()):
        at = sorted(own)
        labels = [own[i] for i in at]
        if len(set(labels)) < 2 or len(at) < 3:
            found.append((variable, kind, len(set(labels)), None, "too few groups or samples"))
        else:
            found.append((variable, kind, len(set(labels)), round(silhouette(x[at], labels), 4), ""))
    top = {k: max((s for _, kind, _, s, _ in found if kind == k and s is not None), default=None) for k in ("technical", "biological")}
    tech, bio = top["technical"], top["biological"]
    ok = tech is not None and (tech <= most_silhouette or bio is not None and tech <= bio)
    reason = "no technical variable was assessable" if tech is None else ""
    return spark.createDataFrame(found, SCHEMA), spark.createDataFrame([(len(names), x.shape[1], tech, bio, "pass" if ok else "fail", reason)], STATUS)


def effect_ratio(units: DataFrame, subject: str, vec: str = "v") -> DataFrame:
    """(subjects, inter, intra, ratio): mean cosine distance between subjects' centres over the mean distance of a subject's
    units to its centre.  Both come from sums by subject, so no pair is formed."""
    rows = units.where(F.col(subject).isNotNull()).select(F.col(subject).alias("g"), F.col(vec).cast("array<double>").alias("v"))
    centres = V.collected(V.by_dimension(rows, ["g"], "v"), ["g"], "c")
    sums = V.collected(V.by_dimension(rows.select("g", V.l2_normalise(F.col("v")).alias("u")), ["g"], "u", "sum"), ["g"], "s")
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    both = centres.join(sums, "g").join(sizes, "g")
    intra = both.agg(F.count(F.lit(1)).alias("subjects"), F.avg(1 - V.dot(F.col("s"), F.col("c")) / (F.col("n") * F.greatest(V.norm(F.col("c")), F.lit(1e-12)))).alias("intra"))
    inter = similarity.pair_sums(centres.withColumnRenamed("c", "v"), []).select((1 - F.col("total") / F.when(F.col("pairs") > 0, F.col("pairs"))).alias("inter"))
    return intra.crossJoin(inter).select("subjects", "inter", "intra", (F.col("inter") / F.col("intra")).alias("ratio"))  # one row each


def cosine_silhouettes(units: DataFrame, label: str, keys: list[str], vec: str = "v", least: int = 10) -> DataFrame:
    """(keys, n, classes, silhouette) of a label by cosine distance, within each of `keys` or over all units: a unit's mean
    distance to a class follows from the class's sum of unit vectors, so the cost is units times classes.  Keys with fewer
    than `least` units or two classes are left out; a unit alone in its class has 0."""
    rows = units.where(F.col(label).isNotNull()).select(*keys, F.col(label).alias("__own"), V.l2_normalise(F.col(vec)).alias("__u"))
    by = [*keys, "__own"]
    sums = V.collected(V.by_dimension(rows, by, "__u", "sum"), by, "__s").join(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__m")), by)
    held = sums.groupBy(*keys).agg(F.collect_list(F.struct("__own", "__s", "__m")).alias("__t"), F.count(F.lit(1)).alias("classes"), F.sum("__m").alias("n")).where((F.col("classes") > 1) & (F.col("n") >= least))  # a place for each class
    both = rows.join(held, keys) if keys else rows.crossJoin(held)  # held is one row without keys
    own, u = F.col("__own"), F.col("__u")
    mine = F.filter("__t", lambda t: t["__own"] == own)[0]
    a = F.when(mine["__m"] > 1, 1 - (V.dot(u, mine["__s"]) - V.dot(u, u)) / (mine["__m"] - 1))
    b = F.array_min(F.transform(F.filter("__t", lambda t: t["__own"] != own), lambda t: 1 - V.dot(u, t["__s"]) / t["__m"]))
    top = F.greatest(a, b)
    return both.select(*keys, "n", "classes", F.when(a.isNull() | (top == 0), 0.0).otherwise((b - a) / top).alias("__x")).groupBy(*keys, "n", "classes").agg(F.avg("__x").alias("silhouette"))
