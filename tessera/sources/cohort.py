"""A cohort in its canonical form, and its joined niches as features of declared roles.

Canonical: ingest.json (samples, images), {sample}_spots.parquet (spot_id, x, y, more), {sample}_counts.parquet (spot_id,
gene, count; what is 0 isn't stored).  Everything is read for all samples at once; a sample that lacks a part is a row
that says so, not a missing row."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.sources.readers import parquet_per_sample, required

SPOT = ["spot_id", "x", "y"]


def ingest(spark: SparkSession, place: str) -> DataFrame:
    """(sample_id, image): the ingest record's samples; without the record nothing of the cohort is read."""
    if not spark.read.format("binaryFile").option("pathGlobFilter", "ingest.json").load(place).select("path").take(1):
        raise FileNotFoundError(f"no ingest record in {place}: convert the cohort first")
    kind = "samples array<string>, images map<string, string>"
    rec = spark.read.schema(kind).option("multiLine", True).json(f"{place}/ingest.json")
    return rec.select(F.explode("samples").alias("sample_id"), "images").select("sample_id", F.try_element_at("images", F.col("sample_id")).alias("image"))


def _files(spark: SparkSession, place: str, suffix: str) -> DataFrame:
    paths = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(place).select("path")
    return paths.select(F.regexp_extract("path", "([^/]*)" + re.escape(suffix) + "$", 1).alias("sample_id"), "path")


def samples(spark: SparkSession, place: str) -> DataFrame:
    """(sample_id, image, spots, counts): each sample of the record with the paths of what it has."""
    parts = {"spots": _files(spark, place, "_spots.parquet"), "counts": _files(spark, place, "_counts.parquet")}
    out = ingest(spark, place)
    for name, files in parts.items():
        out = out.join(files.withColumnRenamed("path", name), "sample_id", "left")
    return out.select("sample_id", "image", "spots", "counts")


def _part(spark: SparkSession, place: str, name: str, columns: list[str], wanted: list[str] | None) -> DataFrame:
    have = samples(spark, place)
    lack = have.where(F.col(name).isNull())
    lack = lack.where(F.col("sample_id").isin(wanted)) if wanted is not None else lack
    if bad := [r["sample_id"] for r in lack.orderBy("sample_id").limit(5).collect()]:
        raise FileNotFoundError(f"no {name} of {', '.join(bad)}")
    df = parquet_per_sample(spark, f"{place}/{{sample}}_{name}.parquet", columns)
    return df.where(F.col("sample_id").isin(wanted)) if wanted is not None else df


def spots(spark: SparkSession, place: str, wanted: list[str] | None = None, more: list[str] | None = None) -> DataFrame:
    """(sample_id, spot_id, x, y, more) of all samples or some; a sample without its table is named."""
    return _part(spark, place, "spots", [*SPOT, *(more or [])], wanted)


def counts(spark: SparkSession, place: str, wanted: list[str] | None = None) -> DataFrame:
    """(sample_id, spot_id, gene, count) of all samples or some; a sample without its table is named."""
    return _part(spark, place, "counts", ["spot_id", "gene", "count"], wanted)


@dataclass(frozen=True)
class Contract:
    """The columns that play each role in joined niches, and the widths they have; every one is declared."""

    niche: str
    tokens: str
    supervision: str
    subject: str
    sample: str
    width: int
    members: int
    unit: str = "unit_id"
    labels: tuple[str, ...] = ()

    @staticmethod
    def declared(declarations: dict) -> Contract:
        """From a project's declarations; what they lack is named, all at once."""
        needed = ("niche", "tokens", "supervision", "subject", "sample", "width", "members")
        if missing := [k for k in needed if declarations.get(k) is None]:
            raise ValueError(f"not declared: {', '.join(missing)}")
        return Contract(**{k: declarations[k] for k in (*needed, "unit", "labels") if k in declarations})


def loaded(niches: DataFrame, contract: Contract, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """(units (unit, sample, subject, niche, tokens as members of `width`, features side by side, supervision, labels),
    dropped (sample, n, dropped)): rows with a missing element in niche, tokens or features are left out and counted; missing
    supervision is uniform.  Widths are compared with the declared ones over all rows before anything is computed."""
    c = contract
    rows = required(niches, c.niche, c.tokens, c.supervision, c.subject, c.sample, c.unit, *features, *c.labels)
    widths = {c.niche: c.width, c.tokens: c.width * c.members}
    seen = rows.agg(*[f(F.size(x)).alias(f"{k}_{i}") for i, x in enumerate((*widths, c.supervision, *features)) for k, f in (("least", F.min), ("most", F.max))]).first()
    for i, x in enumerate((*widths, c.supervision, *features)):
        least, most = seen[f"least_{i}"], seen[f"most_{i}"]
        if least is not None and (least != most or most != widths.get(x, most)):
            raise ValueError(f"{x}: widths {least} to {most}, declared {widths.get(x, 'one')}")
    classes = seen["most_2"] or 1
    whole = F.concat(*[F.col(x).cast("array<double>") for x in features])
    made = rows.select(
        F.col(c.unit).alias("unit"), F.col(c.sample).alias("sample"), F.col(c.subject).alias("subject"), F.col(c.niche).cast("array<double>").alias("niche"), F.col(c.tokens).cast("array<double>").alias("flat"), whole.alias("features"),
        V.uniform_if_missing(F.col(c.supervision).cast("array<double>"), classes).alias("supervision"), *c.labels,
        F.coalesce(~V.has_missing(F.col(c.niche)) & ~V.has_missing(F.col(c.tokens)) & ~V.has_missing(whole), F.lit(False)).alias("whole"),
    )
    tokens = F.transform(F.sequence(F.lit(0), F.lit(c.members - 1)), lambda i: F.slice("flat", i * c.width + 1, F.lit(c.width)))
    units = made.where("whole").select("unit", "sample", "subject", "niche", tokens.alias("tokens"), "features", "supervision", *c.labels)
    return units, made.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("whole")).alias("dropped"))


def matrices(views: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """One row a unit with each view's vector under the view's name.  Views must have the same units: what one has and
    another lacks is counted and refused."""
    names, out = list(views), None
    for name, df in views.items():
        side = df.select(*keys, F.col("vec").alias(name))
        out = side if out is None else out.join(side, keys, "full_outer")
    lacking = out.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in names]).first()
    if bad := [f"{n} lacks {lacking[n]} units" for n in names if lacking[n]]:
        raise ValueError("; ".join(bad))
    return out
