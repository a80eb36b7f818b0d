"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by its content, the SHA-256 of its text.  The ledger is a table of scans: a blob,
the versions of the rules that were applied to it, and what they found.  A scan takes each distinct blob once, and of the
rules only those whose version the ledger does not hold for it; what it returns is appended to the ledger.  A report joins
the ledger's findings, of whichever scan, back to all paths and versions with that content.  All of it is DataFrame
operations.

Defined results: null counts as the empty text, which is a blob like others; repeated rows each get their findings; a
blob without findings has none and is in the ledger all the same; findings of rule versions that aren't asked for are not
reported; a ledger with a scan twice reports it once; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import columns_for, materialise, maybe_broadcast
from tessera.llm.spans import SPAN, count_of, joined, spans


@dataclass(frozen=True)
class Rule:
    """A pattern; matches whose group is shorter than `least` are dropped.  hint: a string that every match holds."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    hint: str | None = None

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


RULES = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", hint="AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", hint="_"),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
)
#: A finding's kind is the place of its rule in `rules`.
LEDGER = f"blob string, rules array<string>, found {SPAN}"


def blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _found(text: Column, rule: Rule, kind: int) -> Column:
    keep = None
    if rule.least:
        keep = lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least
    return spans(text, rule.pattern, kind, keep, None if rule.hint is None else F.contains(text, F.lit(rule.hint)))


def scan(versions: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """The scans that `ledger` lacks for versions with a column text, as rows of LEDGER to append to it."""
    keys = [r.key for r in rules]
    every = F.array(*[F.lit(k) for k in keys])
    texts = columns_for(versions, "text").select(blob(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    blobs = texts.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        pending = blobs.withColumn("due", every)
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
        pending = blobs.join(seen, "blob", "left").withColumn("due", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("due") > 0)
    each = [_found(F.col("text"), r, i) if ledger is None else F.when(F.array_contains("due", r.key), _found(F.col("text"), r, i)).otherwise(F.array().cast(SPAN)) for i, r in enumerate(rules)]
    made = pending.select("blob", "due", F.array_sort(F.concat(*each)).alias("found"))
    place = lambda s: F.struct(s["start"], (F.array_position("due", F.array(*[F.lit(k) for k in keys])[s["kind"]]) - 1).cast("int").alias("kind"), s["end"], s["match"])
    return materialise(made.select("blob", F.col("due").alias("rules"), F.transform("found", place).cast(SPAN).alias("found")), "blob-scans")


def report(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = 3) -> DataFrame:
    """The findings of each version: (doc_id, n_<kind> of the first `base` rules, base_sha256, spans)."""
    keys = F.array(*[F.lit(r.key) for r in rules])
    some = ledger.where(F.size("found") > 0).select("blob", F.explode(F.transform("found", lambda s: F.struct(s["start"].alias("start"), (F.array_position(keys, F.col("rules")[s["kind"]]) - 1).cast("int").alias("kind"), s["end"].alias("end"), s["match"].alias("match")))).alias("s"))
    findings = some.where("s.kind >= 0").groupBy("blob").agg(F.array_sort(F.collect_set("s")).cast(SPAN).alias("found"))
    rows = columns_for(versions, "doc_id", "text").select("doc_id", blob(F.col("text")).alias("blob")).join(maybe_broadcast(materialise(findings, "findings")), "blob", "left")
    found = F.coalesce("found", F.array().cast(SPAN))
    names = [r.kind for r in rules]
    first = F.filter(found, lambda s: s["kind"] < base)
    return rows.select("doc_id", *[count_of(found, i).alias(f"n_{r.kind}") for i, r in enumerate(rules[:base])], F.sha2(joined(first, names), 256).alias("base_sha256"), joined(found, names).alias("spans"))
