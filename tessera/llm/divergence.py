"""How far the sources of a language differ in their terms, and by which terms, in whole numbers.

A term is a run of ASCII letters and other characters from U+0080 on, with A-Z lower-cased; a language keeps the terms
that at least `least` of its documents hold.  Counts of a kept term stand in one array with a place for each source of
the language, so a pair of sources needs no join: functions over the array emit each pair's part for that term, and sums
by pair, which start on the map side, add them up.  A source's share of a term is 1 + floor(SCALE (count + 5) /
(N + 5 V)), N its occurrences of kept terms and V the number of these; a pair's divergence is the sum of absolute
differences of shares.  Terms of a source stand out by how much its share exceeds the language's.

A text's terms, and behind them each different one again, are counted together by language, source and term, which gives
occurrences and documents in one pass; a frequent term or source is one row a task from there on.  Rows emitted are
terms x pairs of sources of the language, whatever the size of the corpus.

Defined results: null text, lang and source are ''; a group without terms still takes part with its smoothed shares; a
language without kept terms has divergences of 0; a single source has no pairs; repeated rows count one by one; ties
rank by item.  Shares are exact below 9e15 occurrences in a language.  Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import columns_for, materialise, maybe_broadcast

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SMOOTH, STEP = 5, 1000


def terms(text: Column) -> Column:
    """The terms of a text in order.  Where a term has ASCII only, `lower` does what `translate` does, and faster."""
    found = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    return F.transform(found, lambda t: F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER)))


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 count / total) by long division in three steps, for 0 < count <= total."""
    whole, rest = F.lit(0).cast("long"), count
    for _ in range(3):
        whole, rest = whole * STEP + F.call_function("div", rest * STEP, total), rest * STEP % total
    return whole + 1


def groups(docs: DataFrame) -> DataFrame:
    """(lang, source, text) without nulls."""
    return columns_for(docs, "lang", "source", "text").select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def axes(docs: DataFrame) -> DataFrame:
    """(lang, sources): the sources of each language in order, which number the places of its vectors."""
    return groups(docs).groupBy("lang", "source").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.array_sort(F.collect_list("source")).alias("sources"))


def term_vectors(docs: DataFrame, axis: DataFrame, least: int = 30) -> DataFrame:
    """(lang, term, counts): occurrences of each kept term in each source of its language."""
    own = groups(docs).select("lang", "source", terms(F.col("text")).alias("found"))
    both = own.select("lang", "source", F.size("found").alias("size"), F.posexplode(F.concat("found", F.array_distinct("found"))).alias("at", "term"))
    counted = both.groupBy("lang", "source", "term").agg(F.count_if(F.col("at") < F.col("size")).alias("n"), F.count_if(F.col("at") >= F.col("size")).alias("docs"))
    by_term = (
        counted
        .groupBy("lang", "term")
        .agg(F.sum("docs").alias("in_docs"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("held"))
        .where(F.col("in_docs") >= least)
    )
    return by_term.join(maybe_broadcast(axis), "lang").select("lang", "term", F.transform("sources", lambda s: F.coalesce(F.try_element_at("held", s), F.lit(0))).alias("counts"))


def sizes(vectors: DataFrame) -> DataFrame:
    """(lang, totals, size): what each source's shares and the language's are divided by, N + 5 V."""
    by_place = vectors.select("lang", F.posexplode("counts").alias("place", "n")).groupBy("lang", "place").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kept"))
    by_lang = by_place.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "n"))).alias("all"), F.sum("n").alias("n"), F.max("kept").alias("kept"))
    added = F.col("kept") * SMOOTH
    return by_lang.select("lang", F.transform("all", lambda x: x["n"] + added).alias("totals"), (F.col("n") + added).alias("size"))


def with_shares(vectors: DataFrame) -> DataFrame:
    """`vectors` with shares, an array like counts, and whole, the language's share."""
    count_all = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    return vectors.join(maybe_broadcast(sizes(vectors)), "lang").select(
        "lang", "term", "counts",
        F.zip_with("counts", "totals", lambda c, n: share(c + SMOOTH, n)).alias("shares"),
        share(count_all + SMOOTH, F.col("size")).alias("whole"),
    )


def pair_divergences(shares: DataFrame, axis: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each ordered pair of sources of a language."""
    last = F.size("shares") - 1
    each = F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.transform(F.sequence(i + 1, last), lambda j: F.struct(i.alias("a"), j.alias("b"), F.abs(F.get("shares", i) - F.get("shares", j)).alias("part"))))
    parts = shares.where(last > 0).select("lang", F.explode(F.flatten(each)).alias("x"))
    sums = parts.groupBy("lang", F.col("x.a").alias("a"), F.col("x.b").alias("b")).agg(F.sum("x.part").alias("value"))
    place = axis.select("lang", F.posexplode("sources").alias("at", "source"))
    left, right = place.toDF("lang", "a", "source"), place.toDF("lang", "b", "item")
    pairs = left.join(right, "lang").where("a <> b")  # the result itself: a row for each ordered pair
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return pairs.select("lang", low, high, "source", "item").join(sums, ["lang", "a", "b"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))


def standing_out(shares: DataFrame, axis: DataFrame, top: int = 50) -> DataFrame:
    """(lang, source, item, value, rank): the `top` terms of each source by how far its share exceeds the language's."""
    at = F.filter(F.sequence(F.lit(0), F.size("shares") - 1), lambda i: (F.get("counts", i) > 0) & (F.get("shares", i) > F.col("whole")))
    over = F.transform(at, lambda i: F.struct(i.alias("at"), (F.get("shares", i) - F.col("whole")).alias("value")))
    rows = shares.select("lang", F.col("term").alias("item"), F.explode(over).alias("x")).select("lang", "item", "x.at", "x.value")
    best = Window.partitionBy("lang", "at").orderBy(F.desc("value"), "item")  # each task keeps its first `top` before the shuffle
    ranked = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(maybe_broadcast(axis), "lang").select("lang", F.get("sources", F.col("at")).alias("source"), "item", "value", "rank")


def audit(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has each source's divergence from every other source of its
    language, part `term` its `top` terms."""
    axis = materialise(axes(docs), "source-axes")
    shares = materialise(with_shares(materialise(term_vectors(docs, axis, least), "term-vectors")), "term-shares")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_divergences(shares, axis).withColumn("rank", F.row_number().over(order))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return columns(pairs, "pair").unionByName(columns(standing_out(shares, axis, top), "term"))
