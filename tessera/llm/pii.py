"""Personal data, by patterns and by information-theoretic sanitisation.

Patterns find the protected entities: mail and network addresses, card and phone numbers.  Of the terms in the same
documents (words of at least TERM letters) the corpus tells how strongly they reveal an entity: of N texts, n(t) hold the
term, n(e) the entity and n(t, e) both, and pointwise mutual information ln(N * n(t, e) / (n(t) * n(e))) over the entity's
own information ln(N / n(e)) is the share of that information which the term discloses, at most 1.  Where the entity is, a
term that discloses at least GENERALISE of it is replaced by a general mark everywhere in the document, and from REMOVE on
it is removed.  All four counts are of different whole texts, so copies prove nothing; as one text doesn't either, n(t, e)
must be at least SUPPORT, and so entities of fewer texts need no pairs.  All of it is DataFrame operations.

Defined results: null counts as empty; spans are in code points, end exclusive; repeated rows and rows without a doc_id
each get their spans; terms are judged only in documents that hold the entity, so texts without personal data stay as they
are; a word that runs into a pattern's span is no term there; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import columns_for, materialise, maybe_broadcast
from tessera.llm.spans import SPAN, count_of, joined, spans

KINDS = ["email", "ip", "card", "phone", "term"]
# The runs are written so that a matcher never backs up or recurses in them; they match what the plain forms match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM, SUPPORT = 4, 2
GENERALISE, REMOVE = 0.75, 0.95
WORD = r"\p{L}{4,}"


def _luhn(match: Column) -> Column:
    digits = F.reverse(F.regexp_replace(match, r"[\x20-]", ""))
    values = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.struct(i.alias("i"), F.substr(digits, i, F.lit(1)).cast("int").alias("d")))
    doubled = lambda x: F.when(x["i"] % 2 == 1, x["d"]).otherwise(2 * x["d"] - F.when(x["d"] > 4, 9).otherwise(0))
    return F.aggregate(values, F.lit(0), lambda a, x: a + doubled(x)) % 10 == 0


def _octets(match: Column) -> Column:
    plain = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(plain, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))


def _phone_digits(match: Column) -> Column:
    return F.length(F.regexp_replace(match, "[^0-9]", "")).between(9, 15)


def base_spans(text: Column) -> Column:
    """Spans of the four kinds of patterns, by start, then kind."""
    each = [
        spans(text, EMAIL, 0, hint=F.contains(text, F.lit("@"))),
        spans(text, IP, 1, _octets),
        spans(text, CARD, 2, _luhn),
        spans(text, PHONE, 3, _phone_digits, hint=F.contains(text, F.lit("+"))),
    ]
    return F.array_sort(F.concat(*each))


def _entity(span: Column) -> Column:
    """Kind and normal form: numbers by their digits, addresses in lower case."""
    return F.concat_ws(":", span["kind"], F.when(span["kind"] >= 2, F.regexp_replace(span["match"], "[^0-9]", "")).otherwise(F.lower(span["match"])))


def _terms(text: Column) -> Column:
    """The different words of a text, in lower case."""
    return F.filter(F.array_distinct(F.split(F.lower(text), r"\P{L}+")), lambda w: F.length(w) >= TERM)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, found): pattern spans.  text_key tells texts apart."""
    text = F.coalesce("text", F.lit(""))
    rows = columns_for(docs, "doc_id", "text").select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text"))
    return rows.select("doc_id", "text_key", base_spans(F.col("text")).alias("found"))


def disclosures(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(text_key, terms): of each text with an entity, the terms with the largest share that they disclose of one of its
    entities, from GENERALISE on."""
    texts = found.where(F.size("found") > 0).groupBy("text_key").agg(F.first("found").alias("found"))
    n = found.select("text_key").distinct().count()
    held = texts.select("text_key", F.explode(F.array_distinct(F.transform("found", lambda s: F.xxhash64(_entity(s))))).alias("entity"))
    often = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).where(F.col("n_e") >= SUPPORT)
    held = materialise(held.join(maybe_broadcast(materialise(often, "entities")), "entity"), "held")
    # the words of texts with such an entity, each text once
    source = columns_for(docs, "text").where("text is not null").withColumn("text_key", F.xxhash64("text"))
    keys = materialise(held.select("text_key").distinct(), "text-keys")
    words = source.join(maybe_broadcast(keys), "text_key", "left_semi").select("text_key", F.explode(_terms(F.col("text"))).alias("term")).distinct()
    words = materialise(words, "words")
    together = words.join(held, "text_key").groupBy("entity", "n_e", "term").agg(F.count(F.lit(1)).alias("n_te")).where(F.col("n_te") >= SUPPORT)
    together = materialise(together, "together")
    wanted = materialise(together.select("term").distinct(), "terms")
    # each of a text's copies counts for its part, so that terms are added up where they are found
    copies = materialise(found.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copies")
    every = source.join(maybe_broadcast(copies), "text_key", "left").select(F.coalesce("copies", F.lit(1)).alias("copies"), F.explode(_terms(F.col("text"))).alias("term"))
    occurs = every.join(maybe_broadcast(wanted, 2_000_000), "term", "left_semi").groupBy("term").agg(F.round(F.sum(1 / F.col("copies"))).cast("long").alias("n_t"))
    pmi = F.log(F.lit(float(max(n, 1))) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    own = F.log(F.lit(float(max(n, 1))) / F.col("n_e"))
    telling = together.join(occurs, "term").select("entity", "term", F.when(own > 0, pmi / own).alias("share")).where(F.col("share") >= GENERALISE)
    telling = materialise(telling, "telling")
    pairs = held.select("text_key", "entity").join(telling, "entity").join(words, ["text_key", "term"])
    return pairs.groupBy("text_key", "term").agg(F.max("share").alias("share")).groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("shares"))


TERMS = "array<struct<start:int,end:int,share:double>>"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, found, terms): pattern spans, and the disclosing terms as spans with their share; a row for each
    row of docs."""
    found = materialise(find(docs), "personal")
    telling = materialise(disclosures(docs, found), "telling-terms")
    text = F.coalesce("text", F.lit(""))
    marked = columns_for(docs, "text").select(F.xxhash64(text).alias("text_key"), text.alias("text")).join(maybe_broadcast(telling), "text_key")
    at = F.transform(F.filter(spans(F.col("text"), WORD, 4), lambda w: F.map_contains_key("shares", F.lower(w["match"]))), lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.col("shares")[F.lower(w["match"])].alias("share")))
    marked = materialise(marked.groupBy("text_key").agg(F.first("text").alias("text"), F.first("shares").alias("shares")).select("text_key", at.alias("terms")), "term-spans")
    rows = found.join(maybe_broadcast(marked), "text_key", "left")
    clear = F.filter(F.coalesce("terms", F.array().cast(TERMS)), lambda t: ~F.exists("found", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return rows.select("doc_id", "text_key", "found", F.when(F.size("found") > 0, clear).otherwise(F.array().cast(TERMS)).alias("terms"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)."""
    rows = scan(docs)
    extra = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), F.lit(4).alias("kind"), t["end"].alias("end"), F.lit("").alias("match")))
    every = F.array_sort(F.concat("found", extra.cast(SPAN)))
    return rows.select("doc_id", *[count_of(F.col("found"), i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])], F.sha2(joined(F.col("found"), KINDS), 256).alias("base_sha256"), joined(every, KINDS).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """(doc_id, text): entities become [KIND], disclosing terms [TERM] or nothing.  Overlapping spans are cut as one,
    under the first one's mark."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    # one row for each text that occurs under a doc_id: repeated rows must not multiply each other
    rows = scan(docs).dropDuplicates(["doc_id", "text_key"]).select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "found", "terms")
    source = columns_for(docs, "doc_id", "text")
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    cuts = F.concat(
        F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), marks[s["kind"]].alias("mark"))),
        F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["share"] >= REMOVE, "").otherwise(marks[4]).alias("mark"))),
    )
    whole = source.join(rows, source["doc_id"].eqNullSafe(rows["d"]) & (key == rows["k"])).withColumn("text", F.coalesce("text", F.lit("")))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, c: Column) -> Column:
        fresh = F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1, c["start"] - a["at"]), c["mark"])
        return F.when(c["start"] >= a["at"], F.struct(c["end"].alias("at"), fresh.alias("out"))).otherwise(F.struct(F.greatest(a["at"], c["end"]).alias("at"), a["out"].alias("out")))

    made = F.aggregate(F.array_sort(cuts), state, step, lambda a: F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1, F.length("text"))))
    return whole.select("doc_id", made.alias("text"))
