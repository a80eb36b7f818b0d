"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import align, bitpack, decontaminate, divergence, mixing, neardup, ngram, packing, pii, quality, secrets, tokencount, warc
from tessera.llm.common import documents


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.budgets(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"), limit=4096)


def op4_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.scores(documents(spark, sf_dir))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(documents(spark, sf_dir))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans, as a history comes: of the English documents, then of all, where the second takes what the ledger lacks."""
    docs = documents(spark, sf_dir)
    ledger = secrets.scan(docs.where("lang = 'en'"))
    return secrets.report(docs, ledger.unionByName(secrets.scan(docs, ledger=ledger)))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.write_and_read(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), end_id=1)


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.digests(align.align(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.places(packing.sequences(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), end_id=2, capacity=1024))


OP2_SQL = r"""
WITH d AS (SELECT doc_id AS id, [x FOR x IN string_split_regex(lower(text), '[\x20\x09-\x0D!-/:-@\[-`{-~]+') IF x <> ''] AS w FROM documents),
b AS (SELECT item_id AS id, [x FOR x IN string_split_regex(lower(text), '[\x20\x09-\x0D!-/:-@\[-`{-~]+') IF x <> ''] AS w FROM benchmark),
ds AS (SELECT DISTINCT id, unnest([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) AS s FROM d WHERE len(w) >= 5),
bs AS (SELECT DISTINCT id, unnest([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) AS s FROM b WHERE len(w) >= 5),
n AS (SELECT id, count(*) AS n_shingles FROM bs GROUP BY 1)
SELECT ds.id AS doc_id, bs.id AS item_id, count(*) AS n_shared, any_value(n_shingles) AS n_shingles, count(*) / any_value(n_shingles) AS containment
FROM bs JOIN ds USING (s) JOIN n ON n.id = bs.id GROUP BY 1, 2 HAVING count(*) >= 0.8 * any_value(n_shingles)
"""

OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY 1),
z AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (z.n + 5 * v.v)::HUGEINT AS BIGINT) AS p,
             CAST(1 + (1000000000::HUGEINT * (k.n + 5)) // (v.n + 5 * v.v)::HUGEINT AS BIGINT) AS q
      FROM g JOIN k USING (lang) JOIN v USING (lang) JOIN z USING (lang, source) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
FROM x QUALIFY part = 'pair' OR rank <= 50
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_quality_rules, op2_decontamination, op3_token_counts, op4_deleted_interpolation, op5_near_duplicates, op6_source_mix, op7_secret_scans, op8_personal_data, op9_warc, op10_token_files, op11_cross_tokenizer_alignment, op12_source_divergence, op13_best_fit_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op9_warc": OP9_SQL, "op12_source_divergence": OP12_SQL}
