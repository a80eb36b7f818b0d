"""Quality rules by distribution divergence.

Each document's character-class histogram and common-word histogram are compared with those of its language by the
Jensen-Shannon distance.  The references are learned from all documents: a language's character classes are summed over
its documents, and its common words are those that make up at least `common_share` of its words, so that at most
1 / common_share words a language reach the driver.

Defined results: a null text is empty, a null language is a language of its own; an empty text has no words and fails
the base rule; a document below `min_words` words or `min_chars` characters is not judged by a distance (its distances
are still returned, null without words); repeated rows are judged alike, each on its own; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textbatch
from tessera.llm.common import columns_for, materialise, maybe_broadcast

CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other_ascii", "latin", "beyond")


@dataclass(frozen=True)
class Rules:
    """min_words / min_chars: the length guards.  max_char_distance / max_word_distance: the largest distances kept.
    max_word_distance has to be below the distance of a text without common words, so these must hold enough of a
    language's words: 0.34 to 0.35 of them on sf0.1, for a distance of 0.44 to 0.45."""

    common_share: float = 0.001
    min_words: int = 100
    min_chars: int = 400
    max_char_distance: float = 0.3
    max_word_distance: float = 0.4
    base_min_words: int = 50
    base_max_repeat_percent: int = 50


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES.index("other_ascii"), np.uint8)
    for name, chars in (("lower", range(0x61, 0x7B)), ("upper", range(0x41, 0x5B)), ("digit", range(0x30, 0x3A)), ("space", [0x20, *range(9, 14)]), ("stop", b".,;:!?'\"()-"), ("symbol", b"#*$%&|<>"), ("latin", range(0xC2, 0xCA)), ("beyond", range(0xCA, 0x100))):
        table[list(chars)] = CLASSES.index(name)
    table[0x80:0xC0] = 255  # continuation bytes belong to no class
    return table


_CLASS = _class_table()
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False


def _class_counts(w: textbatch.Words) -> np.ndarray:
    kinds = _CLASS[w.data]
    return np.stack([textbatch.per_text(kinds == i, w.offsets) for i in range(len(CLASSES))], axis=1)


def _reference_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word or class, n): sums over a partition; a negative key is a class."""
    words: dict[str | None, list] = {}
    classes: dict[str | None, np.ndarray] = {}

    def folded(parts: list) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for at, to, w in textbatch.chunks(batch.column("text")):
            counts, own = _class_counts(w), langs[at:to]
            owner = np.repeat(np.arange(to - at), np.diff(w.first))
            for lang in set(own):
                mine = np.array([x == lang for x in own])
                classes[lang] = classes.get(lang, 0) + counts[mine].sum(axis=0)
                keys, n = np.unique(w.hash[mine[owner]], return_counts=True)
                parts = words.setdefault(lang, [])
                parts.append((keys, n))
                if len(parts) >= 16:
                    words[lang] = [folded(parts)]
    for lang, parts in words.items():
        keys, n = folded(parts)
        keys = (keys >> np.uint64(1)).astype(np.int64)
        keys = np.concatenate([keys, -1 - np.arange(len(CLASSES))])
        n = np.concatenate([n, classes[lang]])
        for i in range(0, len(keys), 50_000):
            k = keys[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(n[i : i + 50_000])], ["lang", "key", "n"])


def references(docs: DataFrame, rules: Rules = Rules()) -> dict[str | None, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """{language: (class shares, keys of its common words, their shares and at the end that of all others)}."""
    counts = columns_for(docs, "text", "lang").mapInArrow(_reference_counts, "lang string, key long, n long")
    counts = counts.groupBy("lang", "key").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "language-counts")
    sizes = counts.groupBy("lang").agg(F.sum(F.when(F.col("key") >= 0, F.col("n")).otherwise(0)).alias("total")).withColumnRenamed("lang", "__lang")
    counts = counts.join(maybe_broadcast(sizes), F.col("lang").eqNullSafe(F.col("__lang"))).drop("__lang")
    kept = counts.where((F.col("key") < 0) | (F.col("n") >= F.col("total") * rules.common_share)).collect()
    totals = {r["lang"]: r["total"] for r in kept}
    out: dict = {}
    for r in kept:
        out.setdefault(r["lang"], []).append((r["key"], r["n"]))
    made = {}
    for lang, pairs in out.items():
        per_class = np.zeros(len(CLASSES))
        common = sorted((k, n) for k, n in pairs if k >= 0)
        for k, n in pairs:
            if k < 0:
                per_class[-1 - k] = n
        keys = np.array([k for k, _ in common], np.int64)
        shares = np.array([n for _, n in common], float) / max(totals[lang], 1)
        made[lang] = (per_class / max(per_class.sum(), 1), keys, np.append(shares, max(0.0, 1 - shares.sum())))
    return made


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of `p` (counts) to the shares `q`; nan for a row of zeros."""
    total = p.sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = p / total
        m = (p + q) / 2
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip((left + right) / 2, 0, 1)), np.nan)


def _repeat_words(w: textbatch.Words) -> np.ndarray:
    """Words of each text, told apart by case, in windows of three that occur twice or more in it."""
    n = len(w.hash)
    out = np.zeros(len(w), np.int64)
    if n < 3:
        return out
    owner = np.repeat(np.arange(len(w)), np.diff(w.first))
    with np.errstate(over="ignore"):
        keys = textbatch.mix(w.hash[:-2] * np.uint64(3) + w.hash[1:-1] * np.uint64(0x9E3779B97F4A7C15) + w.hash[2:] * np.uint64(0xC2B2AE3D27D4EB4F))
    inside = np.flatnonzero(owner[:-2] == owner[2:])
    order, new = textbatch.order_by_owner(keys[inside], owner[inside])
    again = np.zeros(len(inside), bool)
    again[1:] |= ~new[1:]
    again[:-1] |= ~new[1:]
    at = inside[order[again]]
    covered = np.zeros(n, bool)
    for j in range(3):
        covered[at + j] = True
    return textbatch.per_text(covered, w.first)


def _dup_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, char_distance double, word_distance double, base_failed boolean, kept boolean"


def _judged(learned: dict, rules: Rules) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, pa.RecordBatch]]]:
    """A function from batches to pairs of batch and verdicts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch]]:
        names = SCHEMA.replace(",", "").split()[::2]
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text")
            parts = []
            for at, to, w in textbatch.chunks(texts):
                classes = _class_counts(w)
                n_words = np.diff(w.first)
                owner = np.repeat(np.arange(to - at), n_words)
                inside = ~textbatch.SPACE[w.data] & _LEAD[w.data]
                by_char, by_word = np.full(to - at, np.nan), np.full(to - at, np.nan)
                short = (w.hash >> np.uint64(1)).astype(np.int64)
                for lang in set(langs[at:to]):
                    if lang not in learned:
                        continue
                    shares, keys, common = learned[lang]
                    mine = np.flatnonzero([x == lang for x in langs[at:to]])
                    by_char[mine] = distance(classes[mine], shares)
                    place = np.full(to - at, -1)
                    place[mine] = np.arange(len(mine))
                    own = place[owner] >= 0
                    slot = np.searchsorted(keys, short[own])
                    slot[(slot >= len(keys))] = len(keys)
                    known = slot < len(keys)
                    known[known] = keys[slot[known]] == short[own][known]
                    slot[~known] = len(keys)
                    bins = len(keys) + 1
                    histogram = np.bincount(place[owner][own] * bins + slot, minlength=len(mine) * bins).reshape(len(mine), bins)
                    by_word[mine] = distance(histogram, common)
                repeats = _repeat_words(textbatch.Words(w.data, w.offsets, fold=False))
                n_chars = classes.sum(axis=1)
                failed = (n_words < rules.base_min_words) | (100 * repeats > rules.base_max_repeat_percent * n_words)
                judged = (n_words >= rules.min_words) & (n_chars >= rules.min_chars)
                far = (by_char > rules.max_char_distance) | (by_word > rules.max_word_distance)
                lines = np.array([_dup_lines(x or "") for x in texts.slice(at, to - at).to_pylist()], np.int64)
                parts.append((n_words.astype(np.int64), textbatch.per_text(inside, w.offsets), textbatch.per_text(_SYMBOL[w.data], w.offsets), lines, repeats, by_char, by_word, failed, ~failed & ~(judged & far)))
            if not parts:
                continue
            columns = [pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)]
            for i in (5, 6):
                columns[i] = pa.array(np.concatenate([p[i] for p in parts]), from_pandas=True)
            yield batch, pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], names)

    return rows


def judge(docs: DataFrame, rules: Rules = Rules(), learned: dict | None = None) -> DataFrame:
    """A row for each document: its counts, its two distances, base_failed and kept."""
    judged = _judged(references(docs, rules) if learned is None else learned, rules)
    return columns_for(docs, "doc_id", "text", "lang").mapInArrow(lambda batches: (verdicts for _, verdicts in judged(batches)), SCHEMA)


def keep(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows that `judge` keeps, with the columns of `docs`, in one pass: each is judged by itself, whatever its id."""
    columns_for(docs, "doc_id", "text", "lang")
    judged = _judged(references(docs, rules), rules)
    return docs.mapInArrow(lambda batches: (batch.filter(verdicts.column("kept")) for batch, verdicts in judged(batches)), docs.schema)
