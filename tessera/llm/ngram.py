"""Language-model scores by deleted interpolation.

A bigram model: P(w | h) = a_b * c(h w) / c(h) + d_b * c(w) / N + e_b / (V + 1), where the weights depend on the bucket b
of the context's frequency, b = bit length of c(h).  The weights are learned by expectation-maximisation: of the training
documents one fold is left out of the counts, and its bigrams are the held-out counts.  Scores then use the counts of all
training documents.

How it is spread: documents are tokenised once into blocks of about a million words (a sorted vocabulary and, for each
word, its place there), written to the shared folder.  Counts of words and bigrams are added up over blocks by
`exchange`, and no table of the corpus is ever held whole.  Words and bigrams are told apart by 64-bit hashes.

Defined results: null counts as empty, and an empty text has one token, the end; a null doc_id is in training, as its
text is empty; repeated rows are learned from and scored one by one; without any training document all probability is
on the unknown word; without held-out bigrams the weights stay at DEFAULT.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textbatch
from tessera.llm.common import columns_for, materialise
from tessera.llm.exchange import PART_KEYS, exchanged, rows_of, stored

END, START = np.uint64(1), np.uint64(2)
HELD_OUT, TUNE, FOLDS = 2, 3, 7
DEFAULT = (0.4, 0.4, 0.2)
BUCKETS = 65
BLOCK_WORDS, BLOCKS_IN_FILE = 1_000_000, 8

BLOCK = "block long, n_words long, doc_ids binary, missing binary, folds binary, lengths binary, vocabulary binary, places binary"


def fold_of(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 40
    ids: list = []
    lengths: list[np.ndarray] = []
    hashes: list[np.ndarray] = []
    held = 0

    def made() -> pa.RecordBatch:
        vocabulary, places = np.unique(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), return_inverse=True)
        row = {
            "block": number,
            "n_words": held,
            "doc_ids": np.array([0 if x is None else x for x in ids], "<i8").tobytes(),
            "missing": np.array([x is None for x in ids], np.uint8).tobytes(),
            "folds": np.array([fold_of(x) for x in ids], np.uint8).tobytes(),
            "lengths": np.concatenate(lengths).astype("<u4").tobytes(),
            "vocabulary": vocabulary.astype("<u8").tobytes(),
            "places": places.astype("<u4").tobytes(),
        }
        return pa.RecordBatch.from_pylist([row], schema=pa.schema([("block", pa.int64()), ("n_words", pa.int64()), *((k, pa.binary()) for k in list(row)[2:])]))

    for batch in batches:
        doc_ids = batch.column("doc_id").to_pylist()
        for at, to, w in textbatch.chunks(batch.column("text")):
            ids += doc_ids[at:to]
            lengths.append(np.diff(w.first))
            hashes.append(w.hash)
            held += len(w.hash)
            if held >= BLOCK_WORDS:
                yield made()
                number += 1
                ids, lengths, hashes, held = [], [], [], 0
    if ids:
        yield made()


class Block:
    """A block read back: its keys in sorted order, and the key of each token and bigram."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.doc_ids = [None if m else int(x) for x, m in zip(np.frombuffer(row["doc_ids"], "<i8"), row["missing"], strict=True)]
        self.folds = np.frombuffer(row["folds"], np.uint8)
        words = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        vocabulary = np.frombuffer(row["vocabulary"], "<u8")
        v = len(vocabulary)
        self.lengths = words + 1
        n = int(self.lengths.sum())
        self.ends = np.cumsum(self.lengths) - 1
        self.token = np.empty(n, np.int64)
        is_end = np.zeros(n, bool)
        is_end[self.ends] = True
        self.token[~is_end] = np.frombuffer(row["places"], "<u4")
        self.token[is_end] = v
        self.context = np.empty(n, np.int64)
        self.context[1:] = self.token[:-1]
        self.context[self.ends[:-1] + 1] = v + 1
        if n:
            self.context[0] = v + 1
        self.words = np.concatenate([vocabulary, [END, START]]).astype(np.uint64)
        local, self.bigram = np.unique(self.context * (v + 2) + self.token, return_inverse=True)
        self.left, self.right = local // (v + 2), local % (v + 2)
        with np.errstate(over="ignore"):
            self.pairs = textbatch.mix(self.words[self.left] * np.uint64(0x9E3779B97F4A7C15) + self.words[self.right] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(7))
        doc = np.repeat(np.arange(len(self.folds)), self.lengths)
        self.tune = self.folds[doc] == TUNE
        self.fit = (self.folds[doc] != HELD_OUT) & ~self.tune

    def counts(self, which: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(fit, tune) counts of the tokens' or bigrams' places."""
        return np.bincount(which[self.fit], minlength=size).astype(np.int64), np.bincount(which[self.tune], minlength=size).astype(np.int64)


class Model:
    """What scoring needs: where each block's totals are, the weights by bucket, N and V."""

    def __init__(self, blocks: DataFrame, place: str, sums: dict):
        self.blocks, self.place = blocks, place
        self.n_fit, self.v_fit = sums["n_fit"], sums["v_fit"]
        self.n, self.v = sums["n_fit"] + sums["n_tune"], sums["v_all"]
        self.weights: list[tuple[float, float, float]] = [DEFAULT] * BUCKETS


def count(docs: DataFrame) -> Model:
    """Tokenises and counts the corpus."""
    blocks = materialise(columns_for(docs, "doc_id", "text").mapInArrow(_blocks, BLOCK), "lm-blocks", BLOCKS_IN_FILE)
    total = blocks.agg(F.sum("n_words")).first()[0] or 0

    def sends(row: dict) -> list[tuple[np.ndarray, np.ndarray]]:
        block, out = Block(row), []
        for keys, which in ((block.words, block.token), (block.pairs, block.bigram)):
            order = np.argsort(keys)
            out.append((keys[order], np.stack(block.counts(which, len(keys)))[:, order]))
        return out

    place, sums = exchanged(blocks, sends, total, "lm-totals", fewer=(2, 0), part_keys=PART_KEYS)
    words = sums.get(0, {"sums": [0, 0], "positive": [0, 0], "any": 0})
    return Model(blocks, place, {"n_fit": words["sums"][0], "n_tune": words["sums"][1], "v_fit": words["positive"][0], "v_all": words["any"]})


def _totals(place: str, block: Block) -> tuple[np.ndarray, ...]:
    """fit and tune totals of the block's words and bigrams, in its own order."""
    out = []
    for keys, got in zip((block.words, block.pairs), stored(place, block.block, 2, 2), strict=True):
        if got.shape[1] != len(keys):
            raise ValueError("a block's totals don't fit its keys")
        for x in got:
            own = np.empty(len(keys), np.int64)
            own[np.argsort(keys)] = x
            out.append(own)
    for x in out[:2]:  # the start comes before as many tokens as there are ends
        x[-1] = x[-2]
    return tuple(out)


def learn(model: Model, rounds: int = 25, tolerance: float = 1e-4) -> Model:
    """Mixture weights by expectation-maximisation over the held-out bigrams."""
    place = model.place

    def held_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of([batch]):
                block = Block(row)
                word_fit, _, pair_fit, _ = _totals(place, block)
                _, n = block.counts(block.bigram, len(block.pairs))
                some = np.flatnonzero(n)
                h, hw, w = word_fit[block.left[some]], pair_fit[some], word_fit[block.right[some]]
                order = np.lexsort((w, hw, h))
                h, hw, w, n = h[order], hw[order], w[order], n[some][order]
                new = np.ones(len(h), bool)
                new[1:] = (np.diff(h) != 0) | (np.diff(hw) != 0) | (np.diff(w) != 0)
                at = np.flatnonzero(new)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[at], hw[at], w[at], np.add.reduceat(n, at))], ["h", "hw", "w", "n"])

    table = model.blocks.mapInArrow(held_out, "h long, hw long, w long, n long").groupBy("h", "hw", "w").agg(F.sum("n").alias("n"))
    p = table.select(
        F.when(F.col("h") > 0, F.length(F.bin("h"))).otherwise(0).alias("b"),
        F.when(F.col("h") > 0, F.col("hw") / F.col("h")).otherwise(0.0).alias("p2"),
        (F.col("w") / F.lit(float(max(model.n_fit, 1)))).alias("p1"),
        F.col("n").cast("double").alias("n"),
    )
    p = materialise(p, "lm-held-out")
    p0 = 1.0 / (model.v_fit + 1)
    for _ in range(rounds):
        a, d, e = (F.element_at(F.array(*[F.lit(float(w[i])) for w in model.weights]), F.col("b") + 1) for i in range(3))
        terms = p.select("b", "n", (a * F.col("p2")).alias("t2"), (d * F.col("p1")).alias("t1"), (e * F.lit(p0)).alias("t0"))
        share = F.col("n") / (F.col("t2") + F.col("t1") + F.col("t0"))
        found = terms.groupBy("b").agg(*[F.sum(share * F.col(t)).alias(t) for t in ("t2", "t1", "t0")]).collect()
        moved = 0.0
        for r in found:
            total = r["t2"] + r["t1"] + r["t0"]
            new = (r["t2"] / total, r["t1"] / total, r["t0"] / total)
            moved = max(moved, *(abs(x - y) for x, y in zip(new, model.weights[r["b"]], strict=True)))
            model.weights[r["b"]] = new
        if moved < tolerance:
            break
    return model


def bucket(context_count: np.ndarray) -> np.ndarray:
    return np.where(context_count > 0, np.frexp(np.maximum(context_count, 1).astype(float))[1], 0)


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(model: Model) -> DataFrame:
    place, n, v, weights = model.place, model.n, model.v, np.array(model.weights)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of([batch]):
                block = Block(row)
                word_fit, word_tune, pair_fit, pair_tune = _totals(place, block)
                word, pair = word_fit + word_tune, pair_fit + pair_tune
                base = np.log10((word + 1) / (n + v + 1))
                h, w = word[block.left], word[block.right]
                mixed = weights[bucket(h)]
                with np.errstate(divide="ignore", invalid="ignore"):
                    p2 = np.where(h > 0, pair / h, 0)
                p = mixed[:, 0] * p2 + mixed[:, 1] * (w / max(n, 1)) + mixed[:, 2] / (v + 1)
                logs = np.log10(p) if n else np.zeros(len(p))
                starts = block.ends - block.lengths + 1
                total = lambda x: np.add.reduceat(x, starts)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.doc_ids, pa.int64()), pa.array(block.folds == HELD_OUT), pa.array(block.lengths), pa.array(total((word[block.token] > 0).astype(np.int64))), pa.array(np.full(len(starts), n, np.int64)), pa.array(total(base[block.token])), pa.array(total(logs[block.bigram]))],
                    [x.split()[0] for x in SCHEMA.split(", ")],
                )

    return model.blocks.mapInArrow(rows, SCHEMA)


def scores(docs: DataFrame) -> DataFrame:
    """Counts, learns the weights and scores every document."""
    return score(learn(count(docs)))
