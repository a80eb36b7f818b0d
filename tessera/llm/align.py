"""Alignment of a byte-level BPE tokenizer (A) with a byte-fallback BPE one of the sentencepiece library (B).

Texts are cut before white space that begins with a space or a line feed, where neither merges across: A's pre-tokenizer
doesn't (see `segments`), and no piece of B holds a space mark or line feed behind another character.  A vocabulary or
normaliser for which this isn't so is refused.  Segments recur, so each one in the corpus is tokenised and aligned once,
and documents are put together from their segments' alignments:

1. Blocks of documents number their distinct segments; a document is then a list of numbers.
2. A block's distinct segments go, with how often it has them, to where the segment belongs, in order; there each is
   aligned when it first comes by, and is written with the places that want it, HOMES of them in a row.
3. Id pairs are counted over the segments with their counts.
4. With the pairs' counts, alignments go back to the blocks that want them, where documents are composed.

So a frequent segment is one entry a block and streams past, a frequent pair is one row a segment, and a task holds a
block.
A reads a space and the text, B the
text, before which it puts a space itself.  A group is the span between offsets where tokens of both end; a link is a
pair of occurrences whose bytes overlap.

Defined results: a text that is null, empty, or that B doesn't give back (it holds the space mark itself) has no tokens,
zeros everywhere and '' for its groups; repeated rows count one by one; an empty table gives no rows.  Other columns
aren't read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import columns_for, materialise, maybe_broadcast
from tessera.llm.segments import byte_lengths, encoded, load

MARK = "▁"
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: Code points of text in a block.
BLOCK_CHARS = 16_000_000
#: Pairs whose counts every task may hold (17 bytes each); beyond that they are joined, where a pair that more than WIDE
#: segments have is dealt among DEAL copies of its count.
MANY_PAIRS, WIDE, DEAL = 2_000_000, 100_000, 16
#: Places of a segment in a row of the table of segments.
HOMES = 4096
#: A pair of ids is a * PAIR + b.
PAIR = 1 << 32

BLOCKS = "block long, doc_id long, places binary, at int, segment string, n long"
ALIGNED = "sid long, n long, data binary, pairs array<long>, times array<long>, block array<long>, at array<int>"
WANTED = "block long, at int, data binary, n_best long, count_sum long"
DOCUMENTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def cut(text: str) -> list[str]:
    return _CUT.split(text)


class Aligner:
    """Tokens of segments under both files, and their alignment."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = load(path_a, plain=True)
        self.sizes_a = byte_lengths(self.a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        b = self.b
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        if any(re.search(rf"[^{MARK}]{MARK}|\n", x) for x in pieces):
            raise ValueError("B merges across cuts")
        # the normaliser may do nothing but put one space mark in front and one for each space
        every = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
        for i in range(0, len(every), 1 << 16):
            some = "".join(map(chr, every[i : i + (1 << 16)]))
            if b.normalize(some) != MARK + some.replace(" ", MARK):
                raise ValueError("B's normaliser changes texts")
        self.sizes_b = np.array([1 if b.is_byte(i) else len(x.replace(MARK, " ").encode()) for i, x in enumerate(pieces)], np.int64)
        self.alone = b.piece_to_id(MARK)
        self._texts = [bytes([int(x[3:5], 16)]) if b.is_byte(i) else x.replace(MARK, " ").encode() for i, x in enumerate(pieces)]

    def ids_b(self, segments: list[str]) -> list[list[int]]:
        """B puts a space in front itself: of a segment that begins with one it gets the rest, of one that begins with a
        line feed the space's piece, which nothing joins, is taken off again."""
        out = self.b.encode([x[1:] if x[0] == " " else x for x in segments], num_threads=1)
        for i, x in enumerate(segments):
            if x == " ":
                out[i] = [self.alone]
            elif x[0] != " ":
                out[i] = out[i][1:]
            if b"".join([self._texts[k] for k in out[i]]) != x.encode():
                raise ValueError("B doesn't give a segment back")
        return out

    def aligned(self, segments: list[str]) -> Iterator[tuple[list[int], list[int], list[int], list[tuple[int, int]]]]:
        """(A's ids, B's ids, how many of each every group has (a, b, a, b, ...), links as id pairs) of each segment."""
        sa, sb = self.sizes_a.tolist(), self.sizes_b.tolist()
        for a, b in zip(encoded(self.a, self.sizes_a, segments), self.ids_b(segments), strict=True):
            a = a.tolist()
            if len(a) == 1 or len(b) == 1:
                yield a, b, [len(a), len(b)], [(x, y) for x in a for y in b]
                continue
            i = j = from_i = from_j = 0
            end_a, end_b, sizes, links = sa[a[0]], sb[b[0]], [], []
            while True:
                links.append((a[i], b[j]))
                if end_a == end_b:
                    sizes += [i + 1 - from_i, j + 1 - from_j]
                    i, j = i + 1, j + 1
                    if i == len(a):
                        break
                    from_i, from_j = i, j
                    end_a, end_b = end_a + sa[a[i]], end_b + sb[b[j]]
                elif end_a < end_b:
                    i += 1
                    end_a += sa[a[i]]
                else:
                    j += 1
                    end_b += sb[b[j]]
            yield a, b, sizes, links


def written(a: list[int], b: list[int], sizes: list[int], n_links: int) -> bytes:
    """An alignment as the width of its numbers, then links, groups, the groups' sizes and the ids."""
    every = [n_links, len(sizes) // 2, *sizes, *a, *b]
    width = 2 if max(every) < 1 << 16 else 4
    return bytes([width]) + np.array(every, f"<u{width}").tobytes()


def spelled(data: bytes) -> tuple[str, int, int, int, int]:
    """(groups as a1,a2|b1;a3|b2,b3, A's ids, B's ids, groups, links) of an alignment."""
    n_links, n_groups, *x = np.frombuffer(data, f"<u{data[0]}", offset=1).tolist()
    sizes, ids = x[: 2 * n_groups], x[2 * n_groups :]
    n_a = sum(sizes[::2])
    names = list(map(str, ids))
    if n_groups == 1:
        return f"{','.join(names[:n_a])}|{','.join(names[n_a:])}", n_a, len(ids) - n_a, 1, n_links
    out, i, j = [], 0, n_a
    for n, m in zip(sizes[::2], sizes[1::2], strict=True):
        out.append(f"{','.join(names[i : i + n])}|{','.join(names[j : j + m])}")
        i, j = i + n, j + m
    return ";".join(out), n_a, len(ids) - n_a, n_groups, n_links


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2^32 in few bytes: bytes of like weight side by side, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """This process's aligner."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def blocks(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of two kinds, as BLOCKS: a document with the numbers of its segments in order, and a block's distinct segment
    with its number and how often the block holds it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        known: dict[str, int] = {}
        held, size = [], 0

        def done() -> pa.RecordBatch:
            n, m = len(held), len(known)
            counts = np.bincount(np.concatenate([x for _, x in held]), minlength=m)
            rank = np.empty(m, np.uint32)
            rank[np.argsort(-counts, kind="stable")] = np.arange(m)  # frequent segments have small numbers
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n + m, block)), pa.array([i for i, _ in held] + [None] * m, pa.int64()), pa.array([packed(rank[x]) for _, x in held] + [None] * m, pa.binary()),
                    pa.array([None] * n + rank.tolist(), pa.int32()), pa.array([None] * n + list(known), pa.string()), pa.array([None] * n + counts.tolist(), pa.int64()),
                ],
                ["block", "doc_id", "places", "at", "segment", "n"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                parts = _CUT.split(" " + text) if text and MARK not in text else []
                held.append((doc_id, np.array([known.setdefault(x, len(known)) for x in parts], np.int32)))
                size += len(text or "")
                if size >= block_chars:
                    yield done()
                    block, size = block + 1, 0
                    known, held = {}, []
        if held:
            yield done()

    return columns_for(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, BLOCKS)


def aligned(rows: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Distinct segments of `blocks` with their alignment and places, as ALIGNED: `n` is how often these places have the
    segment; each link pair of a segment is there once with `times`."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sid = aligner(path_a, path_b), TaskContext.get().partitionId() << 40
        last = None  # (segment, its alignment) that the next batch may go on with
        for batch in (x for x in batches if x.num_rows):
            segment = batch.column("segment")
            runs = pc.run_end_encode(segment, run_end_type=pa.int32())
            names, ends = runs.values.to_pylist(), runs.run_ends.to_numpy()
            known = names[0] == last[0] if last else False
            made = [last[1]] if known else []
            for a, b, sizes, links in own.aligned(names[len(made) :]):
                made.append((written(a, b, sizes, len(links)), Counter(x * PAIR + y for x, y in links)))
            last = names[-1], made[-1]
            starts = np.append(0, ends[:-1])
            # a run of more than HOMES places is several rows
            cuts = [range(a, b, HOMES) for a, b in zip(starts.tolist(), ends.tolist())]
            which = np.repeat(np.arange(len(names)), [len(x) for x in cuts])
            first = np.array([i for x in cuts for i in x], np.int32)
            bounds = pa.array(np.append(first, len(segment)), pa.int32())
            n = np.add.reduceat(batch.column("n").to_numpy(), first)
            pairs, times = [made[i][1].keys() for i in which.tolist()], [made[i][1].values() for i in which.tolist()]
            lists = pa.array(np.append(0, np.cumsum([len(x) for x in pairs])), pa.int32())
            flat = lambda parts: pa.array([v for x in parts for v in x], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(sid, sid + len(which))), pa.array(n, pa.int64()), pa.array([made[i][0] for i in which.tolist()], pa.binary()), pa.ListArray.from_arrays(lists, flat(pairs)), pa.ListArray.from_arrays(lists, flat(times)),
                    pa.ListArray.from_arrays(bounds, batch.column("block")), pa.ListArray.from_arrays(bounds, batch.column("at")),
                ],
                [x.split()[0] for x in ALIGNED.split(", ")],
            )
            sid += len(which)

    dealt = rows.where("segment is not null").select("segment", "block", "at", "n").repartition("segment").sortWithinPartitions("segment")
    return dealt.mapInArrow(found, ALIGNED)


def pair_counts(segments: DataFrame) -> DataFrame:
    """(pair, count, held, best): how many links of the corpus an id pair has, how many distinct segments have it, and
    whether no pair of its B id has more links (1 or 0)."""
    links = segments.select("n", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = links.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum(F.col("n") * F.col("x.times")).alias("count"), F.count(F.lit(1)).alias("held"))
    counts = materialise(counts.withColumn("b", F.col("pair") % PAIR), "pair-counts")
    tops = counts.groupBy("b").agg(F.max("count").alias("top"))  # a row for each B id
    return counts.join(tops, "b").select("pair", "count", "held", (F.col("count") == F.col("top")).cast("long").alias("best"))


def wanted(segments: DataFrame, counts: DataFrame) -> DataFrame:
    """A row for each place that wants a segment's alignment, with its links' sums, as WANTED."""
    if counts.limit(MANY_PAIRS + 1).count() > MANY_PAIRS:
        return _joined_counts(segments, counts)
    found = counts.select("pair", "count", "best").toPandas().sort_values("pair")
    held = segments.sparkSession.sparkContext.broadcast((found["pair"].to_numpy(), found["count"].to_numpy(), found["best"].to_numpy(np.int8)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = held.value
        for batch in (x for x in batches if x.num_rows):
            at = np.searchsorted(pair, batch.column("pairs").flatten().to_numpy())
            times, n = batch.column("times").flatten().to_numpy(), np.diff(batch.column("pairs").offsets.to_numpy())
            first = np.cumsum(n) - n  # every segment has a pair
            sums = [np.add.reduceat(times * x[at], first) for x in (best, count)]
            which = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(batch.column("at").offsets.to_numpy())))
            yield pa.RecordBatch.from_arrays([batch.column("block").flatten(), batch.column("at").flatten(), batch.column("data").take(which), *[pa.array(x, pa.int64()).take(which) for x in sums]], ["block", "at", "data", "n_best", "count_sum"])

    return segments.select("data", "pairs", "times", "block", "at").mapInArrow(rows, WANTED)


def _joined_counts(segments: DataFrame, counts: DataFrame) -> DataFrame:
    """`wanted` for any number of pairs."""
    links = segments.select("sid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("sid", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    wide = maybe_broadcast(counts.where(F.col("held") > WIDE).select("pair", F.lit(True).alias("wide")))
    links = links.join(wide, "pair", "left").select("sid", "pair", "times", F.when(F.col("wide"), F.pmod("sid", F.lit(DEAL)).cast("int")).otherwise(0).alias("deal"))
    copies = counts.withColumn("deal", F.explode(F.sequence(F.lit(0), F.when(F.col("held") > WIDE, DEAL - 1).otherwise(0))))
    joined = links.join(copies, ["pair", "deal"])
    sums = joined.groupBy("sid").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    places = segments.select("sid", "data", F.explode(F.arrays_zip("block", "at")).alias("x"))
    return places.join(sums, "sid").select("x.block", "x.at", "data", "n_best", "count_sum")


def documents(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The documents of `blocks` put together from what their segments' places got (WANTED), as DOCUMENTS."""
    texts = rows.where("segment is null").select(F.col("block").alias("home"), "doc_id", "places")

    def put_together(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("at").to_numpy())
        groups, *small = list(zip(*map(spelled, right.column("data").take(pa.array(order)).to_pylist()), strict=True)) or [()] * 5
        sums = np.array([*small, *[right.column(c).to_numpy()[order] for c in SUMS[4:]]], np.int64).reshape(len(SUMS), -1)
        totals, spelt = [], []
        for places in left.column("places").to_pylist():
            at = unpacked(places)
            totals.append(sums[:, at].sum(axis=1))
            spelt.append(";".join([groups[i] for i in at.tolist()]))
        total = np.array(totals, np.int64).reshape(-1, len(SUMS))
        return pa.table({"doc_id": left.column("doc_id"), **{c: pa.array(total[:, i]) for i, c in enumerate(SUMS)}, "groups": pa.array(spelt, pa.string())})

    return texts.groupBy("home").cogroup(found.groupBy("block")).applyInArrow(put_together, DOCUMENTS)


def align(docs: DataFrame, path_a: str, path_b: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Each document's tokens, groups and links under the two tokenizer files, as DOCUMENTS."""
    rows = materialise(blocks(docs, block_chars), "segment-blocks")
    segments = materialise(aligned(rows, path_a, path_b), "aligned-segments")
    return documents(rows, wanted(segments, pair_counts(segments)))


def digests(found: DataFrame) -> DataFrame:
    """`align`'s rows with the SHA-256 of the groups in their place."""
    return found.select("doc_id", *SUMS, F.when(F.col("n_a") == 0, F.lit("")).otherwise(F.sha2("groups", 256)).alias("groups_sha256"))


