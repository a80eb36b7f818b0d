"""Documents packed whole into sequences of a fixed number of tokens, by minimum bin slack.

Texts become ids and an end id; what is longer than a sequence is cut into full pieces behind a first one that may be
shorter.  Only how many pieces there are of each length reaches the driver, a row for each length up to the capacity.
There bins are filled one after the other: the longest piece left, and of the lengths left the combination that leaves
the least slack, found by subset sums in a bit set, longest lengths first so that short ones stay for later bins.  The
same bin is the answer again until a length runs out, so it is taken as often as that at once, and the number of
different bins depends on the capacity, not on the corpus.

A task numbers its pieces within each length as it writes them; earlier tasks' counts make that a rank over all, and
the rank says which copy of which bin the piece goes to.  So no task sees all pieces of a length.

Defined results: a null text is empty and has only the end id; a null doc_id stays null; repeated rows are packed one by
one; an empty table makes no sequence.  Other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import textbatch
from tessera.llm.common import columns_for, materialise, maybe_broadcast
from tessera.llm.segments import encoder

PIECES = "part int, number long, doc_id long, piece int, start long, length int, ids binary"
PLACED = "sequence_id long, offset long, doc_id long, piece int, start long, length int, ids binary"
SEQUENCES = "sequence_id long, doc_id array<long>, piece array<int>, start array<long>, length array<int>, ids binary"
PLACES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def width_of(vocabulary: int) -> str:
    """The unsigned little-endian integers that hold the ids of a vocabulary."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of all texts, as PIECES: `part` is the task, `number` counts its pieces of that length."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(tokenizer_path, end_id), TaskContext.get().partitionId()
        kind = np.dtype(width_of(len(own._sizes)))
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for at, to, w in textbatch.chunks(batch.column("text"), fold=False):
                ids, count = own.ids(w)
                n = -(-count // capacity)
                first = count - (n - 1) * capacity
                owner = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                length = np.where(piece == 0, first[owner], capacity)
                start = np.where(piece == 0, 0, first[owner] + (piece - 1) * capacity)
                order = np.argsort(length, kind="stable")
                new = np.diff(length[order], prepend=0) != 0
                run = np.flatnonzero(new)
                number = np.empty(len(length), np.int64)
                number[order] = seen[length[order]] + np.arange(len(order)) - np.repeat(run, np.diff(np.append(run, len(order))))
                seen += np.bincount(length, minlength=capacity + 1)
                ends = np.append(0, np.cumsum(length)) * kind.itemsize
                held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(ids.astype(kind).tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(length), part, np.int32)), pa.array(number), batch.column("doc_id").slice(at, to - at).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int32)), held.cast(pa.binary())],
                    ["part", "number", "doc_id", "piece", "start", "length", "ids"],
                )

    return columns_for(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, PIECES)


def fullest(left: dict[int, int], room: int) -> dict[int, int]:
    """Of `left` (how many pieces there are of each length), a combination of at most `room` in all that none exceeds.
    Lengths join the sums from the longest on, and no further once a full one is found."""
    sums, stages = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x in left if x <= room), reverse=True):
        stages.append((length, sums))
        more, step = min(left[length], room // length), 1
        while more:
            step = min(step, more)
            sums |= sums << (length * step) & mask
            more, step = more - step, step * 2
        if sums >> room & 1:
            break
    total, chosen = sums.bit_length() - 1, {}
    for length, before in reversed(stages):
        n = 0
        while not before >> (total - n * length) & 1:
            n += 1
        if n:
            chosen[length] = n
            total -= n * length
    return chosen


def bins(count: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(pieces of each length in a bin, how many such bins)] for all pieces."""
    left, out = {k: n for k, n in count.items() if n}, []
    while left:
        longest = max(left)
        rest = {**left, longest: left[longest] - 1}
        own = fullest({k: n for k, n in rest.items() if n}, capacity - longest)
        own[longest] = own.get(longest, 0) + 1
        times = min(left[k] // n for k, n in own.items())
        out.append((own, times))
        for k, n in own.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


class Slots:
    """Where the piece of a length with a rank goes: its bins take runs of ranks."""

    def __init__(self, plan: list[tuple[dict[int, int], int]]):
        used: dict[int, int] = {}
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        before = 0
        for own, times in plan:
            at = 0
            for length in sorted(own, reverse=True):
                runs.setdefault(length, []).append((used.get(length, 0), own[length], before, at))
                used[length] = used.get(length, 0) + own[length] * times
                at += own[length] * length
            before += times
        self.sequences = before
        self.runs = {length: np.array(x, np.int64).T for length, x in runs.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of each."""
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        order = np.argsort(length, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
            if len(some):
                first, each, before, at = self.runs[int(length[some[0]])]
                run = np.searchsorted(first, rank[some], "right") - 1
                copy, place = np.divmod(rank[some] - first[run], each[run])
                sequence[some], offset[some] = before[run] + copy, at[run] + place * length[some]
        return sequence, offset


def placed(own: DataFrame, capacity: int) -> DataFrame:
    """A written table of PIECES with sequence_id and offset, as PLACED."""
    held = materialise(own.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    count = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots = Slots(bins(count, capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sequence, offset = slots.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(sequence), pa.array(offset), *[batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids")]], ["sequence_id", "offset", "doc_id", "piece", "start", "length", "ids"])

    ranked = own.join(maybe_broadcast(materialise(before, "piece-ranks")), ["part", "length"])
    return ranked.select("doc_id", "piece", "start", "length", (F.col("before") + F.col("number")).alias("rank"), "ids").mapInArrow(rows, PLACED)


def sequences(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 1024) -> DataFrame:
    """The packed sequences, as SEQUENCES: `ids` of all pieces one after the other, and in the same order what they are."""
    own = materialise(pieces(docs, tokenizer_path, end_id, capacity), "pieces")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            some = pa.Table.from_batches([batch])
            if kept is not None:
                some = pa.concat_tables([kept, some])
            last = some.num_rows and int(np.searchsorted(some.column("sequence_id").to_numpy(), some.column("sequence_id")[-1].as_py()))
            yield from _joined(some.slice(0, last)).to_batches()
            kept = some.slice(last)
        if kept is not None:
            yield from _joined(kept).to_batches()

    spread = placed(own, capacity).repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    return materialise(spread.mapInArrow(rows, SEQUENCES), "sequences")


def _joined(rows: pa.Table) -> pa.Table:
    """Whole sequences, one row each, from rows in order."""
    rows = rows.combine_chunks()
    own = rows.column("sequence_id").to_numpy()
    first = np.flatnonzero(np.diff(own, prepend=-1))
    bounds = pa.array(np.append(first, len(own)), pa.int32())
    held = [x for c in rows.column("ids").chunks for x in c.to_pylist()]
    lists = {c: pa.ListArray.from_arrays(bounds, rows.column(c).combine_chunks()) if len(own) else pa.array([], pa.list_(rows.schema.field(c).type)) for c in ("doc_id", "piece", "start", "length")}
    ids = [b"".join(held[a:b]) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(own)], strict=True)] if len(own) else []
    return pa.table({"sequence_id": pa.array(own[first], pa.int64()), **lists, "ids": pa.array(ids, pa.binary())})


def places(packed: DataFrame) -> DataFrame:
    """Each piece of packed sequences with the crc32 of its ids, as PLACES, read from the sequences."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for x in batches if x.num_rows):
            own = batch.column("length").flatten().to_numpy().astype(np.int64)
            n = np.diff(batch.column("length").offsets.to_numpy())
            before = np.cumsum(own) - own
            offset = before - np.repeat(before[np.cumsum(n) - n], n)
            crc = []
            for raw, of in zip(batch.column("ids").to_pylist(), np.split(own, np.cumsum(n)[:-1]), strict=True):
                wide = memoryview(np.frombuffer(raw, f"<u{len(raw) // int(of.sum())}").astype("<u4").tobytes())
                ends = (4 * np.cumsum(of)).tolist()
                crc += [zlib.crc32(wide[a:b]) for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).flatten() for c in ("doc_id", "piece", "start")], pa.array(own), pa.array(crc, pa.int64()), batch.column("sequence_id").take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return packed.mapInArrow(rows, PLACES)
