"""Counts of 64-bit keys over a corpus, exact and without a table of the corpus in one place.

A table of blocks holds the corpus in rows of about a million words.  Each block sends every distinct key once, with its
counts, to the part of the key space that owns it; the part adds up and sends the totals back in the order they came in,
and files in the shared folder, each of some blocks, take them.  So a frequent key costs one entry a block, whatever its share
of the text.  A row goes from a block to a part only if it holds a key, so there are never more rows than keys sent.
Parts hold about PART_KEYS keys of any corpus, so a task's memory doesn't grow with it; beyond REDUCERS tasks a task has
several parts, one after the other, so that there are never more shuffle files than that many for each mapper.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bitpack import put
from tessera.llm.common import delete, fresh_path, materialise

PART_KEYS = 1_200_000
#: Most tasks that rows are dealt to, and blocks in a file.
REDUCERS, BLOCKS_IN_FILE = 10_000, 16


def several(pieces: dict[int, bytes]) -> bytes:
    """A file of the pieces of some blocks: how many, where each is, and the pieces."""
    at, index = 4 + 24 * len(pieces), []
    for block, piece in pieces.items():
        index.append(struct.pack("<qQQ", block, at, len(piece)))
        at += len(piece)
    return struct.pack("<I", len(pieces)) + b"".join(index) + b"".join(pieces.values())


def piece_of(folder: str, block: int) -> bytes | None:
    """A block's piece in a folder's files (their number is in its name); only its bytes are read.  None without one."""
    system, path = pafs.FileSystem.from_uri(f"{folder}/{place_of(block, int(folder.rsplit('-', 1)[-1]))}")
    if system.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    with system.open_input_file(path) as f:
        (n,) = struct.unpack("<I", f.read(4))
        for own, at, size in struct.iter_unpack("<qQQ", f.read(24 * n)):
            if own == block:
                f.seek(at)
                return f.read(size)
    return None


def file_of(block: Column, files: int) -> Column:
    return block % 2147483647 * 48271 % 2147483647 % files


def place_of(block: int, files: int) -> str:
    """A block's file, in one of a thousand folders."""
    number = block % 2147483647 * 48271 % 2147483647 % files
    return f"{number % 1000:03d}/{number}"


def put_pieces(rows: DataFrame, files: int, name: str, piece: Callable[[pa.Table], bytes]) -> str:
    """Groups `rows` by block, makes a piece of each block's and writes them to about `files` files; the folder."""
    folder = f"{fresh_path(rows.sparkSession, name)}/of-{files}"

    def store(found: pa.Table) -> pa.Table:
        blocks = np.unique(found.column("block").to_numpy())
        made = {int(b): piece(found.filter(pc.equal(found.column("block"), int(b)))) for b in blocks}
        put(f"{folder}/{place_of(int(blocks[0]), files)}", several(made))
        return table([{"block": int(b)} for b in blocks], "block long")

    dealt = rows.withColumn("file", file_of(F.col("block"), files)).repartition(max(1, min(files // 2, REDUCERS)), "file")
    dealt.groupBy("file").applyInArrow(store, "block long").count()
    return folder


def planes(x: np.ndarray) -> bytes:
    """Bytes of like weight side by side, so that a compressor sees runs of zeros."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time, so that one block is held."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def table(rows: list[dict], ddl: str) -> pa.Table:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "double": pa.float64()}
    return pa.Table.from_pylist(rows, schema=pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))]))


SENT = "block long, kind int, part int, keys binary, counts binary"
BACK = "block long, kind int, part int, counts binary, sums array<long>, positive array<long>, any long"


def _add_up(rows: pa.Table) -> pa.Table:
    """Totals of one part of the key space, for each block in the order of its keys."""
    rows = rows.to_pylist()
    keys = [np.cumsum(from_planes(r["keys"]), dtype=np.uint64) for r in rows]
    counts = np.concatenate([from_planes(r["counts"]).reshape(-1, len(k)) for r, k in zip(rows, keys, strict=True)], axis=1).astype(np.int64)
    order = np.argsort(np.concatenate(keys), kind="stable")
    new = np.diff(np.concatenate(keys)[order], prepend=np.uint64(0)) != 0
    new[:1] = True
    starts = np.flatnonzero(new)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    totals = np.add.reduceat(counts[:, order], starts, axis=1)
    out, at = [], 0
    for i, (r, k) in enumerate(zip(rows, keys, strict=True)):
        own = totals[:, place[at : at + len(k)]]
        at += len(k)
        first = {"sums": totals.sum(axis=1).tolist(), "positive": (totals > 0).sum(axis=1).tolist(), "any": int(totals.any(axis=0).sum())} if i == 0 else {}
        out.append({"block": r["block"], "kind": r["kind"], "part": r["part"], "counts": zlib.compress(planes(own.reshape(-1)), 1)} | first)
    return table(out, BACK)


def exchanged(blocks: DataFrame, sends: Callable[[dict], list[tuple[np.ndarray, np.ndarray]]], keys: int, name: str, fewer: tuple[int, ...] = (0,), part_keys: int | None = None) -> tuple[str, dict[int, dict]]:
    """blocks: rows with a column block.  sends gives for each kind of key a block's distinct keys in sorted order and
    their counts (field, key).  keys: about how many there are in all; fewer: how many bits fewer a kind needs.

    (a folder with the totals of each block, {kind: sums, positive (how many keys have a count), any})."""
    bits = max(0, (keys // (part_keys or PART_KEYS)).bit_length())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            for kind, (own, counts) in enumerate(sends(row)):
                if not len(own):
                    continue
                shift = 64 - max(0, bits - fewer[kind])
                part = (own >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(own), np.int64)
                cuts = np.flatnonzero(np.diff(part, prepend=-1))
                out = []
                for a, b in zip(cuts, np.append(cuts[1:], len(own)), strict=True):
                    steps = own[a:b].copy()
                    steps[1:] -= own[a : b - 1]
                    out.append({"block": row["block"], "kind": kind, "part": int(part[a]), "keys": planes(steps), "counts": planes(np.ascontiguousarray(counts[:, a:b]).reshape(-1))})
                yield from table(out, SENT).to_batches()

    parts = sum(1 << max(0, bits - f) for f in fewer)
    sent = blocks.mapInArrow(send, SENT).repartition(max(1, min(parts // 2, REDUCERS)), "kind", "part")
    back = materialise(sent.groupBy("kind", "part").applyInArrow(_add_up, BACK), name)
    sums: dict[int, dict] = {}
    for r in back.where("any is not null").groupBy("kind").agg(*[F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(2)]).alias(c) for c in ("sums", "positive")], F.sum("any").alias("any")).collect():
        sums[r["kind"]] = r.asDict()
    n_fields = max((len([x for x in s["sums"] if x is not None]) for s in sums.values()), default=1)

    def piece(rows: pa.Table) -> bytes:
        rows = sorted(rows.to_pylist(), key=lambda r: r["part"])
        out = b""
        for kind in range(len(fewer)):
            own = [from_planes(zlib.decompress(r["counts"])).reshape(n_fields, -1) for r in rows if r["kind"] == kind]
            data = zlib.compress(planes(np.concatenate(own, axis=1).reshape(-1) if own else np.zeros(0, np.uint64)), 1)
            out += len(data).to_bytes(8, "little") + data
        return out

    folder = put_pieces(back.select("block", "kind", "part", "counts"), max(1, blocks.count() // BLOCKS_IN_FILE), name, piece)
    delete(back.written_at)
    return folder, sums


def stored(place: str, block: int, fields: int, kinds: int) -> list[np.ndarray]:
    """(field, key) totals of each kind of a block's keys."""
    data, at, out = piece_of(place, block), 0, []
    if data is None:
        raise FileNotFoundError(f"no totals of block {block} in {place}")
    for _ in range(kinds):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(from_planes(zlib.decompress(data[at + 8 : at + 8 + n])).astype(np.int64).reshape(fields, -1))
        at += 8 + n
    return out


def deliver(rows: DataFrame, name: str) -> str:
    """rows (block, place): a folder with the places of each block that are wanted."""
    blocks = rows.select("block").distinct().count()
    return put_pieces(rows.select("block", "place"), max(1, blocks // BLOCKS_IN_FILE), name, lambda found: np.unique(found.column("place").to_numpy()).astype("<i8").tobytes())


def delivered(folder: str, block: int) -> np.ndarray:
    """The places of a block, none if it has none."""
    return np.frombuffer(piece_of(folder, block) or b"", "<i8")
