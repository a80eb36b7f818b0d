"""Token ids in files of fixed-width bit packing.

Each id takes the fewest bits that hold the largest id of the vocabulary.  Ids are packed in blocks of 64: id i of a block
of width w starts at bit i * w of the block's w little-endian 64-bit words, so that any block is found by arithmetic and
all blocks are unpacked at once by numpy.  A file holds

    magic "TBPK", version u32, width u32, n_docs u64, n_ids u64      (little-endian)
    n_docs pairs (doc_id i64, n_tokens u64); a missing doc_id is the smallest i64
    the packed blocks, the last one filled with zeros

Files cover consecutive ranges of doc_id and are numbered in that order; in each, documents ascend.  A task writes a
temporary file and renames it, so a repeated task replaces equal bytes by equal bytes.

Defined results: a null text is empty and has only the end id; a null doc_id sorts first; rows that share a doc_id
follow each other, ordered by their text's hash; an empty table makes no file.
"""

from __future__ import annotations

import bisect
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textbatch
from tessera.llm.common import columns_for, fresh_path, materialise

HEADER = struct.Struct("<4sIIQQ")
MAGIC, VERSION, BLOCK = b"TBPK", 1, 64
NO_ID = -(2**63)
CACHE = 800_000
#: Bytes of a word from which its hash is of the stronger kind, of text in a range of doc_ids, and of ids in a file.
LONG, PART_BYTES, FILE_BYTES = 256, 8 << 20, 32 << 20
#: Most ranges of doc_id; beyond that they grow, and a task sorts with spills and writes several files.
MOST_PARTS = 10_000


def width_for(largest: int) -> int:
    return max(1, int(largest).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Blocks of 64 ids, each id `width` bits (at most 32) wide."""
    n = -(-len(ids) // BLOCK)
    padded = np.zeros((n, BLOCK), np.uint64)
    padded.reshape(-1)[: len(ids)] = ids
    out = np.zeros((n, width), np.uint64)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        out[:, word] |= padded[:, i] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= padded[:, i] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(data: bytes, width: int, first: int, last: int) -> np.ndarray:
    """Ids first..last-1 of packed blocks, touching only the blocks that hold them."""
    if last <= first:
        return np.zeros(0, np.uint32)
    b0, b1 = first // BLOCK, -(-last // BLOCK)
    words = np.frombuffer(data, "<u8", (b1 - b0) * width, b0 * width * 8).reshape(b1 - b0, width)
    out = np.empty((b1 - b0, BLOCK), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        got = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            got = got | words[:, word + 1] << np.uint64(64 - shift)
        out[:, i] = got & mask
    return out.reshape(-1)[first - b0 * BLOCK : last - b0 * BLOCK]


#: Characters that may follow a word.
TAIL = ".,;:!?|%&#$*"
_TAIL = np.zeros(256, bool)
_TAIL[list(TAIL.encode())] = True
_ALNUM = np.array([i < 128 and chr(i).isalnum() for i in range(256)])


def _cut_tails(w: textbatch.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of the words of `w`, those that end in an ASCII letter or digit and then TAIL characters as two."""
    last = np.maximum.accumulate(np.where(_TAIL[w.data], -1, np.arange(len(w.data)))) if len(w.data) else np.zeros(0, np.int64)
    core = last[w.end - 1] + 1
    cut = (core > w.start) & (core < w.end)
    cut[cut] = _ALNUM[w.data[core[cut] - 1]]
    upto = np.concatenate([[0], np.cumsum(1 + cut)])
    at = np.flatnonzero(cut)
    start, end = np.repeat(w.start, 1 + cut), np.repeat(w.end, 1 + cut)
    end[upto[at]] = start[upto[at] + 1] = core[at]
    return start, end, upto[w.first]


class Encoder:
    """Ids of whole texts under a tokenizer file whose pre-tokenizer drops white space, so that what stands between white
    space is encoded by itself, and puts TAIL characters behind ASCII letters and digits in a piece of their own, so that
    the two are encoded by themselves too.  Words are found and told apart as arrays, by 64-bit hashes of their bytes (of a
    stronger kind from LONG bytes on, where a polynomial can be made to collide), so only words that are new to the process
    become strings; ids are then gathered from a pool.  Each process keeps the ids of up to CACHE words; what is new is
    encoded in strings of many words at once."""

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.uint32(end_id)
        self._forget()
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        if not ids("a b") == ids("a") + ids("b") == ids("a\nb") == ids(" a  b ") or any(ids(f"a{c}{t}") != ids(f"a{c}") + ids(t) for t in [*TAIL, TAIL] for c in "bB1"):
            raise ValueError("this tokenizer joins what is encoded in parts here")
        # the last id of a piece, and no other, is of a token that ends a word
        self._ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self._ends[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True

    def _forget(self) -> None:
        self._known = np.zeros(0, np.uint64)
        self._start, self._count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._pool, self._held = np.zeros(1 << 16, np.uint32), 0

    @property
    def width(self) -> int:
        return width_for(self.tokenizer.get_vocab_size(with_added_tokens=True) - 1)

    def _encoded(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word.  Words of letters are joined by spaces: each has at least one piece, so that if there are
        as many pieces as words, each word is one and the pieces' ends cut the ids."""
        out: list = [None] * len(words)
        plain = [i for i, x in enumerate(words) if x.isalpha() and len(x) < 64]
        groups = [plain[i : i + 64] for i in range(0, len(plain), 64)]
        rest = [i for i, x in enumerate(words) if not (x.isalpha() and len(x) < 64)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join([words[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = (np.flatnonzero(self._ends[ids]) + 1).tolist()
            if len(ends) != len(group):
                rest += group
                continue
            at = 0
            for i, to in zip(group, ends, strict=True):
                out[i] = ids[at:to]
                at = to
        for at in range(0, len(rest), 20_000):
            some = rest[at : at + 20_000]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([words[i] for i in some], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, np.uint32)
        return out

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Takes new words with their hashes, in sorted order, into the pool."""
        made = self._encoded(words)
        count, fresh = np.array([len(x) for x in made], np.int64), np.concatenate(made)
        while self._held + len(fresh) > len(self._pool):
            self._pool = np.concatenate([self._pool, np.zeros_like(self._pool)])
        self._pool[self._held : self._held + len(fresh)] = fresh
        at = np.searchsorted(self._known, hashes)
        self._known = np.insert(self._known, at, hashes)
        self._start = np.insert(self._start, at, self._held + np.cumsum(count) - count)
        self._count = np.insert(self._count, at, count)
        self._held += len(fresh)

    def pieces_of(self, w: textbatch.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _cut_tails(w)

    def ids(self, w: textbatch.Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of `w` one after the other, each with the end id, ids of each text)."""
        from_, to, bounds = self.pieces_of(w)
        hashes = w.hash_of(from_, to)
        for i in np.flatnonzero(to - from_ >= LONG):
            hashes[i] = xxhash.xxh3_64_intdigest(w.data[from_[i] : to[i]].tobytes())
        every, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self._known) + len(every) > CACHE:
            self._forget()
        slot = np.searchsorted(self._known, every)
        new = np.ones(len(every), bool)
        inside = slot < len(self._known)
        new[inside] = self._known[slot[inside]] != every[inside]
        if new.any():
            raw = w.data.tobytes()
            self._learn(every[new], [raw[a:b].decode() for a, b in zip(from_[first[new]].tolist(), to[first[new]].tolist(), strict=True)])
            slot = np.searchsorted(self._known, every)
        slot = slot[place]
        start, count = self._start[slot], self._count[slot]
        upto = np.concatenate([[0], np.cumsum(count)])
        per_text = upto[bounds[1:]] - upto[bounds[:-1]] + 1
        out = np.full(int(upto[-1]) + len(per_text), self.end, np.uint32)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(per_text) - 1] = False
        out[inner] = self._pool[np.repeat(start - upto[:-1], count) + np.arange(upto[-1])]
        return out, per_text

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids and the end id, as little-endian unsigned 32-bit integers."""
        out = []
        for _, _, w in textbatch.chunks(pa.array(texts, pa.large_string()), fold=False):
            ids, count = self.ids(w)
            out += [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(count)[:-1])]
        return out


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def _file(ids: list[int | None], arrays: list[np.ndarray], width: int) -> bytes:
    index = np.empty((len(ids), 2), "<i8")
    index[:, 0] = [NO_ID if x is None else x for x in ids]
    index[:, 1] = [len(a) for a in arrays]
    every = np.concatenate(arrays) if arrays else np.zeros(0, np.uint32)
    return HEADER.pack(MAGIC, VERSION, width, len(ids), len(every)) + index.tobytes() + pack(every, width)


class Reader:
    """Random access to one file's documents."""

    def __init__(self, data: bytes):
        magic, version, self.width, self.n_docs, self.n_ids = HEADER.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file")
        index = np.frombuffer(data, "<i8", 2 * self.n_docs, HEADER.size).reshape(self.n_docs, 2)
        self.doc_ids = [None if x == NO_ID else int(x) for x in index[:, 0]]
        self.starts = np.concatenate([[0], np.cumsum(index[:, 1])])
        self.body = memoryview(data)[HEADER.size + 16 * self.n_docs :]

    def ids(self, at: int) -> np.ndarray:
        """The ids of document `at` of this file; only its blocks are unpacked."""
        return unpack(self.body, self.width, int(self.starts[at]), int(self.starts[at + 1]))


    def all(self) -> np.ndarray:
        """The ids of all documents, one after the other."""
        return unpack(self.body, self.width, 0, self.n_ids)


def put(uri: str, data: bytes) -> None:
    """A file at `uri`, complete or not there."""
    system, path = pafs.FileSystem.from_uri(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(temporary) as f:
        f.write(data)
    system.move(temporary, path)


def get(uri: str) -> bytes:
    system, path = pafs.FileSystem.from_uri(uri)
    with system.open_input_stream(path) as f:
        return f.read()


def _bounds(marks: DataFrame, files: int) -> list[tuple]:
    """The least (has an id, id, hash) of each of about `files` (at most MOST_PARTS) ranges of equal size but the first."""
    if files <= 1:
        return []
    ranges = marks.select("doc_id", "hash").repartitionByRange(files, F.col("doc_id").asc_nulls_first(), "hash")
    least = ranges.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("a"), F.coalesce("doc_id", F.lit(0)).alias("b"), "hash")).alias("x"))
    return sorted(tuple(r["x"]) for r in least.collect())[1:]


def write(docs: DataFrame, tokenizer_path: str, end_id: int, place: str | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """Encodes `docs` and writes the files; a table (file, path, n_docs, n_ids) of them, in order by `file`.  Rows are dealt
    by ranges of doc_id and, within one, of the text's hash, so that rows without an id or with one id share no task."""
    spark = docs.sparkSession
    place = place or fresh_path(spark, "tokens")
    docs = columns_for(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    marks = materialise(docs.select("doc_id", "hash", F.octet_length("text").alias("size")), "token-marks")
    parts = max(1, min(MOST_PARTS, -(-(marks.agg(F.sum("size")).first()[0] or 0) // part_bytes)))
    bounds = _bounds(marks, parts)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path, end_id)
        kind = "<u2" if own.width <= 16 else "<u4"
        for batch in batches:
            for at, to, w in textbatch.chunks(batch.column("text"), fold=False):
                part = batch.slice(at, to - at)
                ids, count = own.ids(w)
                ends = np.concatenate([[0], np.cumsum(count)]) * np.dtype(kind).itemsize
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(ids.astype(kind).tobytes())])
                doc_ids = part.column("doc_id").to_pylist()
                keys = zip(doc_ids, part.column("hash").to_pylist(), strict=True)
                buckets = [bisect.bisect_right(bounds, (i is not None, i or 0, h)) for i, h in keys]
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), part.column("doc_id"), part.column("hash"), packed.cast(pa.binary())], ["part", "doc_id", "hash", "ids"])

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path, end_id)
        kind = "<u2" if own.width <= 16 else "<u4"
        part, number, ids, packed, held = None, 0, [], [], 0

        def done() -> pa.RecordBatch:
            name = part << 20 | number
            path = f"{place}/{name:015d}.tbp"
            arrays = [np.frombuffer(x, kind) for x in packed]
            put(path, _file(ids, arrays, own.width))
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([path]), pa.array([len(ids)], pa.int64()), pa.array([sum(map(len, arrays))], pa.int64())], ["file", "path", "n_docs", "n_ids"])

        for batch in batches:
            for p, doc_id, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ids")), strict=True):
                if ids and (p != part or held + len(raw) > FILE_BYTES):
                    yield done()
                    number, ids, packed, held = number + 1 if p == part else 0, [], [], 0
                part = p
                ids.append(doc_id)
                packed.append(raw)
                held += len(raw)
        if ids:
            yield done()

    rows = docs.mapInArrow(encoded, "part long, doc_id long, hash long, ids binary")
    rows = rows.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "hash", "ids")
    return materialise(rows.mapInArrow(written, "file long, path string, n_docs long, n_ids long"), "token-files")


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    from pyspark.sql import Window

    # one short row for each file, not for each document; the running sum needs them in order
    starts = files.select("file", "path", (F.sum("n_ids").over(Window.orderBy("file")) - F.col("n_ids")).alias("before"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                r = Reader(get(path))
                raw, at = memoryview(r.all().astype("<u4").tobytes()), (4 * r.starts).tolist()
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(r.doc_ids, pa.int64()), pa.array(r.starts[:-1] + before, pa.int64()), pa.array(np.diff(r.starts), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = starts.repartition(max(1, min(files.count(), 4096)))  # a task for each file, which no setting folds into one
    return spread.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = 1, place: str | None = None) -> DataFrame:
    return read(write(docs, tokenizer_path, end_id, place))
