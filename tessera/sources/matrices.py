"""Matrices in .npy files as a data source of rows.

The planner reads each file's header and no more, and cuts it into ranges of rows of about SPLIT_BYTES, so that a large
sample is many tasks and a task holds one range.  A condition on sample_id leaves other samples' files unopened: equality
and IN reach the reader where the session pushes filters to Python sources (PUSHDOWN) and the option `push` is true, as
`read` sets it; the option `samples` says the same without that.  The option `columns` (first:last) reads that slice of each row.

    spark.dataSource.register(MatrixSource)
    spark.read.format("npy_matrices").option("path", place).option("samples", "a,b").load()   # sample_id, file, row, vec

Which unit a row belongs to is not in the file: `with_index` joins an index and refuses one whose counts differ.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SPLIT_BYTES = 32 << 20
BATCH_ROWS = 2048
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: A sample's name in a file's: all before the number of a part, if there is one.
SAMPLE = r"([^/]+?)(?:-part\d+)?\.npy$"


class Header:
    """What a .npy file says of itself: where its rows begin, how many there are, and of what."""

    __slots__ = ("dtype", "file", "offset", "path", "rows", "sample", "width")

    def __init__(self, system: pafs.FileSystem, path: str, sample: str):
        with system.open_input_file(path) as f:
            head = f.read(12)
            long = head[6:7] != b"\x01"
            size = int.from_bytes(head[8:12] if long else head[8:10], "little")
            f.seek(0)
            raw = BytesIO(f.read((12 if long else 10) + size))
        version = np.lib.format.read_magic(raw)
        shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(raw)
        if len(shape) != 2 or fortran or dtype.kind != "f":
            raise ValueError(f"{path}: not a matrix of floats in row order")
        self.path, self.file, self.sample = path, path.rsplit("/", 1)[-1], sample
        self.offset, (self.rows, self.width), self.dtype = raw.tell(), shape, dtype.str


def headers(uri: str, samples: Sequence[str] | None = None, pattern: str = SAMPLE) -> list[Header]:
    """The headers of a folder's matrices, of all samples or some, in order."""
    system, root = pafs.FileSystem.from_uri(uri)
    found = []
    for info in system.get_file_info(pafs.FileSelector(root, recursive=True)):
        name = re.search(pattern, info.path)
        if info.type == pafs.FileType.File and name and (samples is None or name.group(1) in samples):
            found.append((info.path, name.group(1)))
    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(lambda x: Header(system, *x), sorted(found)))


def samples(uri: str, pattern: str = SAMPLE) -> list[str]:
    """The samples that a folder has matrices of, in order."""
    system, root = pafs.FileSystem.from_uri(uri)
    return sorted({m.group(1) for x in system.get_file_info(pafs.FileSelector(root, recursive=True)) if (m := re.search(pattern, x.path))})


class Rows(InputPartition):
    """A range of rows of one file."""

    def __init__(self, path: str, file: str, sample: str, offset: int, width: int, dtype: str, first: int, last: int):
        super().__init__((path, first))
        self.path, self.file, self.sample, self.offset, self.width, self.dtype, self.first, self.last = path, file, sample, offset, width, dtype, first, last


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri, self.pattern = options["path"], options.get("pattern", SAMPLE)
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.wanted = set(options["samples"].split(",")) if "samples" in options else None
        a, _, b = options.get("columns", ":").partition(":")
        self.columns = slice(int(a) if a else None, int(b) if b else None)

    def partitions(self) -> Sequence[Rows]:
        out = []
        for h in headers(self.uri, self.wanted, self.pattern):
            step = max(1, self.split // max(1, h.width * np.dtype(h.dtype).itemsize))
            out += [Rows(h.path, h.file, h.sample, h.offset, h.width, h.dtype, a, min(a + step, h.rows)) for a in range(0, h.rows, step)]
        return out

    def read(self, part: Rows | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # a plan without ranges
            return
        system, _ = pafs.FileSystem.from_uri(self.uri)
        size = np.dtype(part.dtype).itemsize * part.width
        with system.open_input_file(part.path) as f:
            f.seek(part.offset + part.first * size)
            for at in range(part.first, part.last, BATCH_ROWS):
                n = min(BATCH_ROWS, part.last - at)
                raw = f.read(n * size)
                if len(raw) != n * size:
                    raise ValueError(f"{part.path} ends before its last row")
                m = np.frombuffer(raw, part.dtype).reshape(n, part.width)[:, self.columns].astype(np.float32)
                bounds = pa.array(np.arange(n + 1, dtype=np.int32) * m.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array([part.sample] * n), pa.array([part.file] * n), pa.array(np.arange(at, at + n)), pa.ListArray.from_arrays(bounds, pa.array(m.reshape(-1)))], ["sample_id", "file", "row", "vec"])


class PushingReader(MatrixReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes conditions on sample_id; the others stay with Spark."""
        for f in filters:
            names = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if names is None or f.attribute != ("sample_id",):
                yield f
            else:
                self.wanted = names if self.wanted is None else self.wanted & names


class MatrixSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_matrices"

    def schema(self) -> str:
        return "sample_id string, file string, row long, vec array<float>"

    def reader(self, schema: object) -> MatrixReader:
        return (PushingReader if self.options.get("push") == "true" else MatrixReader)(dict(self.options))


def read(spark: SparkSession, uri: str, wanted: Sequence[str] | None = None, **options: object) -> DataFrame:
    """(sample_id, file, row, vec) of a folder's matrices.  Conditions on sample_id are pushed to the reader if the session
    pushes filters to Python sources."""
    spark.dataSource.register(MatrixSource)
    reader = spark.read.format("npy_matrices").option("path", uri).option("push", spark.conf.get(PUSHDOWN, "false"))
    if wanted is not None:
        reader = reader.option("samples", ",".join(wanted))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def with_index(spark: SparkSession, uri: str, index: DataFrame, wanted: Sequence[str] | None = None, **options: object) -> DataFrame:
    """The matrices' rows with the columns of an index (file, row, ...).  Header counts are compared with the index's
    before anything is read, since a wrong index would silently permute vectors against units."""
    counts = spark.createDataFrame([(h.file, h.rows) for h in headers(uri, wanted)], "file string, rows long")
    # distinct rows within range as many as the file has: a bijection
    held = index.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row").alias("distinct"), F.min("row").alias("least"), F.max("row").alias("most"))
    bad = counts.join(held, "file", "left").where(~F.coalesce((F.col("n") == F.col("rows")) & (F.col("distinct") == F.col("rows")) & (F.col("least") == 0) & (F.col("most") == F.col("rows") - 1), F.col("rows") == 0))
    wrong = [f"{r['file']}: {r['rows']} vectors against {r['n'] or 0} rows" for r in bad.orderBy("file").limit(5).collect()]
    if wrong:
        raise ValueError("; ".join(wrong))
    rows = read(spark, uri, wanted, **options)
    return rows.join(index.drop("sample_id") if "sample_id" in index.columns else index, ["file", "row"])


def write(df: DataFrame, uri: str, key: str, order: str, vec: str = "vec", rows_in_file: int = 100_000) -> DataFrame:
    """Writes each key's vectors, in order, to .npy files of up to `rows_in_file` rows, and gives the index (sample_id,
    file, row, order).  Rows are dealt by key and block of rows, so that a large sample is many tasks."""
    from pyspark.sql import Window

    blocks = df.select(F.col(key).cast("string").alias("sample_id"), F.col(order).alias("__o"), F.col(vec).cast("array<float>").alias("vec"))
    sizes = blocks.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.ceil(F.col("n") / rows_in_file)
    dealt = blocks.join(sizes, "sample_id").withColumn("__b", F.pmod(F.xxhash64("__o"), n).cast("int")).drop("n")
    numbered = dealt.withColumn("row", (F.row_number().over(Window.partitionBy("sample_id", "__b").orderBy("__o")) - 1).cast("long"))
    named = numbered.withColumn("file", F.concat("sample_id", F.format_string("-part%05d.npy", "__b")))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, root = pafs.FileSystem.from_uri(uri)
        system.create_dir(root, recursive=True)
        name, held, rows = None, [], []

        def done() -> pa.RecordBatch:
            temporary, out = f"{root}/{name}.{uuid.uuid4().hex}.tmp", BytesIO()
            np.save(out, np.concatenate(held))
            with system.open_output_stream(temporary) as f:
                f.write(out.getvalue())
            system.move(temporary, f"{root}/{name}")
            return pa.concat_tables(rows).combine_chunks().to_batches()[0]

        for batch in batches:
            files = batch.column("file").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1).tolist(), len(files)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if name is not None and files[a] != name:
                    yield done()
                    held, rows = [], []
                name = files[a]
                part = batch.slice(a, b - a)
                held.append(np.asarray(part.column("vec").flatten()).reshape(b - a, -1))
                rows.append(pa.table({c: part.column(c) for c in ("sample_id", "file", "row", "__o")}))
        if held:
            yield done()

    kind = df.schema[order].dataType.simpleString()
    spread = named.repartition("sample_id", "__b").sortWithinPartitions("sample_id", "__b", "row").select("sample_id", "file", "row", "__o", "vec")
    from tessera.operators.tables import materialise

    return materialise(spread.mapInArrow(put, f"sample_id string, file string, row long, __o {kind}").withColumnRenamed("__o", order), "matrix-index")
