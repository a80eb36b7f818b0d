"""Sources by declared name: what is read is declared, never inferred, and what is missing is named."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_loaders: dict[str, Callable[..., DataFrame]] = {}


def loader(name: str) -> Callable:
    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _loaders[name] = f
        return f

    return register


def load(spark: SparkSession, name: str, **options: object) -> DataFrame:
    """The loader of that name; an unknown name is refused."""
    if name not in _loaders:
        raise KeyError(f"no loader {name!r}; there are {sorted(_loaders)}")
    return _loaders[name](spark, **options)


def required(df: DataFrame, *columns: str) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


@loader("parquet_one_file")
def parquet_one_file(spark: SparkSession, path: str, columns: list[str], where: str | None = None) -> DataFrame:
    """Declared columns; the condition reaches the scan."""
    df = required(spark.read.parquet(path), *columns)
    return (df.where(where) if where else df).select(*columns)


@loader("parquet_per_sample")
def parquet_per_sample(spark: SparkSession, pattern: str, columns: list[str]) -> DataFrame:
    """Files named by sample; `{sample}` in the pattern becomes the column sample_id."""
    before, _, after = pattern.partition("{sample}")
    df = required(spark.read.parquet(before + "*" + after), *columns)
    name = F.regexp_extract("_metadata.file_path", "([^/]*)" + after.replace(".", "[.]") + "$", 1)
    return df.select(*columns, F.substring(name, len(before.rsplit("/", 1)[-1]) + 1, 1 << 20).alias("sample_id"))


@loader("table_one_file")
def table_one_file(spark: SparkSession, path: str, schema: str, sep: str = "\t", key: str | None = None, strip_before: str | None = None) -> DataFrame:
    """A delimited table with a declared schema; `key` loses what comes up to and with the first `strip_before`."""
    df = spark.read.schema(schema).option("sep", sep).option("header", True).option("enforceSchema", False).csv(path)
    return df.withColumn(key, F.expr(f"substring({key}, instr({key}, '{strip_before}') + 1)")) if key and strip_before else df


@loader("npy_with_index")
def npy_with_index(spark: SparkSession, matrices: str, index: DataFrame, name: str = "vec") -> DataFrame:
    """Rows of .npy matrices joined by (file, row) to an index with columns file, row and keys; a row on one side only is
    an error that names the count."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                m = np.load(io.BytesIO(content), allow_pickle=False).astype(np.float32)
                for at in range(0, len(m), 4096):
                    part = m[at : at + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[-1]] * len(part)), pa.array(np.arange(at, at + len(part))), pa.array(part.tolist(), pa.list_(pa.float32()))], ["file", "row", name])

    found = spark.read.format("binaryFile").load(matrices).select("path", "content").mapInArrow(rows, f"file string, row long, {name} array<float>")
    both = index.join(found, ["file", "row"], "full_outer")
    return both.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.lit("the index has a row that no matrix has"))).otherwise(F.col(name)))


def samples(assays: list[DataFrame]) -> DataFrame:
    """Samples that every assay has, in order."""
    out = assays[0].select("sample_id").distinct()
    for a in assays[1:]:
        out = out.intersect(a.select("sample_id").distinct())
    return out.orderBy("sample_id")


def write_manifest(df: DataFrame, path: str) -> None:
    """Parquet beside a one-row JSON manifest of its schema and count."""
    df.write.mode("overwrite").parquet(path)
    n = df.sparkSession.read.parquet(path).count()
    df.sparkSession.createDataFrame([(path, df.schema.simpleString(), n)], "path string, schema string, rows long").coalesce(1).write.mode("overwrite").json(path + ".manifest")
