"""Shared plumbing of the training-data operators: tables in the shared folder and Arrow batch helpers."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that separate words, in every contract of this subpackage: blank, tab, line feed, VT, FF, CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
TOKENIZER_DIR = "/opt/tokenizers"


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file is, on any machine; names with a folder are taken as they are."""
    if os.path.dirname(name):
        return name
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join(TOKENIZER_DIR, name)
    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``. Where that is unset, a folder below the
    warehouse, which is shared, too; never a machine's own temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return base if ":/" in base else "file://" + os.path.abspath(base)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/ledgerloom/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_files(df: DataFrame) -> None:
    """Delete the files of a table made by ``materialise`` once nothing reads it any more."""
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/ledgerloom/" in name:
            delete_path(df.sparkSession, name)


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Each query within deletes its shuffle files when it ends (Spark 4.1 or later), not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Bucketed:
    """A table in the shared folder whose files are dealt by a key, so that joins on the key don't shuffle it. ``fn`` is applied to the
    batches after they are dealt."""

    def __init__(self, df: DataFrame, key: str, buckets: int, label: str, fn=None, schema: str | None = None):
        self.spark, self.path = df.sparkSession, fresh_path(df.sparkSession, label)
        self.name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
        dealt = df.repartition(buckets, key)
        dealt = dealt if fn is None else dealt.mapInArrow(fn, schema)
        dealt.write.option("compression", "zstd").option("path", self.path).bucketBy(buckets, key).sortBy(key).saveAsTable(self.name)
        self.rows = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete_path(self.spark, self.path)


def stored_at(df: DataFrame) -> str:
    """The folder of a table made by ``materialise``."""
    return df.inputFiles()[0].rpartition("/")[0]


@lru_cache(1)
def sorted_table(path: str, columns: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """A stored table of integers, sorted by its first column, kept by the worker: for tables whose size the caller has checked."""
    store, top = pa.fs.FileSystem.from_uri(path)
    files = [f.path for f in store.get_file_info(pa.fs.FileSelector(top)) if f.base_name.startswith("part-")]
    parts = [pa.parquet.read_table(f, columns=list(columns), filesystem=store) for f in files]
    found = [np.concatenate([p.column(c).to_numpy() for p in parts]) for c in columns]
    order = np.argsort(found[0])
    return tuple(x[order] for x in found)


class Scratch:
    """Tables of one operator's run: ``save`` writes one, ``drop`` deletes them all once their answers are written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def save(self, df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
        path = fresh_path(self.spark, label)
        self.paths.append(path)
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for path in self.paths:
            delete_path(self.spark, path)
        self.paths = []

    def finish(self, df: DataFrame, label: str) -> DataFrame:
        """The result, written; the tables that it was made from go."""
        out = materialise(df, label)
        self.drop()
        return out


def integer_id(df: DataFrame, id_col: str) -> Column:
    """The id as a long; ids of other types than integers are refused, as the results carry integers."""
    kind = df.schema[id_col].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise ValueError(f"ids have to be integers, {id_col} is {kind.simpleString()}")
    return F.col(id_col).cast("long")


def total_bytes(df: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of a text column over all rows; one number reaches the driver."""
    return int(df.agg(F.sum(F.octet_length(text_col)).alias("b")).first()["b"] or 0)


def split_of(id_col: str, modulus: int = 5) -> Column:
    """crc32 of the id in decimal, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def replace_columns(df: DataFrame, *names: str) -> DataFrame:
    """The input without columns that an operator is about to add, in whatever case they are written: its own outputs win."""
    return df.drop(*names)  # Spark's own comparison of names, which may ignore case


def free_name(columns, name: str) -> str:
    """A name like the given one that no column has, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null text counts as empty."""
    return [b if b is not None else b"" for b in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], text_col: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` text bytes at most (a longer text stands alone), so memory stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pa.compute.binary_length(batch.column(text_col)).fill_null(0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(size) - size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()  # workers are kept for later tasks


def list_array(values: np.ndarray, lengths, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each row."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
