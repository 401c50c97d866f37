"""Helpers that several operators share."""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the characters that part words.
SPACE = r"[\x20\x09-\x0D]+"
U64 = np.uint64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: a slice ends when its texts pass `limit` bytes, so memory follows
    the limit and the longest text, not the size of Arrow's batches."""
    for batch in batches:
        lengths = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(np.nan_to_num(np.array([len(x) if x is not None else 0 for x in lengths.cast(pa.binary()).to_pylist()], dtype=np.int64)))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def window_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive values: one for each start at which n values are left."""
    if len(values) < n:
        return np.empty(0, dtype=U64)
    out = np.zeros(len(values) - n + 1, dtype=U64)
    for k in range(n):
        out *= U64(0x9E3779B97F4A7C15)
        out ^= out >> U64(29)
        out += values[k : k + len(out)]
    return mix64(out)


class Words:
    """Numbers words as they come; each word also has a 64-bit hash that is the same in every process."""

    def __init__(self) -> None:
        from collections import defaultdict

        self.ids: defaultdict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__

    def of(self, words: list[bytes]) -> list[int]:
        return list(map(self.ids.__getitem__, words))

    def hashes(self) -> np.ndarray:
        import xxhash

        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.ids), dtype=U64, count=len(self.ids))


def give_back() -> None:
    """Memory that a finished task has freed goes back to the system: Python workers live on and would keep it."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def blocks_for(rows: int, each: int) -> int:
    return max(1, math.ceil(rows / each))


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.  Only where it is unset and the session runs in this one process, as in
    tests, a new one; on a cluster an unset folder is an error, since a driver's own folder would not be seen by executors."""
    import tempfile

    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local-cluster") and context.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        if folder is None:
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


class Tables:
    """Parquet tables of one run in the shared folder.  The lineage of what is saved ends there, and lost executors lose
    nothing of it; the shuffle files of the steps behind a table go when it is written.  Tables go when they are dropped,
    or else when the JVM ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        import uuid

        path = f"{shared_folder(self.spark)}/tables/{name}-{uuid.uuid4().hex}"
        was = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, was)
        where, files = self._at(path)
        files.deleteOnExit(where)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path, out
        return out

    def drop(self, *tables: DataFrame) -> None:
        """For tables that nothing will read again, not even after a lost executor."""
        for table in tables:
            where, files = self._at(self.paths.pop(id(table))[0])
            files.delete(where, True)

    def _at(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())


#: Spark's switch for dropping shuffle files as soon as the query that made them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    return Tables(df.sparkSession).save(df, name)
