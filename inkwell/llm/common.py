"""Shared plumbing: written tables in the cluster's shared folder, and text helpers."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that setting is absent on one machine (a local master, as in
    tests) a temporary folder is made and set for the rest of the session; on a
    cluster its absence is an error, as executors would write to their own disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="inkwell-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Rows and bytes of a batch that Python gets at once: texts may be long.  A longer row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of Arrow batches, unless the session already does more tightly."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    said = spark.conf.get(key, "64m").lower()
    unit = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    digits, rest = said.rstrip("bkmgi"), said.lstrip("-0123456789")
    if not 0 < int(digits) * unit.get(rest[:1], 1) <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def trim() -> None:
    """Give freed memory back: workers live on between tasks, beside others on the same machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Scratch:
    """Written intermediate tables.  A table cuts the lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def cut(self, df: DataFrame) -> DataFrame:
        """Write df as Parquet and return the written table."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables that nothing reads any more."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(conf).delete(path, True)


#: Rows for each task that writes a table of known size, if there are more than one for each core.
PART_ROWS = 100_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """df in no more partitions than ``rows`` rows call for, and at least one for each core.

    Each file that a task writes to a local file system starts processes that set its permissions.  For a moment such a
    process has the executor's memory as its own, so hundreds of tiny files cost time, and the executor seems twice its size.
    """
    return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism, -(-rows // PART_ROWS)))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores after it as keep it apart from the taken ones (columns are told apart without case)."""
    have, out = {t.lower() for t in taken}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def lowest(df: DataFrame, n: int, key: str) -> DataFrame:
    """The rows with the n lowest values of a narrow key: only keys are sorted, wide rows stay where they are."""
    line = df.select(key).distinct().orderBy(key).limit(n).agg(F.max(key)).first()[0]
    return df.limit(0) if line is None else df.where(F.col(key) <= line)


def as_binary(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batches, rows: int = 512, bytes_: int = 4 << 20, text: str = "text"):
    """Batches cut so small that a few hundred times the memory of one text is never needed."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = 0
        while start < batch.num_rows:
            ends = np.cumsum(size[start : start + rows])
            n = max(1, int(np.searchsorted(ends, bytes_, side="right")))
            n = min(n, rows, batch.num_rows - start)
            yield batch.slice(start, n)
            start += n
    trim()


def flat_words(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text of a column: offsets per text, index of each word, and the distinct words.

    ``lower`` maps A-Z only.  Null has no words.
    """
    column = column.fill_null("")
    if lower:
        column = pc.ascii_lower(column)
    lists = pc.ascii_split_whitespace(column)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    offsets = offsets - offsets[0]
    real = pc.not_equal(pc.binary_length(flat), 0)
    if not pc.all(real, min_count=0).as_py():
        keep = real.to_numpy(zero_copy_only=False)
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        flat = flat.filter(real)
    coded = flat.dictionary_encode()
    return offsets, coded.indices.to_numpy(), coded.dictionary


def word_hashes(words: pa.Array) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (murmur3's constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
