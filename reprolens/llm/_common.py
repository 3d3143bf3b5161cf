"""Shared pieces of the training-data operators: shared-folder materialisation,
row identity, and word tables computed with Arrow kernels instead of per-word
Python objects."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) a temporary folder
    is set instead.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(found)
        return found
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="reprolens-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once; later readers do not recompute it."""
    shared_dir(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint(eager=True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000):
    """What is computed inside goes to Python in Arrow batches of so many rows at most: rows
    here hold texts or sets, of which the default number would take much memory outside
    the heap of every task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(min(int(old), rows) if int(old) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


class Scratch:
    """Tables of one run, written as Parquet under the shared folder. Each can be deleted
    as soon as its successors stand; those that a lazy result still reads stay."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.made = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[str, str] = {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` written and read again; a table kept before under the name is deleted then."""
        old, self.made = self.paths.get(name), self.made + 1
        self.paths[name] = path = f"{self.base}/{self.made}-{name}"
        with small_batches(self.spark):
            df.write.parquet(path)
        if old:
            remove(self.spark, old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                remove(self.spark, self.paths.pop(name))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def least_count(counts: DataFrame, column: str, most: int) -> int:
    """The smallest count that at most ``most`` rows reach, from a histogram of at most
    some thousand classes: counts to 1,000 by themselves, larger ones by 1/32 of a doubling."""
    c = F.col(column).cast("double")
    group = F.when(c <= 1000, c).otherwise(1000 + F.floor(F.log2(c) * 32))
    total, least = 0, 1 << 62
    for r in counts.groupBy(group.alias("g")).agg(F.min(column).alias("low"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("low")).collect():
        total += r["n"]
        if total > most:
            break
        least = r["low"]
    return least


class Words:
    """Words of a batch of texts: ``codes`` index ``vocab``; text i owns
    ``codes[starts[i]:starts[i + 1]]``. Words are maximal runs of bytes other
    than space and 0x09-0x0D; A-Z is lower-cased first when ``lower``."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if lower:
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(texts)
        ends = np.asarray(lists.offsets).astype(np.int64)
        flat = lists.flatten()
        first = ends[0]
        coded = flat.dictionary_encode()
        codes = np.asarray(coded.indices).astype(np.int64)
        vocab = coded.dictionary
        # leading and trailing separators leave empty strings behind
        empty = np.flatnonzero(np.asarray(pc.equal(vocab, "")))
        starts = ends - first
        if len(empty):
            real = codes != empty[0]
            kept = np.concatenate([[0], np.cumsum(real)])
            starts = kept[starts]
            codes = codes[real]
        self.codes, self.starts, self.vocab = codes, starts, vocab

    def __len__(self) -> int:
        return len(self.starts) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.counts)


def assemble(parts: list[bytes], codes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Arrays of unsigned 32-bit ids: the i-th is the parts of ``codes[starts[i]:starts[i + 1]]`` in a row."""
    return gather(np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4, codes, starts)


def gather(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """``assemble`` of parts that lie one after the other in ``flat``, part i with ``sizes[i]`` ids."""
    first = np.cumsum(sizes) - sizes
    n = sizes[codes]
    ends = np.concatenate([[0], np.cumsum(n)])
    out = flat[np.repeat(first[codes] - ends[:-1], n) + np.arange(ends[-1])]
    bounds = ends[starts].tolist()
    return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def bytes_hash(values: pa.Array) -> np.ndarray:
    """Stable 64-bit hash of each string (the same in every process)."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(v) for v in values.cast(pa.large_binary()).to_pylist()), np.uint64, len(values))


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser (fixed constants), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def blocks(batches, max_bytes: int = 2 << 20):
    """Arrow batches cut into parts of about ``max_bytes`` (one row at least).

    Parts are copies: some Arrow string kernels misread arrays whose first offset
    is not zero, as a slice's may be.
    """
    for b in batches:
        if not b.num_rows:
            continue
        rows = max(1, int(b.num_rows * max_bytes / max(b.nbytes, 1)))
        for at in range(0, b.num_rows, rows):
            n = min(rows, b.num_rows - at)
            yield b if n == b.num_rows else b.take(pa.array(np.arange(at, at + n)))


def release() -> None:
    """Give freed memory back at the end of a task: Spark keeps its Python workers, idle
    ones too, and what they hold counts against the executor."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def quiet_threads() -> None:
    """One native thread for each task: Spark already runs a task per core."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
