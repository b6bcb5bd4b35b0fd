"""Helpers that the operators share: scratch tables, text batches and a word cache."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at a time; a longer single text is a slice of its own.
SLICE_BYTES = 4 << 20
#: Rows that go to a Python worker at a time.
BATCH_ROWS = 1_000

_local_scratch: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is missing (local sessions, tests) is a temporary folder of this
    machine taken, and the setting is filled in so that every operator sees the same one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        folder = _local_scratch.setdefault(app, "file://" + tempfile.mkdtemp(prefix="shared-"))
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; the session's paths go when the driver ends."""
    root = f"{shared_folder(spark)}/scratch-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_remove, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


_roots: set[str] = set()


def _remove(spark: SparkSession, root: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may be gone already; the folder is scratch
        pass


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: no lineage, lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept on the executors' local disks, for tables that are cheap to compute again: a lost executor costs its parts.

    Unlike ``cut`` it writes no files through Hadoop, whose local file system starts two ``chmod`` processes for each.
    Spark takes what it keeps for any equal plan, even where the input has changed since; the token makes each plan its own.
    """
    return df.where(F.lit(uuid.uuid4().hex).isNotNull()).persist(StorageLevel.DISK_ONLY)


def map_batches(rows: DataFrame, run, schema) -> DataFrame:
    """``rows.mapInArrow(run, schema)`` in bounded memory.

    By default a batch has 10,000 rows whatever their size, and the JVM and the worker hold several; with long texts
    that has no useful bound, so the session's batches are made smaller.  A worker that has ended its task gives
    freed memory back, since it lives on for other tasks.
    """
    conf = rows.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def task(batches):
        yield from run(batches)
        give_back()

    return rows.mapInArrow(task, schema)


def give_back() -> None:
    """Freed memory to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_bytes(column: pa.Array) -> pa.Array:
    """A text column as UTF-8 bytes, nulls as empty."""
    return pc.fill_null(column.cast(pa.binary()), b"")


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES):
    """Parts of ``batch`` with about ``limit`` bytes of text each."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(text))
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values`` (rows); a run may be empty."""
    out = np.zeros((len(lengths), *values.shape[1:]), values.dtype)
    full = lengths > 0
    if full.any():
        starts = np.cumsum(lengths) - lengths
        out[full] = np.add.reduceat(values, starts[full], axis=0)
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(s, s + n)`` for each start and length."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def count_floor(counts: DataFrame, most: int) -> int:
    """The least count that at most ``most`` rows of ``counts(c)`` reach, from a histogram of bounded size."""
    step = F.floor(F.log2("c") * 16).cast("int")
    steps = sorted(((r["k"], r["n"], r["hi"]) for r in counts.groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max("c").alias("hi")).collect()), reverse=True)
    taken = 0
    for _, n, hi in steps:
        if taken + n > most:
            return hi + 1
        taken += n
    return 1


class Ids(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Pool:
    """Variable-length integer rows, one after the other, with vectorised look-up by row number."""

    def __init__(self, dtype):
        self.flat, self.used = np.zeros(1 << 16, dtype), 0
        self.start, self.size, self.rows = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.rows + len(sizes) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        new = slice(self.rows, self.rows + len(sizes))
        self.flat[self.used : self.used + len(flat)] = flat
        self.size[new] = sizes
        self.start[new] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.rows += len(sizes)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' values one after the other, and how many each has."""
        sizes = self.size[rows]
        return self.flat[ranges(self.start[rows], sizes)], sizes


class WordTable:
    """Numbers for words, kept between batches until ``limit`` words are known; then it starts anew.

    ``new`` is called with the words that a batch brings first, in the order of their numbers;
    ``reset`` is called when the table starts anew.  Memory stays bounded whatever the texts hold.
    """

    def __init__(self, split, new, reset, limit: int = 400_000):
        self.split, self.new, self.reset, self.limit, self.ids = split, new, reset, limit, Ids()

    def batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts one after the other, and the number of words of each text."""
        if len(self.ids) > self.limit:
            self.ids.clear()
            self.reset()
        known, get, parts = len(self.ids), self.ids.__getitem__, []
        for text in texts:
            words = self.split(text)
            parts.append(np.fromiter(map(get, words), np.int32, len(words)))
        if len(self.ids) > known:
            self.new(last_keys(self.ids, len(self.ids) - known))
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), lengths


def last_keys(d: dict, n: int) -> list:
    """The n keys that came last, in order."""
    return list(islice(reversed(d), n))[::-1]
