"""Helpers shared by the corpus operators: session set-up, batch slicing, hashing, cut points."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import hashlib
import os
import re
import secrets
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: UTF-8 bytes of text handled at once inside a Python worker. A single longer text is handled alone.
CHUNK_BYTES = 2_000_000
#: Rows of one Arrow batch; keeps a batch of long texts far below a worker's memory.
BATCH_ROWS, BATCH_BYTES = "512", "4m"
_ROOT = str(Path(__file__).resolve().parents[2])
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and keep Arrow batches small."""
    environment = spark.sparkContext.environment
    environment.setdefault(SECRET, secrets.token_hex(8))
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only in local mode, where none is set (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or os.environ.get("CHRONOLITH_SHARED_DIR")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set; executors would write to folders of their own")
        found = os.environ["CHRONOLITH_SHARED_DIR"] = tempfile.mkdtemp(prefix="chronolith-shared-")
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts its lineage. What nobody discards before
    goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _TABLES.add(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.chronolith_path = path
    return out


def stage(run):
    """A pipeline stage ``run(spark, docs, sf_dir)``. As it begins, what earlier stages left in the shared folder goes:
    their results have been written by then."""

    @functools.wraps(run)
    def wrapped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for path in list(_LEFT):
            _delete(spark, path)
        before = set(_TABLES)
        out = run(spark, docs, sf_dir)
        _LEFT.update(_TABLES - before)
        return out

    return wrapped


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote; only once nothing reads it any more."""
    _delete(df.sparkSession, df.chronolith_path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _TABLES.discard(path)
    _LEFT.discard(path)


#: Tables of this session in the shared folder, and those of pipeline stages that have returned.
_TABLES: set[str] = set()
_LEFT: set[str] = set()


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``column`` holds about ``limit`` bytes (a long row stands alone)."""
    if batch.num_rows == 0:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as bytes, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two multiply-xorshift rounds), elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def trim() -> None:
    """Give freed memory back to the system; a worker shares an executor's limit with the JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """A batch function that gives memory back now and then and when its task ends: workers go on to other stages."""

    @functools.wraps(run)
    def wrapped(batches):
        for k, out in enumerate(run(batches)):
            yield out
            if k % 4 == 3:
                trim()
        trim()

    return wrapped


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of a sorted partition by their first ``keys`` columns: (key, rows without the key). Holds one run at a time."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files that nothing refers to any more (it does so when the driver's garbage is collected)."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


class HashIndex:
    """64-bit hashes to numbers, whole arrays at a time: open addressing, so that lookups are plain gathers."""

    def __init__(self, slots: int = 1 << 16) -> None:
        self.slots, self.count = slots, 0
        self.keys = np.zeros(slots, np.uint64)
        self.values = np.full(slots, -1, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for those not there."""
        slot = (h & np.uint64(self.slots - 1)).astype(np.int64)
        out = self.values[slot]
        away = np.flatnonzero((out >= 0) & (self.keys[slot] != h))
        while len(away):
            slot[away] = (slot[away] + 1) & (self.slots - 1)
            found = self.values[slot[away]]
            out[away] = found
            away = away[(found >= 0) & (self.keys[slot[away]] != h[away])]
        return out

    def insert(self, h: np.ndarray, numbers: np.ndarray) -> None:
        """Add distinct new hashes."""
        if 3 * (self.count + len(h)) > 2 * self.slots:
            held = self.values >= 0
            h, numbers = np.concatenate([self.keys[held], h]), np.concatenate([self.values[held], numbers])
            while 3 * len(h) > 2 * self.slots:
                self.slots *= 2
            self.keys = np.zeros(self.slots, np.uint64)
            self.values = np.full(self.slots, -1, np.int32)
            self.count = 0
        self.count += len(h)
        numbers = numbers.astype(np.int32)
        slot = (h & np.uint64(self.slots - 1)).astype(np.int64)
        while len(h):
            free = self.values[slot] < 0
            self.keys[slot[free]], self.values[slot[free]] = h[free], numbers[free]
            left = self.values[slot] != numbers
            h, numbers, slot = h[left], numbers[left], (slot[left] + 1) & (self.slots - 1)


#: Where workers find the number that words are hashed with: drawn by the driver for every run, the same for all workers,
#: and unknown to those who write the texts, so that nobody can make words that share a hash.
SECRET = "CHRONOLITH_SECRET"


@functools.cache
def secret() -> int:
    return int(os.environ.get(SECRET) or "0", 16)


#: Spans of more bytes are hashed one by one.
LONG_SPAN = 64
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def carried(h: np.ndarray, part: np.ndarray) -> np.ndarray:
    """A hash carried on by one more number; for a given hash, different numbers give different results."""
    return mix64(h * np.uint64(0x9E3779B97F4A7C15) + part)


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, key: int | None = None) -> np.ndarray:
    """64-bit hashes of spans of a text under the run's secret (or ``key``): eight bytes at a time, each mixed into what
    went before. Spans of one length up to eight bytes never collide, others by chance only."""
    key = secret() if key is None else key
    size = ends - starts
    words = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))  # the eight bytes from each place on
    h = mix64((size.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) ^ np.uint64(key))
    h = carried(h, words[starts] & _LOW_BYTES[np.minimum(size, 8)])
    for k in range(8, LONG_SPAN, 8):
        live = np.flatnonzero((size > k) & (size <= LONG_SPAN))
        if not len(live):
            break
        h[live] = carried(h[live], words[starts[live] + k] & _LOW_BYTES[np.minimum(size[live] - k, 8)])
    view = memoryview(data)
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(view[starts[i] : ends[i]], digest_size=8, key=key.to_bytes(8, "little")).digest(), "little")
    return h
