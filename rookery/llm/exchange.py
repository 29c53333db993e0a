"""Hash exchanges of packed numpy arrays.

Where one row per word or n-gram would swamp a shuffle, a task packs its
entries for each partition into one binary row: sorted keys as deltas, byte
planes apart, compressed. The reducing side unpacks a partition at once.
"""

from __future__ import annotations

import contextlib
import ctypes
import struct
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_KINDS = ("|u1", "|i1", "<u2", "<i2", "<u4", "<i4", "<u8", "<i8", "<f4", "<f8")


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays of numbers as bytes: a head of 10 bytes and its name for each, then each one's byte planes, compressed."""
    head, body = [struct.pack("<B", len(arrays))], []
    c = zstandard.ZstdCompressor(level=1)
    for name, x in arrays.items():
        x = np.ascontiguousarray(x)
        raw = c.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()) if len(x) else b""
        n = name.encode()
        head.append(struct.pack("<BBII", len(n), _KINDS.index(x.dtype.str), len(x), len(raw)) + n)
        body.append(raw)
    return b"".join([*head, *body])


def unpack(data: bytes) -> dict[str, np.ndarray]:
    """What pack() was given."""
    heads, at = [], 1
    for _ in range(data[0]):
        n, kind, length, size = struct.unpack_from("<BBII", data, at)
        heads.append((data[at + 10 : at + 10 + n].decode(), np.dtype(_KINDS[kind]), length, size))
        at += 10 + n
    out = {}
    d = zstandard.ZstdDecompressor()
    for name, kind, length, size in heads:
        if length:
            planes = np.frombuffer(d.decompress(data[at : at + size]), np.uint8)
            out[name] = np.ascontiguousarray(planes.reshape(kind.itemsize, length).T).reshape(-1).view(kind)
        else:
            out[name] = np.zeros(0, kind)
        at += size
    return out


def deltas(sorted_keys: np.ndarray) -> np.ndarray:
    """Differences of ascending keys, in 4 bytes where they fit."""
    d = np.diff(sorted_keys, prepend=np.uint64(0)).astype(np.uint64)
    return d.astype(np.uint32) if not len(d) or d.max() < 1 << 32 else d


def undeltas(d: np.ndarray) -> np.ndarray:
    return np.cumsum(d.astype(np.uint64), dtype=np.uint64)


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    return start, np.diff(np.append(start, len(sorted_keys)))


def bytes_of(df: DataFrame) -> int:
    """Catalyst's estimate of a frame's bytes, or 0 where it has none."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 60 else 0


def parts_for(df: DataFrame, bytes_each: int) -> int:
    """Partitions for an exchange: by the estimated input, and at least the session's own setting."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(4, min(least, 64), -(-bytes_of(df) // bytes_each))


#: Folders written in this driver, for those that are to be deleted with their scratch().
_folders: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the shared place the session names in spark.checkpoint.dir.

    Where that is unset, a local session (tests) uses a folder beside the
    warehouse; on a cluster that would be each machine's own, so it is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: it has to name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
    _folders.append(f"{base.rstrip('/')}/rookery-{uuid.uuid4().hex}")
    return _folders[-1]


def written(df: DataFrame, name: str = "t", codec: str = "snappy") -> DataFrame:
    """The frame, written to the shared folder and read again: lineage ends here. codec: zstd halves what holds texts."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if folder in _folders:
        _folders.remove(folder)


def dropped(*frames: DataFrame) -> None:
    """Deletes the files of written() frames that nothing reads any more."""
    for df in frames:
        for f in {x.rsplit("/", 2)[0] for x in df.inputFiles()}:
            _delete(df.sparkSession, next((own for own in _folders if f.endswith(own.rsplit("/", 1)[1])), f))


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end all that was written inside; what is to stay has to be written elsewhere by then."""
    known = set(_folders)
    try:
        yield
    finally:
        for f in [f for f in _folders if f not in known]:
            _delete(spark, f)


#: Bytes of an Arrow batch of texts.
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """The frame; where the user has not set how many bytes Arrow batches hold, 8 MB instead of 64, as a task holds several copies of one.

    The number of rows a batch, which other queries may rely on, is left alone.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not df.sparkSession._jsparkSession.sessionState().conf().contains(name):
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library of another system
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(run):
    """A function over a task's batches that gives freed memory back at its end: Spark keeps workers for later tasks, and what they hold until then counts."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped


def trimmed_group(run):
    """The same for a function over a group's table."""

    def wrapped(table):
        try:
            return run(table)
        finally:
            _give_back()

    return wrapped


#: Rows of 8 to 32 bytes up to which a written side is broadcast (32 MB); beyond, Catalyst shuffles both.
SMALL_ROWS = 1_000_000


def small_side(df: DataFrame) -> DataFrame:
    """A narrow written frame, with a broadcast hint if it is counted and small."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def with_row_key(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """__id, __text and __key: 64 bits over both, so equal rows are one document.

    Rows of the same id with other texts stay different documents. Of 10^11
    different rows about 270 pairs share their 64 bits.
    """
    return small_batches(df).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).withColumn("__key", F.xxhash64(F.col("__id"), F.col("__text")))
