"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but the six ASCII white-space characters; ``bytes.split()`` gives the same words.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one key column (8 bytes each) up to which a set of keys may be broadcast; larger sets are joined by a shuffle.
BROADCAST_KEYS = 1_000_000

MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none (tests, local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: While a table is written: shuffle files go when the job ends, and Python gets batches of bounded bytes, however long the texts;
#: the reader's vectors hold fewer rows for the same reason.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 20), "spark.sql.parquet.columnarReaderBatchSize": "1024"}
#: Bytes of a row group of such a table: its writers and readers hold one in memory.
ROW_GROUP = 16 << 20
#: Rows of a batch that a task hands back at once.
HANDED = 1 << 16


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage with files that outlive any executor, and the disk holds one step's shuffle at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


#: What operators keep in a Python worker from task to task; each has ``clear``.
HELD: list = []


def trim() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own account
        pass


def give_back() -> None:
    """Empty all that operators keep in this worker, and return freed memory to the system: workers outlive tasks."""
    for x in HELD:
        x.clear()
    trim()


def released(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``task`` for ``mapInArrow``, with results in batches of bounded rows and ``give_back`` at its end, and before it for what others kept."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        try:
            for b in task(batches):
                if b.num_rows <= HANDED:
                    yield b
                else:
                    yield from (b.slice(at, HANDED) for at in range(0, b.num_rows, HANDED))
        finally:
            give_back()

    return run


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more; what was made of them has been written."""
    from pyarrow import fs

    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            try:
                store, at = fs.FileSystem.from_uri(path)
            except (ValueError, OSError, pa.ArrowInvalid):  # a store that only Spark reads keeps them until the folder is cleared
                continue
            store.delete_dir(at)


def small_keys(keys: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """``keys`` with a broadcast hint if it is counted to hold at most ``limit`` rows; otherwise as it is, for a shuffled join."""
    return F.broadcast(keys) if keys.limit(limit + 1).count() <= limit else keys


def words_of(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.clear()
        HELD.append(self)

    def clear(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64)))) for b in (self.base, self.inverse))


WORD_POWERS = Powers(0xD1342543DE82EF95)


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary array back to back, and the offset of each value; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if n and buffers[2] is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def groups_of(offsets: np.ndarray, size: int = 1 << 19):
    """Ranges of documents of about ``size`` bytes together (one document at least), so that numpy's temporaries stay small."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of back-to-back texts: each word's 64-bit hash, first byte, end, and the number of its document.

    A word is taken eight bytes at a time; each piece goes through a bijective finaliser together with what came before, so
    words of one length up to eight bytes never share a hash and longer ones share one by chance alone, whatever pattern
    they repeat.  Hashes of different seeds are independent of each other.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    inside = (data != 32) & ((data < 9) | (data > 13))
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    starts = offsets[:-1][offsets[:-1] < n]
    first[starts] = inside[starts]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = inside[ends]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return hashes_between(data, s, e, seed), s, e, np.searchsorted(offsets, s, side="right") - 1


def hashes_between(data: np.ndarray, s: np.ndarray, e: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes from each of ``s`` up to each of ``e``."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
    size = (e - s).astype(np.uint64)
    h = mix(size * np.uint64(0xA24BAED4963EE407) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1F83D9ABFB41BD6B) & MASK))
    who, at = np.arange(len(s)), s
    while len(who):
        left = e[who] - at
        piece = np.ascontiguousarray(eights[at]).view("<u8")[:, 0]
        short = left < 8
        piece = np.where(short, piece & ~(np.uint64(MASK) << (np.minimum(left, 7).astype(np.uint64) * np.uint64(8))), piece)
        h[who] = mix((h[who] ^ piece) * np.uint64(0x9FB21C651E98DF25) + np.uint64(0xD6E8FEB86659FD93))
        more = left > 8
        who, at = who[more], at[more] + 8
    return h
