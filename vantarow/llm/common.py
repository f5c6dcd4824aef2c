"""Shared plumbing: durable intermediate tables, vectorised word hashing, packed column blocks."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these bytes (space and 0x09 to 0x0D).
WHITESPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Bytes of text that one vectorised step handles; longer texts are cut at white space.
STEP = 1 << 19
_ODD = 0x9E3779B97F4A7C15


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own in a local session that sets none."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.gettempdir()}/checkpoints/vantarow")
        base = spark.sparkContext.getCheckpointDir()
    return base


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: the table and its path, for :func:`remove`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    return written(df, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def most_frequent(counts: DataFrame, limit: int) -> DataFrame:
    """Rows of the largest ``n``, in whole classes of equal n (of similar n above 4096), at most ``limit`` of them.

    Only the sizes of classes, a few thousand rows, reach the driver; nothing is sorted.
    """
    kind = F.when(F.col("n") <= 4096, F.col("n").cast("long")).otherwise((4096 + F.floor(F.log2(F.col("n").cast("double")) * 8)).cast("long"))
    sizes = sorted(((r["kind"], r["count"]) for r in counts.groupBy(kind.alias("kind")).count().collect()), reverse=True)
    cut, total = 1 << 40, 0
    for value, size in sizes:
        total += size
        if total > limit:
            break
        cut = value
    return counts.where(kind >= cut)


def lean(task: Callable) -> Callable:
    """For functions over Arrow batches: give freed memory back at the end, as workers outlive their tasks."""

    @wraps(task)
    def run(batches, *args, **settings):
        try:
            yield from task(batches, *args, **settings)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass

    return run


def partitions(spark: SparkSession) -> int:
    """Column blocks of a matrix product or hash index: as many as the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def even_keys(spark: SparkSession, parts: int) -> np.ndarray:
    """One key for each of ``parts`` partitions, in their order: dealt by these, each task of a repartition gets one block.

    Hashes of the numbers 0 to ``parts`` - 1 themselves would leave a third of the tasks empty and others with several.
    """
    to = F.pmod(F.hash("id"), F.lit(parts))
    found = spark.range(0, parts * 32, 1, 1).groupBy(to.alias("part")).agg(F.min("id").alias("key")).collect()
    keys = np.arange(parts, dtype=np.int64) + parts * 32
    for row in found:
        keys[row["part"]] = row["key"]
    return keys


@lru_cache(maxsize=8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    inverse = pow(_ODD, -1, 1 << 64)
    done = 1
    while done < n:
        take = min(done, n - done)
        up[done : done + take] = up[:take] * np.uint64(pow(_ODD, done, 1 << 64))
        down[done : done + take] = down[:take] * np.uint64(pow(inverse, done, 1 << 64))
        done += take
    return up, down


@lru_cache(maxsize=8)
def _table(lower: bool) -> np.ndarray:
    """A random 64-bit value for each byte; with ``lower``, A-Z have those of a-z."""
    values = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        values[65:91] = values[97:123]
    return values


@lru_cache(maxsize=8)
def word_bytes(kind: str) -> np.ndarray:
    """Which bytes belong to words. plain: all but white space; alnum: ASCII letters and digits, and non-ASCII."""
    inside = np.ones(256, bool)
    inside[list(WHITESPACE)] = False
    if kind == "alnum":
        inside[:128] = [chr(i).isalnum() for i in range(128)]
    return inside


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all their bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def scan(data: np.ndarray, cuts: np.ndarray, lower: bool = False, kind: str = "plain") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of every word of ``data`` (bytes); no word spans a position in ``cuts``."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    inside = word_bytes(kind)[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    at = cuts[(cuts > 0) & (cuts < n)]
    first[at] = inside[at]
    last[at - 1] = inside[at - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(max(STEP * 2, 1 << (n - 1).bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_table(lower)[data] * up[:n], out=total[1:])
    return starts, ends, mix((total[ends] - total[starts]) * down[starts])


def _pieces(data: np.ndarray, kind: str) -> Iterator[tuple[int, int]]:
    """Cut one long text into steps at bytes outside words, so that memory per step stays bounded."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + STEP)
        if end < n:
            look = end
            while look < n:
                stop = min(n, look + STEP)
                gap = np.flatnonzero(~word_bytes(kind)[data[look:stop]])
                if len(gap):
                    look += int(gap[0])
                    break
                look = stop
            end = look
        yield at, end
        at = end


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def hashed_docs(column: pa.Array, lower: bool = False, kind: str = "plain", step: int = STEP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Groups of whole documents: first row, end row, word hashes of them all, and the offsets of rows in those."""
    data, offs = texts_of(column)
    row, n = 0, len(offs) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(offs, offs[row] + step, "right")) - 1)
        part = data[offs[row] : offs[to]]
        if to == row + 1 and len(part) > 2 * step:
            hashes = np.concatenate([scan(part[a:b], np.empty(0, np.int64), lower, kind)[2] for a, b in _pieces(part, kind)])
            yield row, to, hashes, np.array([0, len(hashes)], np.int64)
        else:
            cuts = offs[row : to + 1] - offs[row]
            starts, _, hashes = scan(part, cuts, lower, kind)
            yield row, to, hashes, np.searchsorted(starts, cuts, "left").astype(np.int64)
        row = to


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of ``n`` consecutive values (Karp-Rabin by doubling); position i starts at i."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    base = np.uint64(0xD6E8FEB86659FD93)
    done, width, power, out, shift = None, 1, base, hashes, 0
    left = n
    while left:
        if left & 1:
            done, shift = (out, width) if done is None else (done[: max(0, len(out) - shift)] * power_of(base, width) + out[shift : shift + len(done)], shift + width)
        left >>= 1
        if left:
            out = out[:-width] * power_of(base, width) + out[width:]
            width *= 2
    return done[: len(hashes) - n + 1]


def power_of(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def window_rows(offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which positions start a window of ``n`` inside one row, and the row of each such position."""
    counts = np.maximum(0, np.diff(offsets) - n + 1)
    rows = np.repeat(np.arange(len(counts)), counts)
    starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[:-1][rows]
    return starts, rows


def thin(values: np.ndarray) -> bytes:
    return zlib.compress(packed(values), 1)


def thick(raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), kind)


def owners(who: np.ndarray, names: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Of entries sorted by their rows ``who``: which rows have some, the names of those and how many; packed.

    Only rows that occur are named, so what a block repeats grows with its entries, not with the number of blocks.
    """
    some, counts = np.unique(who, return_counts=True)
    return thin(np.diff(some, prepend=0).astype(np.uint32)), thin(np.diff(names[some], prepend=names.dtype.type(0))), thin(counts.astype(np.uint32))


def owned(rows: bytes, names: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.cumsum(thick(rows, np.uint32)).astype(np.int64), np.cumsum(thick(names, np.int64)), thick(counts, np.uint32).astype(np.int64)


def flush_name(docs: np.ndarray, number: int) -> bytes:
    """Names what a task packed at once; the same if the task runs again, another one where another task has equal documents."""
    context = TaskContext.get()
    return xxhash.xxh3_128_digest(packed(docs) + f"{context.partitionId() if context else 0}/{number}".encode())


def packed(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def ints(values: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(values), kind)
