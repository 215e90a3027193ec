"""Arrays of texts, hashes of their words, and the shared folder."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U = np.uint64
#: An odd base for polynomial hashes modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}

SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(BASE))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and INVERSE**i for i < n, modulo 2**64."""
    if "n" not in _POWERS or _POWERS["n"].size < n:
        n = max(n, 1 << 16)
        for name, base in (("n", BASE), ("i", INVERSE)):
            steps = np.full(n, base, U)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["n"], _POWERS["i"]


def prefix_hashes(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of byte values times powers; span_hashes turns differences into hashes that don't depend on the place."""
    out = np.empty(data.size + 1, U)
    out[0] = 0
    np.cumsum(values[data] * powers(data.size + 1)[0][: data.size], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(sums.size)[1][starts] + (ends - starts).astype(U))


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and UTF-8 bytes; a null is an empty text."""
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def runs(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` bytes together, or one text each."""
    i, n = 0, offsets.size - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1))
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for every text the place of its first word (with one more at the end).

    ``apart`` marks bytes that part words; no word crosses from one text into the next.
    """
    inside = ~apart[data]
    opened, closed = inside.copy(), inside.copy()
    opened[1:] &= ~inside[:-1]
    closed[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < data.size)]
    opened[edges] = inside[edges]
    closed[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(opened), np.flatnonzero(closed) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words, A-Z as a-z, and for every text the place of its first word."""
    starts, ends, first = word_spans(data, offsets, apart)
    if not starts.size:
        return np.zeros(0, U), first
    return span_hashes(prefix_hashes(data, BYTE_VALUES[LOWER]), starts, ends), first


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles; with fewer words, of the whole sequence; with none, nothing."""
    if not words.size:
        return words
    m = min(n, words.size)
    h = np.full(words.size - m + 1, m, U)
    for i in range(m):
        h = mix(h * U(BASE) + words[i : words.size - m + 1 + i])
    return np.unique(h)


def pack(keys: np.ndarray) -> bytes:
    """Sorted integers as differences, byte plane by byte plane, so that a later compression finds the zeros."""
    steps = np.diff(keys, prepend=U(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U).ravel())


def trim() -> None:
    """Give freed memory back: workers are used again, and what they hold counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one that the cluster names is never replaced.

    Without one, a local session gets a folder of its own, which goes when the session ends; on a cluster that is an
    error, as a folder of one machine's is not seen by others.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="rhoscope-"))
    return context.getCheckpointDir()


def _path(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


#: Spark removes what an action has shuffled as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """The same rows, as a table in the shared folder: later steps don't repeat earlier work, nor do lost executors.

    The shuffles that made them are removed at once; the table goes with ``discard``, or when the driver ends.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/rhoscope"
    fs, root = _path(spark, folder)
    fs.deleteOnExit(root)
    before, path = spark.conf.get(CLEANUP, "false"), f"{folder}/{uuid.uuid4()}"
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove tables that ``settled`` has written and nothing reads any more."""
    for df in frames:
        fs, path = _path(df.sparkSession, df._settled_at)
        fs.delete(path, True)
