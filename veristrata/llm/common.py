"""Helpers that several operators share: Arrow batches and vectorised text scanning; tables come from the core."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..tables import discard, materialize, spare  # noqa: F401

#: The white space that separates words everywhere in this subpackage: 0x20 and 0x09 to 0x0D.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

#: Bytes of text that are scanned at once; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes in an Arrow batch at most (a longer row is a batch of its own): a task holds a few batches at once, in the JVM and in Python.
BATCH_ROWS, BATCH_BYTES = 2000, 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's rows and bytes per Arrow batch to BATCH_ROWS and BATCH_BYTES; lower settings stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(spark.conf.get(key).removesuffix("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def tidy() -> None:
    """Give freed memory back: Python workers live on between tasks, beside those of other operators."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) with small batches in, and memory given back at the end of each task."""
    bound_batches(df.sparkSession)

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return df.mapInArrow(tidied, schema)


# ---------------------------------------------------------------- vectorised text


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply); uint64 in, uint64 out."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
#: Keeps the first 0 to 8 bytes of a part.
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Parts of a span that are taken side by side with those of the other spans; longer ones follow on their own.
_SIDE = 8


def parts(buf: np.ndarray, lower: bool = False) -> np.ndarray:
    """The eight bytes from each place of a block on, as little-endian numbers; zeros follow its end. lower: A-Z as a-z."""
    data = np.zeros(len(buf) + 8, dtype=np.uint8)
    data[: len(buf)] = _LOWER[buf] if lower else buf
    return np.ndarray(len(buf) + 1, "<u8", data, strides=(1,))


def _further(starts: np.ndarray, sizes: np.ndarray):
    """For spans of over _SIDE parts: where each further part begins, its number, how many bytes of it count, and each span's first."""
    n = -(-sizes // 8) - _SIDE
    first = np.cumsum(n) - n
    number = np.arange(int(n.sum())) - np.repeat(first, n) + _SIDE
    return np.repeat(starts, n) + 8 * number, number, np.minimum(np.repeat(sizes, n) - 8 * number, 8), first


def span_hash(p: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span of parts()' p: the sum of its eight-byte parts, each mixed with its number.

    The parts are mixed before they are added, so no pattern of bytes cancels out, whatever its length. Other seeds give
    independent hashes.
    """

    def mixed(at, number, size):
        salt = mix(np.atleast_1d(np.asarray(number, dtype=np.uint64)) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        return mix((p[at] & KEEP[size]) ^ salt)

    sizes = ends - starts
    h = sizes.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    live = np.flatnonzero(sizes > 0)
    for k in range(_SIDE):
        if not len(live):
            return mix(h)
        h[live] += mixed(starts[live] + 8 * k, k, np.minimum(sizes[live] - 8 * k, 8))
        live = live[sizes[live] > 8 * (k + 1)]
    if len(live):
        at, number, size, first = _further(starts[live], sizes[live])
        h[live] += np.add.reduceat(mixed(at, number, size), first)
    return mix(h)


def same_spans(p: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the spans of these sizes that begin at a and at b hold the same bytes."""
    out = np.ones(len(a), dtype=bool)
    live = np.flatnonzero(sizes > 0)
    for k in range(_SIDE):
        keep = KEEP[np.minimum(sizes[live] - 8 * k, 8)]
        out[live] &= (p[a[live] + 8 * k] ^ p[b[live] + 8 * k]) & keep == 0
        live = live[sizes[live] > 8 * (k + 1)]
    if len(live):
        at, number, size, first = _further(a[live], sizes[live])
        other = at + np.repeat(b[live] - a[live], np.diff(np.append(first, len(at))))
        out[live] &= np.logical_and.reduceat((p[at] ^ p[other]) & KEEP[size] == 0, first)
    return out


def text_column(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column if pa.types.is_string(column.type) else column.cast(pa.string())


def blocks(column: pa.Array, size: int = 0):
    """Yields (first row, bytes, offsets) for runs of rows of about `size` bytes; null texts count as empty."""
    column = text_column(column)
    size = size or BLOCK_BYTES
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, and counts: words of row i are [counts[i], counts[i + 1])."""
    n = len(buf)
    space = _IS_SPACE[buf]
    begins = np.zeros(n + 1, dtype=bool)
    begins[offsets] = True
    word = ~space
    before = np.empty(n, dtype=bool)
    after = np.empty(n, dtype=bool)
    if n:
        before[0] = after[-1] = True
        before[1:] = space[:-1]
        after[:-1] = space[1:]
    starts = np.flatnonzero(word & (before | begins[:n]))
    ends = np.flatnonzero(word & (after | begins[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets, side="left")
