"""Vectorised word access over Arrow string columns, in blocks of bounded bytes.

A word is a maximal run of `[^\\x20\\x09-\\x0D]` in UTF-8; those separators are single bytes, so
splitting bytes and splitting code points agree. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch; bytes of text that a kernel takes at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20
BLOCK_BYTES = (1 << 20) - 1
#: Ranges above so many bytes are hashed by a digest.
LONG_RANGE = 1 << 14
_BASE, _SEED = 0x9E3779B97F4A7C15, 0x5851F42D4C957F2D
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A batch function that gives its memory back to the system when its task is done: Python workers outlive
    tasks, and what they hold counts against the executor in the stages after. Bounds the batches of the
    active session by rows and bytes, as texts may be long."""
    if (spark := SparkSession.getActiveSession()) is not None:
        rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "0"))
        if not 0 < rows <= BATCH_ROWS:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    @wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return inner


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, row offsets from 0) of a string column; nulls are empty."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(column):
        return raw[:0], np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batch of at most `most` bytes of text each, or one row."""
    _, offsets = string_buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: a bijection on 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values in order; sorting beats the hashing of np.unique by far."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def range_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes [start, end): equal content gives equal hashes wherever it stands.

    Eight bytes at a time go through a bijection, so no structure of the bytes cancels out as in a polynomial
    modulo 2^64; ranges of more than LONG_RANGE bytes are digested by BLAKE2. Callers that need equality, not a
    place to meet, compare the bytes.
    """
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    left = end - start
    h = mix64(left.astype(np.uint64) * np.uint64(_BASE) + np.uint64(_SEED))
    long_ = np.flatnonzero(left > LONG_RANGE)
    for k in long_.tolist():
        h[k] = int.from_bytes(hashlib.blake2b(raw[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    at = np.flatnonzero((left > 0) & (left <= LONG_RANGE))
    place, left = start[at], left[at]
    while len(at):
        part = eight[place]
        short = left < 8
        part[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        h[at] = mix64(h[at] ^ part)
        more = np.flatnonzero(left > 8)
        at, place, left = at[more], place[more] + 8, left[more] - 8
    return h


def gram_hash(raw: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every k bytes of raw, by doubling: two overlapping halves are mixed into a whole."""
    size, h = 1, raw.astype(np.uint64)
    while size * 2 <= k:
        a, b = h[:-size] if size < len(h) else h[:0], h[size:]
        h = a << np.uint64(8 * size) | b if size < 8 else mix64(a * np.uint64(_BASE) ^ b)
        size *= 2
    if size < k:
        a, b = h[: max(0, len(h) - (k - size))], h[k - size :]
        h = mix64(mix64(a + np.uint64(_SEED)) ^ b)
    return mix64(h + np.uint64(_SEED))


@dataclass
class Words:
    """Words of the rows of a block; row r owns words first[r]:first[r + 1]."""

    raw: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return range_hash(self.raw, self.start, self.end)


def words_of(column: pa.Array) -> Words:
    raw, offsets = string_buffers(column)
    inside = ~IS_SPACE[raw]
    before, after = np.zeros(len(raw) + 1, bool), np.zeros(len(raw) + 1, bool)
    before[1:], after[:-2] = inside, inside[1:]
    before[offsets] = False
    ends = offsets[offsets > 0] - 1
    after[ends] = False
    start = np.flatnonzero(inside & ~before[:-1])
    end = np.flatnonzero(inside & ~after[:-1]) + 1
    return Words(raw, offsets, start, end, np.searchsorted(start, offsets))


def shingle_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every n-word shingle in order; a row of 1 to n-1 words has one, of all its words."""
    h, counts = words.hashes(), words.counts
    total = np.zeros(len(h), np.uint64)
    for j in range(n):
        part = np.zeros(len(h), np.uint64)
        part[: max(0, len(h) - j)] = h[j:]
        total += part * np.uint64(pow(_BASE, 2 * j + 1, 1 << 64))
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(h)) - np.repeat(words.first[:-1], counts)
    full = place <= np.repeat(counts, counts) - n
    short = (place == 0) & ~full
    if short.any():
        for i in np.flatnonzero(short):
            own = h[i : words.first[row[i] + 1]]
            total[i] = np.uint64(sum(int(x) * pow(_BASE, 2 * j + 1, 1 << 64) for j, x in enumerate(own)) + len(own) & (1 << 64) - 1)
    keep = full | short
    return row[keep], mix64(total[keep])
