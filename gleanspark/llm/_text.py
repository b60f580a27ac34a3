"""Vectorised work on whole Arrow text columns, shared by the operators.

Everything here sees raw UTF-8 bytes: a batch of texts is one byte array with
offsets, words are (start, end) pairs into it, and hashes are computed for all
words at once.  A text is never cut; a chunk holds whole texts only.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

U64 = np.uint64
#: Bytes of text handled at once by a Python worker (a longer text makes a chunk of its own).
CHUNK_BYTES = 4 << 20
#: Words longer than this are hashed one by one.
LONG_WORD = 512

WHITESPACE = np.zeros(256, bool)
WHITESPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All of ASCII but digits and letters (upper-case letters are folded first).
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Texts:
    """Whole texts as one byte array; nulls are empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rows: slice):
        self.data, self.offsets, self.rows = data, offsets, rows

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self, separators: np.ndarray) -> Words:
        data, offsets = self.data, self.offsets
        solid = ~separators[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        before = np.empty(len(data), bool)
        after = np.empty(len(data), bool)
        if len(data):
            before[0], before[1:] = False, solid[:-1]
            after[-1], after[:-1] = False, solid[1:]
        starts = np.flatnonzero(solid & (~before | first[:-1]))
        ends = np.flatnonzero(solid & (~after | first[1:])) + 1
        return Words(data, starts, ends, np.searchsorted(starts, offsets))


class Words:
    """Words of Texts: text i has words first[i] up to first[i + 1]."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray):
        self.data, self.starts, self.ends, self.first = data, starts, ends, first

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends, seed)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every output bit depends on every input bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes of all spans at a time."""
    padded = np.empty(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    padded[len(data) :] = 0
    eights = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    lengths = ends - starts
    h = mix(lengths.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(seed))
    todo, at = None, 0
    most = int(min(lengths.max(initial=0), LONG_WORD))
    while at < most:
        if at:
            todo = np.flatnonzero(lengths > at) if todo is None else todo[lengths[todo] > at]
        s, n = (starts, lengths) if todo is None else (starts[todo], lengths[todo])
        v = eights[s + at]
        v &= U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - np.minimum(n - at, 8).astype(U64) * U64(8))
        if todo is None:
            h = mix(h ^ v)
        else:
            h[todo] = mix(h[todo] ^ v)
        at += 8
    for i in np.flatnonzero(lengths > LONG_WORD):
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed & 0xFFFFFFFF)
    return h


def windows(h: np.ndarray, first: np.ndarray, size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of all runs of size words inside one text, and the index of each run's first word."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, U64), np.empty(0, np.int64)
    acc = h[:n].copy()
    for j in range(1, size):
        acc *= U64(base)
        acc += h[j : n + j]
    inside = np.zeros(len(h) + 1, np.int32)
    stops = np.maximum(first[1:] - size + 1, first[:-1])
    np.add.at(inside, first[:-1], 1)
    np.add.at(inside, stops, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1])[:n] > 0)
    return mix(acc[at]), at


def chunks(column: pa.Array, lower: bool = False, most: int = CHUNK_BYTES, rows: int = 1 << 16) -> Iterator[Texts]:
    """A string column as chunks of whole texts, at most so many rows in each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offs, body = column.buffers()
    if not len(column):
        return
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = min(i + rows, max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1))
        data = body[offs[i] : offs[j]]
        yield Texts(LOWER[data] if lower else data, offs[i : j + 1] - offs[i], slice(i, j))
        i = j


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of whole numbers by text."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def small_batches(spark) -> None:
    """Keep Arrow batches near 16 MB whatever the texts' lengths (a session may set its own)."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "4000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "16m")):
        try:
            if spark.conf.get(key, None) in (None, "10000", "-1", "64MB", "67108864b", "67108864", "9223372036854775807b", "9223372036854775807"):
                spark.conf.set(key, value)
        except Exception:  # a setting that this Spark doesn't have
            continue


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what a worker freed meanwhile goes back to the system every few batches and at the end, since workers
    live on through later stages."""
    for k, b in enumerate(batches):
        yield b
        if k % 8 == 7:
            give_back()
    give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def with_columns(df: DataFrame, keep: list[str], ddl: str) -> StructType:
    """The schema of the kept columns and those of ddl."""
    return StructType([*df.select(*keep).schema.fields, *StructType.fromDDL(ddl).fields])
