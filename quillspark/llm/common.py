"""Shared by the operators: durable intermediate tables and byte-level word hashing in numpy."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

SUB_BATCH_BYTES = 1 << 21


_private: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a private one of the application only where the session names none (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        app = spark.sparkContext.applicationId
        where = _private.setdefault(app, "") or tempfile.mkdtemp(prefix="quillspark-")
        _private[app] = where
    return where.rstrip("/")


def settle(df: DataFrame, files: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and outlives lost executors. files: at most so many."""
    path = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hold(df: DataFrame) -> DataFrame:
    """Keep df on the executors' disks while later jobs read it again; a lost part is computed again from its inputs.

    For small results between settled tables. They go with the session, or with spark.catalog.clearCache().
    """
    return df.persist(StorageLevel.DISK_ONLY)


def binary_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, end to end, and the offsets of its rows; null reads as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, "<i8")[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, "<i8")
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, most: int = SUB_BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each, one row at least, so that temporaries stay small."""
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks, and several share an executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # C libraries without it keep what they have
        ctypes.CDLL(None).malloc_trim(0)


def sub_batches(batches: Iterator[pa.RecordBatch], text: str, most: int = SUB_BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch in pieces of bounded text: (rows, bytes, offsets)."""
    for batch in batches:
        raw, bounds = binary_view(batch.column(batch.schema.get_field_index(text)))
        for lo, hi in slices(bounds, most):
            yield batch.slice(lo, hi - lo), raw[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
    give_back()


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD1342543DE82EF95)


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes stay."""
    return _LOWER[raw]


def word_spans(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes outside x20 and x09-x0D, cut at row bounds; and each row's first word number."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    ink = ~_SPACE[raw]
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = ink[:-1]
    edges = bounds[:-1]
    edges = edges[edges < len(raw)]
    before[edges] = False
    starts = np.flatnonzero(ink & ~before)
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = ink[1:]
    last = bounds[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


_BLOCK = 1 << 17
_UP, _DOWN = powers(_BLOCK + 1), powers(_BLOCK + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes, in blocks of whole words, so that temporaries stay small whatever the text's length."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        at = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, at + _BLOCK, "right")))
        size = int(ends[hi - 1]) - at
        up, down = (_UP, _DOWN) if size <= _BLOCK else (powers(size + 1), powers(size + 1, _DOWN[1]))
        # sums of byte times power up to each place: a word's polynomial is a difference of two, shifted down to its start
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE[raw[at : at + size]] * up[:size], out=sums[1:])
        a, b = starts[lo:hi] - at, ends[lo:hi] - at
        out[lo:hi] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        lo = hi
    return out


def shingle_sets(raw: np.ndarray, bounds: np.ndarray, words: int) -> list[np.ndarray]:
    """For each row, the sorted distinct hashes of its `words`-word shingles; a shorter row is one shingle, one without words none.

    Hashes have 63 bits, so that they sort alike as signed and as unsigned numbers.
    """
    starts, ends, rows = word_spans(raw, bounds)
    hashes = word_hashes(raw, starts, ends)
    n = len(hashes)
    rolled = np.zeros(max(n - words + 1, 0), np.uint64)
    for k in range(words):
        rolled += hashes[k : n - words + 1 + k] * powers(words + 1)[k + 1] if n >= words else rolled
    rolled = mix(rolled + np.uint64(words)) >> np.uint64(1)
    out = []
    for lo, hi in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if hi - lo >= words:
            out.append(np.unique(rolled[lo : hi - words + 1]))
        elif hi > lo:
            short = (hashes[lo:hi] * powers(words + 1)[1 : hi - lo + 1]).sum(dtype=np.uint64)
            out.append(mix(np.array([short + np.uint64(hi - lo)], np.uint64)) >> np.uint64(1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
