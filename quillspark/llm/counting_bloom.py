"""Counting Bloom filters over digests, merged segment by segment: which rows may have a twin.

Every chunk of rows counts its slots (a row counts a slot once) and sends them to the segments that own them. A segment adds the
sketches of all chunks up, with counters that stop at two, and sends back one bit for each slot that a chunk asked for: hit twice or
not. A row whose slots are not all hit twice is the only one of its digest. A digest that a third of all rows share costs a
segment three slots for each chunk, and nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, hold

CHUNK_ROWS = 50_000
SEGMENT_KEYS = 1 << 20
SLOTS_PER_KEY = 8
PROBES = 3
LEAST_SEGMENTS = 16


def _pack(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for b in batches:
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def chunked(rows: DataFrame) -> DataFrame:
    """(chunk, data): rows in compressed Arrow streams of about CHUNK_ROWS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        tag, number, held, size = (context.partitionId() if context else 0) << 32, 0, [], 0
        give = lambda: pa.RecordBatch.from_arrays([pa.array([tag | number]), pa.array([_pack(held)], pa.binary())], ["chunk", "data"])
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= CHUNK_ROWS:
                yield give()
                held, size, number = [], 0, number + 1
        if held:
            yield give()

    return rows.mapInArrow(run, "chunk long, data binary")


def _slots(keys: pa.ChunkedArray, segments: int, width: int) -> np.ndarray:
    """The places of each digest's probes as a matrix; those of one digest lie in one segment of `width` slots."""
    raw = np.frombuffer(b"".join(x[:32] for x in keys.to_pylist()), "<u8").reshape(-1, 4)
    base = (raw[:, 0] % np.uint64(segments)) * np.uint64(width)
    return np.stack([base + (raw[:, 1] + np.uint64(k) * (raw[:, 2] | np.uint64(1))) % np.uint64(width) for k in range(PROBES)], 1)


def _sketch(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots in order, and which of them several rows hit."""
    own = np.sort(slots, 1)
    fresh = np.ones(own.shape, bool)
    fresh[:, 1:] = own[:, 1:] != own[:, :-1]
    each, n = np.unique(own[fresh], return_counts=True)
    return each, n > 1


def flag_possible_repeats(rows: DataFrame, key: str, least_segments: int = LEAST_SEGMENTS, segment_keys: int = SEGMENT_KEYS) -> DataFrame:
    """rows with `again`: true wherever another row has the same digest (32 bytes) in column key, and for a few others.

    rows is a settled table of narrow rows: it is read more than once, and its rows are dealt to chunks once.
    """
    spark = rows.sparkSession
    total = rows.count()
    segments = max(least_segments, -(-total // segment_keys))
    width = 1 << max(10, int(np.ceil(np.log2(max(1, SLOTS_PER_KEY * total / segments)))))
    chunks = hold(chunked(rows).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                each, many = _sketch(_slots(_unpack(data)[key], segments, width))
                owner = (each // np.uint64(width)).astype(np.int64)
                edges = np.r_[0, np.flatnonzero(np.diff(owner)) + 1, len(owner)].tolist()
                out = [(int(owner[lo]), chunk, (each[lo:hi] % np.uint64(width)).astype("<u4").tobytes(), np.packbits(many[lo:hi]).tobytes()) for lo, hi in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["segment", "chunk", "slots", "many"])
        give_back()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        counters = np.zeros(width, np.uint8)
        asked = [np.frombuffer(x, "<u4") for x in pdf["slots"]]
        for at, many in zip(asked, pdf["many"]):
            counters[at] = np.minimum(counters[at] + 1 + np.unpackbits(np.frombuffer(many, np.uint8), count=len(at)), 2)
        bits = [np.packbits(counters[at] > 1).tobytes() for at in asked]
        return pd.DataFrame({"chunk": pdf["chunk"], "segment": pdf["segment"], "bits": bits})

    asked = chunks.mapInArrow(ask, "segment long, chunk long, slots binary, many binary")
    told = asked.groupBy("segment").applyInPandas(merge, "chunk long, segment long, bits binary")

    def flag(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        bits = dict(zip(answers["segment"].to_pylist(), answers["bits"].to_pylist()))
        out = []
        for data in chunk["data"].to_pylist():
            table = _unpack(data)
            slots = _slots(table[key], segments, width)
            each, _ = _sketch(slots)
            owner = (each // np.uint64(width)).astype(np.int64)
            hit = np.zeros(len(each), bool)
            edges = np.r_[0, np.flatnonzero(np.diff(owner)) + 1, len(owner)].tolist()
            for lo, hi in zip(edges[:-1], edges[1:]):
                hit[lo:hi] = np.unpackbits(np.frombuffer(bits[int(owner[lo])], np.uint8), count=hi - lo)
            out.append(table.append_column("again", pa.array(hit[np.searchsorted(each, slots)].all(1))))
        give_back()
        return pa.concat_tables(out)

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", again boolean"
    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(flag, schema)
