"""Exact dedup: two Bloom passes find the digests that may repeat; only their rows meet by digest, the others pass straight through.

Texts are read once, for their digests. Pass 1 counts every digest's slots in a segmented counting filter (`counting_bloom`): chunks of
digests send their slots, four bytes each, to the segments that own them. Pass 2 sends one bit back for each slot: hit more than
once or not. A digest with a slot that no other row has hit is the only one of its text. Nothing passes through the driver, and
one pass does for any number of rows.

Defined cases: null text counts as empty; a null id sorts below every other id; of rows that share text and id one stays;
an empty table gives an empty result; other columns are carried along and never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .counting_bloom import SLOTS_PER_KEY, flag_possible_repeats
from .linking import only

FILTER_BYTES = 8 << 20


def _digest(texts: pa.Array) -> list[bytes]:
    texts = pc.ascii_lower(pc.fill_null(texts, ""))
    return [hashlib.sha256(x.as_buffer() or b"").digest() for x in texts.cast(pa.large_binary())]


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tag, digest): tag numbers the rows, digest is SHA-256 of the text with A-Z lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_digest(b.column(2)), pa.binary())], ["id", "tag", "digest"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("tag"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, tag long, digest binary")


def flagged(keys: DataFrame, filter_bytes: int) -> DataFrame:
    """keys (settled, with a column digest) with `again`: whether the digest may occur twice. filter_bytes: most counters of one segment."""
    return settle(flag_possible_repeats(keys, "digest", segment_keys=max(1, filter_bytes // SLOTS_PER_KEY)))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row for each row of docs: id, keep_id (largest id of its text), group_size, kept, digest."""
    keys = settle(digests(docs, id_col, text_col))
    rows = flagged(keys, filter_bytes)
    lone = rows.where(~F.col("again")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    some = rows.where("again")
    groups = some.groupBy("digest").agg(F.max(F.struct(F.coalesce(F.col("id"), F.lit(-(2**63))).alias("at"), "tag", "id")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    met = some.join(groups, "digest").select("id", F.col("best.id").alias("keep_id"), "group_size", (F.col("tag") == F.col("best.tag")).alias("kept"), "digest")
    return lone.unionByName(met)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """docs without the rows that exact_groups drops. Rows are written once beside their digests; of texts, none shuffles unless the list of dropped
    rows has outgrown a broadcast."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    text, key = names[docs.columns.index(text_col)], names[docs.columns.index(id_col)]
    plain = docs.toDF(*names).withColumn("id", F.monotonically_increasing_id())
    form = ", ".join(f"`{n}` {t}" for n, t in plain.dtypes) + ", digest binary"
    at = plain.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_digest(b.column(at)), pa.binary())], [*b.schema.names, "digest"])

    rows = settle(plain.mapInArrow(run, form))
    some = flagged(rows.select("id", F.col(key).cast("long").alias("key"), "digest"), filter_bytes).where("again")
    best = some.groupBy("digest").agg(F.max(F.struct(F.coalesce("key", F.lit(-(2**63))).alias("key"), "id")).alias("best")).select(F.col("best.id").alias("id"))
    gone = settle(some.select("id").join(best, "id", "left_anti"))
    return only(rows, gone, "left_anti").select(*names).toDF(*docs.columns)
