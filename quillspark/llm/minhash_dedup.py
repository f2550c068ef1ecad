"""Near-duplicate groups by bottom-k sketches of one hash function.

1. Every text becomes its set of hashed word shingles; the k smallest hashes are its sketch. Texts with equal sets are one class.
2. Inverted lists of retained values: a class is listed under the first `prefix` values of its sketch. Values that more than
   `common` classes retain come last in that order, so a passage that many texts share gives no list unless a text is made of it.
   Two sets of similarity s share none of their first p values with probability (1 - s)^p at most.
3. Each list's hub (the member with the most common values) is compared with the other members. In lists that still touch several
   components, all pairs of different components are compared if the list has up to `common` members; a longer list is split
   by what its members do not share with the hub, by a bound that loses no similar pair, and its parts are lists of the next round.
4. A pair goes on if it shares `overlap` listed values and the estimate from the union of both sketches is near the threshold;
   exact similarity of the full sets then decides. Components of the confirmed links are the groups.

Nothing is capped: a list of any length is joined, not collected. Full sets are built again from the text, and only for
documents that have a candidate.

Defined cases: null text and text without words has an empty set, is linked with nothing and stays; a text shorter than a shingle
is one shingle; rows without an id are left out; rows that repeat an id count as one document with the shortest of their texts (null first, then
by bytes), and each of them gets its result; a text of any length is read whole; equal texts and sets of equal size need no rule, as
groups are components; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lowered, mix, settle, shingle_sets, sub_batches
from .linking import NARROW, WIDE, linked, only

SKETCH, PREFIX, COMMON, OVERLAP, SLACK = 48, 20, 64, 3, 0.35


def sketches(rows: DataFrame, words: int, k: int) -> DataFrame:
    """rows (id, text) to (id, n, print_a, print_b, sketch): set size, two hashes of the whole set, the k smallest of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw, bounds in sub_batches(batches, "text"):
            sets = shingle_sets(lowered(raw), bounds, words)
            first = np.array([x.sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64)
            second = np.array([mix(x + np.uint64(1)).sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64)
            heads = [x[:k] for x in sets]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in heads]))).astype(np.int32)
            flat = pa.array(np.concatenate(heads).view(np.int64) if heads else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(first), pa.array(second), pa.ListArray.from_arrays(pa.array(ends), flat)], ["id", "n", "print_a", "print_b", "sketch"])

    return rows.mapInArrow(run, "id long, n long, print_a long, print_b long, sketch array<long>")


def _listed(reps: DataFrame, prefix: int, common: int) -> DataFrame:
    """(id, n, centre, values): under which values each class is listed; centre is the number of common values in its sketch."""
    flat = reps.select("id", F.explode("sketch").alias("value"))
    held = flat.groupBy("value").agg(F.count(F.lit(1)).alias("lists")).where("lists > 1")
    met = flat.join(held, "value").groupBy("id").agg(F.collect_list(F.when(F.col("lists") > common, F.col("value"))).alias("hot"), F.collect_list("value").alias("shared"))
    none = F.array().cast("array<long>")
    both = reps.join(met, "id").select("id", "n", "sketch", F.coalesce("hot", none).alias("hot"), F.coalesce("shared", none).alias("shared"))
    rare = F.slice(F.array_except("sketch", "hot"), 1, prefix)
    fill = F.slice(F.array_intersect("sketch", "hot"), 1, F.greatest(F.lit(prefix) - F.size(rare), F.lit(0)))
    return both.select("id", "n", F.size("hot").alias("centre"), F.array_intersect(F.concat(rare, fill), "shared").alias("values")).where(F.size("values") > 0)


def _likely(reps: DataFrame, percent: int, slack: float) -> Callable[[DataFrame], DataFrame]:
    """Keeps the pairs (a, b) whose similarity, estimated from the union of both sketches, is near the threshold."""
    sketch = reps.select("id", "sketch")

    def run(pairs: DataFrame) -> DataFrame:
        near = pairs.join(sketch.toDF("a", "sketch_a"), "a").join(sketch.toDF("b", "sketch_b"), "b")
        union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, F.greatest(F.size("sketch_a"), F.size("sketch_b")))
        estimate = F.size(F.array_intersect(F.array_intersect(union, "sketch_a"), "sketch_b")) / F.size(union)
        return near.where(estimate >= percent / 100 - slack).select("a", "b")

    return run


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    sketch: int = SKETCH,
    prefix: int = PREFIX,
    common: int = COMMON,
    overlap: int = OVERLAP,
    slack: float = SLACK,
) -> DataFrame:
    """(id, n, component) for each document: size of its shingle set and smallest id of its group.

    Two documents are linked if 100 * intersection >= percent * union of their sets of `words`-word shingles. overlap may be
    at most 3 for percent >= 67: smaller sets are only similar when equal. slack: how far below the threshold an estimate may lie.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    repeated = settle(rows.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), 1)
    shared = not repeated.isEmpty()
    if shared:
        mine = rows.join(repeated, "id", "left_semi").groupBy("id").agg(F.min(F.struct(F.length("text"), "text")).alias("x")).select("id", "x.text")
        rows = settle(rows.join(repeated, "id", "left_anti").unionByName(mine))
    table = settle(sketches(rows, words, sketch))
    scale = table.count()
    classes = table.where("n > 0").groupBy("print_a", "print_b", "n").agg(F.min("id").alias("rep"))
    known = settle(table.join(classes, ["print_a", "print_b", "n"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep"), F.when(F.col("id") == F.col("rep"), F.col("sketch")).alias("sketch")), 1 + scale // WIDE)
    reps = known.where(F.col("sketch").isNotNull()).select("id", "n", "sketch")
    listed = settle(_listed(reps, prefix, common), 1 + scale // WIDE)
    found = linked(listed, rows, words, percent, common, overlap, scale, _likely(reps, percent, slack))
    out = known.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("id", "n", F.coalesce("component", "rep").alias("component"))
    if shared:
        times = out.join(repeated, "id", "left").withColumn("_again", F.explode(F.array_repeat(F.lit(0), F.coalesce("rows", F.lit(1)).cast("int"))))
        out = times.select("id", "n", "component")
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each near-duplicate group: the one with the smallest id. Rows without an id stay."""
    groups = near_groups(docs, id_col, text_col, **options)
    gone = settle(groups.where("id <> component").select("id").distinct(), 1 + groups.count() // NARROW)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).withColumn("id", F.col(names[docs.columns.index(id_col)]).cast("long"))
    return only(rows, gone, "left_anti").select(*names).toDF(*docs.columns)
