"""Links between similar sets, given inverted lists: who is compared, exact confirmation, and the groups that result."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lowered, settle, shingle_sets, sub_batches
from .components import components

# So many ids, 8 bytes each, are sent to every task at most; more of them are joined by shuffle.
BROADCAST_IDS = 2_000_000


def only(rows: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """rows whose id is among ids (left_semi) or is not (left_anti). ids is one column of distinct ids; its size is counted, and up
    to BROADCAST_IDS of them spare the rows, which hold whole texts, a shuffle."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", how)


# After so many rounds of splitting long lists, what is left is compared in full.
ROUNDS = 2

# Sets to a file of an intermediate table, for rows with whole sets or lists and for rows of a few numbers.
WIDE, NARROW = 10_000, 50_000


def full_sets(rows: DataFrame, words: int) -> DataFrame:
    """rows (id, text) to (id, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw, bounds in sub_batches(batches, "text"):
            sets = shingle_sets(lowered(raw), bounds, words)
            ends = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
            flat = pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], ["id", "shingles"])

    return rows.mapInArrow(run, "id long, shingles array<long>")


def lone_shingles(rows: DataFrame, words: int) -> DataFrame:
    """(id, lone): how many shingles of a text no other text of rows has. Every task sends each of its distinct shingles once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw, bounds in sub_batches(batches, "text"):
            sets = shingle_sets(lowered(raw), bounds, words)
            flat = np.concatenate(sets).view(np.int64)
            row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            each, first, n = np.unique(flat, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(each), pa.array(n > 1), b.column(0).take(pa.array(row[first]))], ["shingle", "shared", "id"])

    sent = rows.select("id", "text").mapInArrow(run, "shingle long, shared boolean, id long")
    alone = sent.groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("other"), F.max("shared").alias("shared")).where("id = other AND NOT shared")
    return alone.groupBy("id").agg(F.count(F.lit(1)).alias("lone"))


def confirm(pairs: DataFrame, rows: DataFrame, words: int, percent: int, scale: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar. rows: (id, text)."""
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = settle(full_sets(only(rows, wanted), words), 1 + scale // WIDE)
    joined = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    both = F.size(F.array_intersect("set_a", "set_b"))
    return settle(joined.where(100 * both >= percent * (F.size("set_a") + F.size("set_b") - both)).select("a", "b"), 1 + scale // NARROW)


def _hub_pairs(lists: DataFrame, percent: int, overlap: int) -> DataFrame:
    """Distinct pairs (a, b) of a list's hub with its other members, where their sizes allow the similarity and they meet in `overlap` lists."""
    hubs = _hubs(lists)
    stars = lists.join(hubs, "value").where(F.col("id") != F.col("hub")).where(100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
    return stars.groupBy(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).agg(F.count(F.lit(1)).alias("met")).where(F.col("met") >= overlap).select("a", "b")


def _hubs(lists: DataFrame) -> DataFrame:
    hubs = lists.groupBy("value").agg(F.min(F.struct(-F.col("centre"), "id", "n")).alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1")
    return hubs.select("value", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n"))


def _by_differences(lists: DataFrame, rows: DataFrame, words: int, percent: int, scale: int, least_lists: int) -> DataFrame:
    """Shorter lists (value, id, n, centre, base, size, useful, asks, outside) that hold every similar pair of different components of the given ones.

    lists: (value, id, n, centre, component), whose hubs were compared with all members. Say d(x) is what x's set and the hub's do not
    share, and p the percentage. Similar x, y have |d(x)| + |d(y)| - 2 |d(x) & d(y)| <= c (|x| + |y|) with c = (100 - p) / (100 + p), and y,
    in another component than the hub, has |d(y)| > c (|y| + |hub|). So they share more than (|d(x)| + c (|hub| - |x|)) / 2 elements of d(x),
    one at least among so many of x's rarest as the rest cannot make up for. A new list holds, for one hub and element, the
    sets that have it among these (asks), and the sets outside of the hub's component that have it at all (outside). size is |d(x)|,
    useful is how many of d(x) a set of another component may share.
    """
    placed = lists.join(_hubs(lists), "value")
    home = placed.where("id = hub").select("value", F.col("component").alias("hub_component"))
    # a pair that has a short list in common was compared there, and others meet in `least_lists` long ones: in any order of the lists, the first
    # that a pair has in common is not among the last `least_lists` - 1 of either. Hubs of many lists come first, so that a set meets few hubs.
    order = W.partitionBy("id").orderBy(F.desc("lists"), "hub", "value")
    weight = placed.groupBy("hub").agg(F.count(F.lit(1)).alias("lists"))
    ranked = placed.join(weight, "hub").withColumns({"rank": F.row_number().over(order), "met": F.count(F.lit(1)).over(W.partitionBy("id"))})
    member = ranked.where(F.col("rank") <= F.col("met") - (least_lists - 1))
    pairs = settle(member.join(home, "value").where("id <> hub").select("hub", "hub_n", "id", "n", "component", (F.col("component") != F.col("hub_component")).alias("outside")).distinct(), 1 + scale // NARROW)
    sets = settle(full_sets(only(rows, pairs.select("id").union(pairs.select("hub")).distinct()), words), 1 + scale // WIDE)
    both = pairs.join(sets.toDF("id", "own"), "id").join(sets.toDF("hub", "other"), "hub")
    apart = both.withColumn("apart", F.concat(F.array_except("own", "other"), F.array_except("other", "own"))).withColumn("size", F.size("apart"))
    shared = F.floor(((100 + percent) * F.col("size") + (100 - percent) * (F.col("hub_n") - F.col("n"))) / F.lit(2 * (100 + percent))) + 1
    flat = settle(apart.select("hub", "id", "n", "component", "outside", "size", (F.col("size") - shared + 1).alias("prefix"), F.explode("apart").alias("element")), 1 + scale // WIDE)
    # only elements that two components share, one of them outside, make a list; all others count as rarer than these
    held = flat.groupBy("hub", "element").agg(F.count(F.lit(1)).alias("held"), F.max("outside").alias("some"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("some AND lo < hi")
    rank = F.row_number().over(W.partitionBy("hub", "id").orderBy("held", "element"))
    useful = flat.join(held.select("hub", "element", "held"), ["hub", "element"]).withColumns({"rank": rank, "useful": F.count(F.lit(1)).over(W.partitionBy("hub", "id"))})
    kept = settle(useful.withColumn("asks", F.col("rank") + F.col("size") - F.col("useful") <= F.col("prefix")).where("asks OR outside"), 1 + scale // WIDE)
    met = kept.groupBy("hub", "element").agg(F.max("asks").alias("asked"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("asked AND lo < hi").select("hub", "element")
    return settle(kept.join(met, ["hub", "element"], "left_semi").select(F.xxhash64("hub", "element").alias("value"), "id", "n", (-F.col("size")).alias("centre"), F.col("hub").alias("base"), "size", "useful", "asks", "outside"), 1 + scale // WIDE)


def linked(listed: DataFrame, rows: DataFrame, words: int, percent: int, common: int, overlap: int, scale: int, likely: Callable[[DataFrame], DataFrame] = lambda pairs: pairs, dense: bool = True) -> DataFrame:
    """(id, component) for each set that is linked with another one.

    listed: (id, n, centre, values), settled; n is the size of the set, centre tells how well it stands for its lists, values are the
    lists it is in. Each round compares each list's hub (largest centre) with the other members. Of the lists that then still touch several
    components, those of up to `common` members have all their pairs of different components compared, and longer ones are split
    into lists of sets that differ from the hub in the same way, which make the next round. In the first round a
    pair must meet in `overlap` lists, and `likely` may drop pairs. Without `dense`, where the members of long lists are not close to their hub,
    long lists are not split: all their pairs of different components are compared whose sizes, less the shingles that no other member has,
    allow the similarity.
    scale: about how many sets there are; intermediate tables are written in files to match.
    """
    lists = listed.select("id", "n", "centre", F.explode("values").alias("value"))
    links = None
    for depth in range(ROUNDS):
        pairs = _hub_pairs(lists, percent, 1 if depth else overlap)
        near = confirm(settle(likely(pairs), 1 + scale // NARROW), rows, words, percent, scale)
        links = near if links is None else links.union(near)
        found = components(links)
        placed = settle(lists.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")), 1 + scale // WIDE)
        split = placed.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("members")).where("lo < hi").select("value", "members")
        open_ = settle(placed.join(split, "value"), 1 + scale // NARROW)
        if not dense:
            more = confirm(settle(likely(_by_sizes(open_, rows, words, percent, common, overlap, listed, scale)), 1 + scale // NARROW), rows, words, percent, scale)
            links = links.union(more)
            break
        short = open_.where(F.col("members") <= common) if depth < ROUNDS - 1 else open_
        more = confirm(settle(likely(_all_pairs(short, percent, overlap, listed if not depth else None)), 1 + scale // NARROW), rows, words, percent, scale)
        links = links.union(more)
        long_ = open_.where(F.col("members") > common)
        if depth == ROUNDS - 1 or long_.isEmpty():
            break
        found = components(links) if not more.isEmpty() else found
        lists = _by_differences(long_.drop("component", "members").join(found, "id", "left").withColumn("component", F.coalesce("component", "id")), rows, words, percent, scale, 1 if depth else overlap)
        more = None
        if lists.isEmpty():
            break
    return found if more is None or more.isEmpty() else components(links)


def _by_sizes(open_: DataFrame, rows: DataFrame, words: int, percent: int, common: int, overlap: int, listed: DataFrame, scale: int) -> DataFrame:
    """Pairs (a, b) of different components, each once, that meet in `overlap` lists, where what a member of a long list may share with others allows
    the similarity."""
    wide = F.col("members") > common
    lone = lone_shingles(only(rows, open_.where(wide).select("id").distinct()), words)
    rest = F.col("n") - F.when(wide, F.coalesce("lone", F.lit(0))).otherwise(0)
    bound = settle(open_.join(lone, "id", "left").join(listed.select("id", "values"), "id").select("value", "id", "n", "component", "values", rest.alias("rest")), 1 + scale // NARROW)
    x, y = bound.alias("x"), bound.alias("y")
    least, both = F.least("x.rest", "y.rest"), F.array_intersect("x.values", "y.values")
    near = (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component")) & (100 * least >= percent * (F.col("x.n") + F.col("y.n") - least))
    return x.join(y, (F.col("x.value") == F.col("y.value")) & near & (F.get(both, F.lit(0)) == F.col("x.value")) & (F.size(both) >= overlap)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _all_pairs(lists: DataFrame, percent: int, overlap: int, listed: DataFrame | None) -> DataFrame:
    """Pairs (a, b) of different components in the same list; each once, in the first of these lists that it shares, if listed tells all
    lists of each set, and then in `overlap` of all."""
    x, y = lists.alias("x"), lists.alias("y")
    near = (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component")) & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
    if listed is None:
        roles = (F.col("x.asks") & F.col("y.outside")) | (F.col("y.asks") & F.col("x.outside"))
        apart = F.col("x.size") + F.col("y.size") - 2 * F.least("x.useful", "y.useful")
        bound = (100 + percent) * apart <= (100 - percent) * (F.col("x.n") + F.col("y.n"))
        return x.join(y, (F.col("x.value") == F.col("y.value")) & (F.col("x.base") == F.col("y.base")) & near & roles & bound).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    here = lists.groupBy("id").agg(F.array_sort(F.collect_set("value")).alias("here"))
    whole = settle(lists.join(here, "id").join(listed.select("id", "values"), "id"))
    x, y = whole.alias("x"), whole.alias("y")
    first, both = F.get(F.array_intersect("x.here", "y.here"), F.lit(0)), F.array_intersect("x.values", "y.values")
    return x.join(y, (F.col("x.value") == F.col("y.value")) & near & (first == F.col("x.value")) & (F.size(both) >= overlap)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
