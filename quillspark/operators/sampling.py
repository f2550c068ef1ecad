"""Deterministic sampling, balancing, splitting and mixing.

Random order is the order of md5(seed, key), so samples are the same on every run and any engine can check them. Ranks
inside a large group never come from one window: rows are counted by a prefix of the hash, and only rows of one prefix
are ordered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..labels import NEUTRAL

PREFIX = 3


def draw(key: str | Column, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), (F.col(key) if isinstance(key, str) else key).cast("string")))


def ranked(rows: DataFrame, key: str, by: tuple[str, ...] = (), seed: int = 42, out: str = "rank") -> DataFrame:
    """rows with their rank (from 1) within `by` in random order. key must be unique within `by`."""
    marked = rows.withColumns({"_draw": draw(key, seed)}).withColumn("_part", F.substring("_draw", 1, PREFIX))
    counts = marked.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))  # at most 16^PREFIX rows for each group
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("_before", before).drop("_n")
    own = F.row_number().over(W.partitionBy(*by, "_part").orderBy("_draw", key))
    return marked.withColumn("_own", own).join(offsets, [*by, "_part"]).withColumn(out, (F.col("_before") + F.col("_own")).cast("long")).drop("_draw", "_part", "_own", "_before")


def numbered(rows: DataFrame, out: str = "row_no") -> DataFrame:
    """rows numbered from 0 in file order: a count for each partition, then an offset; no global window."""
    marked = rows.withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()})
    counts = sorted((r["_p"], r["count"]) for r in marked.groupBy("_p").count().collect())  # one row for each partition
    offsets, at = {}, 0
    for p, n in counts:
        offsets[p], at = at, at + n
    table = rows.sparkSession.createDataFrame(list(offsets.items()) or [(0, 0)], "_p int, _off long")
    return marked.join(F.broadcast(table), "_p").withColumn(out, F.col("_off") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_m", "_off")


def keep_first(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """One row for each key, the first in order; by partial aggregation, so that a common key is no hot group."""
    names = rows.columns
    best = rows.groupBy(*keys).agg(F.min(F.struct(*[c.alias(f"_o{i}") if isinstance(c, Column) else F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*names).alias("_row"))).alias("_b"))
    return best.select("_b._row.*")


def keep_last(rows: DataFrame, keys: list, order: list) -> DataFrame:
    names = rows.columns
    best = rows.groupBy(*keys).agg(F.max(F.struct(*[c.alias(f"_o{i}") if isinstance(c, Column) else F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*names).alias("_row"))).alias("_b"))
    return best.select("_b._row.*")


def merge_gold(gold: DataFrame, extra: DataFrame, key: str = "post_id", order: str = "row_no") -> DataFrame:
    """gold and extra rows, the first one of each id; gold comes before extra."""
    both = gold.withColumn("source_order", F.lit(0)).unionByName(extra.withColumn("source_order", F.lit(1)))
    return keep_first(both, [key], ["source_order", order])


def dedupe_text(rows: DataFrame, text: str = "text", label: str = "label", order: str = "post_id") -> DataFrame:
    """The first of rows whose texts differ in case alone, within a label."""
    return keep_first(rows, [F.lower(text), label], [order])


def sample_per_label(rows: DataFrame, n: int, key: str, label: str = "label", seed: int = 42) -> DataFrame:
    return ranked(rows, key, (label,), seed).where(F.col("rank") <= n)


def subsample(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return ranked(rows, key, (), seed).where(F.col("rank") <= n).drop("rank")


def _one(rows: DataFrame, *aggs: Column) -> DataFrame:
    return F.broadcast(rows.agg(*aggs))  # a single row


def balance_classes(rows: DataFrame, key: str, label: str = "label", seed: int = 42) -> DataFrame:
    """As many rows of each class as the smallest class has."""
    least = _one(rows.groupBy(label).count(), F.min("count").alias("_least"))
    return ranked(rows, key, (label,), seed).crossJoin(least).where(F.col("rank") <= F.col("_least")).drop("rank", "_least")


def cap_neutral(rows: DataFrame, key: str, max_ratio: float, label: str = "label", seed: int = 42) -> DataFrame:
    """At most max_ratio times the median count of the bias classes as neutral rows."""
    counts = rows.where(F.col(label) != NEUTRAL).groupBy(label).count()
    cap = _one(counts, F.floor(F.percentile("count", 0.5) * max_ratio).alias("_cap"))
    out = ranked(rows, key, (label,), seed).crossJoin(cap)
    return out.where((F.col(label) != NEUTRAL) | F.col("_cap").isNull() | (F.col("rank") <= F.col("_cap"))).drop("rank", "_cap")


def take_cyclic(pool: DataFrame, n: Column, stats: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """n rows of pool in random order, from the start again where pool is too small; `pick` numbers them from 0. n is a column of the
    one-row stats."""
    size = _one(pool, F.count(F.lit(1)).alias("_size"))
    r = ranked(pool, key, (), seed).crossJoin(size).crossJoin(stats.withColumn("_want", n).select("_want"))
    copies = F.floor((F.col("_want") - F.col("rank")) / F.col("_size")) + 1
    use = r.where(F.col("rank") <= F.col("_want")).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    return use.withColumn("pick", F.col("rank") - 1 + F.col("_k") * F.col("_size")).drop("rank", "_size", "_want", "_k")


def mix_in(base: DataFrame, pool: DataFrame, fraction: float, key: str, tag: str = "mixed", seed: int = 42) -> DataFrame:
    """base and round(fraction * its rows) rows of pool, with own group ids. Columns: text, label, group_id, source."""
    stats = _one(base, F.bround(F.count(F.lit(1)) * F.lit(fraction)).cast("long").alias("_add"))
    extra = take_cyclic(pool, F.col("_add"), stats, key, seed)
    named = extra.select("text", "label", F.concat(F.lit(f"{tag}-{seed}-"), F.col("pick").cast("string")).alias("group_id"), F.lit(tag).alias("source"))
    return base.select("text", "label", "group_id", "source").unionByName(named)


def fuse_80_20(real: DataFrame, synthetic: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """real rows and a quarter as many synthetic ones, then balanced. Columns: key, text, label, origin."""
    stats = _one(real, F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * F.lit(0.25)).cast("long")).alias("_add"))
    extra = take_cyclic(synthetic, F.col("_add"), stats, key, seed)
    both = real.select(F.concat(F.lit("r"), F.col(key).cast("string")).alias(key), "text", "label", F.lit("real").alias("origin")).unionByName(
        extra.select(F.concat(F.lit("s"), F.col("pick").cast("string")).alias(key), "text", "label", F.lit("synthetic").alias("origin"))
    )
    return balance_classes(both, key, seed=seed)


def stratified_split(rows: DataFrame, key: str, label: str = "label", shares: tuple[float, float] = (0.75, 0.10), seed: int = 42) -> DataFrame:
    """rows with `split`: the same shares of every class to train, val and test."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    at = F.col("rank") / F.col("_n")
    return ranked(rows, key, (label,), seed).join(counts, label).withColumn("split", F.when(at <= shares[0], "train").when(at <= shares[0] + shares[1], "val").otherwise("test")).drop("rank", "_n")


def group_split(rows: DataFrame, group: str, shares: tuple[float, float] = (0.75, 0.10), seed: int = 42) -> DataFrame:
    """rows with `split`; all rows of a group go to one side."""
    groups = rows.select(group).distinct()
    n = _one(groups, F.count(F.lit(1)).alias("_n"))
    at = F.col("rank") / F.col("_n")
    sides = ranked(groups, group, (), seed).crossJoin(n).select(group, F.when(at <= shares[0], "train").when(at <= shares[0] + shares[1], "val").otherwise("test").alias("split"))
    return rows.join(sides, group)


def folds(rows: DataFrame, key: str, k: int = 4, label: str = "label", seed: int = 42) -> DataFrame:
    return ranked(rows, key, (label,), seed).withColumn("fold", (F.col("rank") % k).cast("int")).drop("rank")


def bucket_sizes(total: Column, n: int) -> Column:
    """A total in n near-equal parts, larger parts first."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.floor(total / n) + F.when(i < total % n, 1).otherwise(0)).cast("long"))


def deficits(rows: DataFrame, target: int, label: str = "label") -> DataFrame:
    from .metrics import label_counts

    return label_counts(rows, label).select("label", "n", F.greatest(F.lit(target) - F.col("n"), F.lit(0)).cast("long").alias("deficit"))


def pairs_of_two(rows: DataFrame, group: str = "group_id") -> DataFrame:
    """Rows of groups that have just two rows."""
    whole = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where("_n = 2").select(group)
    return rows.join(whole, group, "left_semi")


def resume_ratings(posts: DataFrame, earlier: DataFrame, key: str = "post_id", order: str = "row_no") -> DataFrame:
    """posts with the latest earlier rating of each, null where there is none."""
    last = keep_last(earlier, [key], [order]).drop(order)
    return posts.join(last, key, "left")


def attach_labels(posts: DataFrame, labels: DataFrame, key: str = "post_id") -> tuple[DataFrame, DataFrame]:
    """(posts with labels, labels whose post is missing)."""
    return posts.join(labels, key), labels.join(posts, key, "left_anti")
