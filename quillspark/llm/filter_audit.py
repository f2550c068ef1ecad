"""Filter interaction audit: what each filter removes, in every order of the filters.

Filters: A under 200 words, B fewer than half of the words distinct, C over 2 % capitals, D one of # $ % & * |, E a text that a
smaller id has. A text's own filters are expressions over it, and its SHA-256 stands for it from there on, so texts are read once and never shuffle.
A counting-Bloom prepass clears the texts that are surely unique; only the rows that may repeat shuffle for the smallest id of
their text. Every row then has a mask of the filters it fails, and all orders follow from the counts of the 32 masks in each part.

Defined cases: null text is empty (and fails A; an empty text fails neither B nor C); a null source is the part ''; a null id is no smaller and no
larger than any other, so its row neither fails E nor makes another fail; rows that share an id do not fail each other by it,
and each counts; a document with several label rows is good or toxic if one of them says so, a null label says nothing; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle
from .counting_bloom import flag_possible_repeats

LETTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2
SYMBOLS = "[#$%&*|]"
MASKS = 1 << len(LETTERS)


def own_filters(text: Column) -> Column:
    """Mask of the filters that look at the text alone: A is 1, B 2, C 4, D 8."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (n < MIN_WORDS, 100 * distinct < MIN_DISTINCT * n, 100 * capitals > MAX_CAPITALS * F.length(text), text.rlike(SYMBOLS))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask, n): rows of docs by id, part and the filters they fail."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    seen = settle(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), own_filters(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest")))
    flagged = settle(flag_possible_repeats(seen, "digest"))
    # copies with one id meet before the join, and the join is by id and text: a text that many ids have is no hot key there
    some = flagged.where("again").groupBy("id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    first = flagged.where("again and id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    late = F.when(F.col("id").isNotNull() & F.col("first").isNull(), 1 << 4).otherwise(0)
    some = some.join(first, ["id", "digest"], "left").select("id", "part", (F.col("mask") + late).alias("mask"), "n")
    lone = flagged.where(~F.col("again")).groupBy("id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    return lone.unionByName(some)


def mask_counts(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those that the labels call good or toxic, by part and mask."""
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(says("quality"), says("toxic"))
    if_true = lambda c, name: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(name)
    return rows.join(known, "id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), if_true("quality", "good"), if_true("toxic", "toxic"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step, with the counts of that step."""
    counts = mask_counts(masked(docs, id_col, text_col, part_col), labels, id_col)
    # at most 32 rows for each part: a part becomes one row with its counts by mask
    part = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("by"))
    entry = [F.coalesce(F.element_at("by", m), F.struct(*(F.lit(0).cast("long").alias(c) for c in ("n", "good", "toxic")))) for m in range(MASKS)]
    part = part.select("part", F.array(*entry).alias("by"))
    # a step is fixed by its filter and the set of filters before it: 80 of them
    steps = [(f, s) for f in range(len(LETTERS)) for s in range(MASKS) if not s >> f & 1]
    at = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.lit(1 << f).alias("bit"), F.lit(s).alias("before")) for f, s in steps)))
    each = part.select("part", "by", at.alias("at")).select("part", "by", "at.*")

    def total(field: str, use) -> Column:
        """Sum of a count over the masks for which use(mask) holds."""
        picked = F.transform("by", lambda x, i: F.when(use(i), x[field]).otherwise(0))
        return F.aggregate(picked, F.lit(0).cast("long"), lambda a, x: a + x)

    fails, clear = (lambda m: m.bitwiseAND(F.col("bit")) != 0), (lambda m: m.bitwiseAND(F.col("before")) == 0)
    gone = lambda m: fails(m) & clear(m)
    # a document that fails k filters is removed first by each of them in 120 / k orders
    orders = len(list(itertools.permutations(LETTERS)))
    share = F.transform("by", lambda x, i: F.when(fails(i), x["n"] * (F.lit(orders) / F.bit_count(i)).cast("long")).otherwise(0))
    each = each.select(
        "part", "f", "before",
        total("n", lambda m: m.bitwiseAND(F.col("before").bitwiseOR(F.col("bit"))) == 0).alias("kept"),
        total("n", gone).alias("removed"),
        total("n", lambda m: fails(m) & ~clear(m)).alias("redundant"),
        total("n", lambda m: m == F.col("bit")).alias("unique_fails"),
        total("good", gone).alias("good_lost"),
        total("toxic", gone).alias("toxic_lost"),
        F.aggregate(share, F.lit(0).cast("long"), lambda a, x: a + x).alias("shapley"),
    )
    plan = [("".join(p), i + 1, LETTERS.index(p[i]), sum(1 << LETTERS.index(x) for x in p[:i])) for p in itertools.permutations(LETTERS) for i in range(len(p))]
    order = docs.sparkSession.createDataFrame(plan, "filter_order string, step int, f int, before int")
    return each.join(F.broadcast(order), ["f", "before"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
