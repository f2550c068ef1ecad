"""Synthetic posts to an exact quota of distinct texts, and the checks of a finished set.

Every (label, subtype) has an endless sequence of draws. A hash of seed, bucket, draw and slot picks the template, its fillers, a
lead, a tail in 35 % of the draws and the style (45 % x_like), so a draw can be made anywhere, again and in any order. A draw counts if
its text is valid and the first of its kind in the bucket; the first `n` that count are the bucket's posts. How many draws
that takes is found by rounds that double the draws of the buckets that are still short, up to 40 for each post wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..labels import LABELS
from .corpus import valid_comparison

LEADS = ("", "", "to be blunt, ", "small observation: ", "after ten years in teams, ", "maybe it is just me, but ", "unpopular view: ", "for the record, ")
TAILS = (" that is all.", " make of it what you will.", " no offence meant.", " i keep noticing it.", " thoughts?")
TAIL_PERCENT, X_PERCENT, MOST_TRIES = 35, 45, 40
BLOCK = 1 << 14  # draws that one task makes at a time
FILLERS = {
    "g": ("women", "men", "female colleagues", "male colleagues", "mothers", "fathers", "women in tech", "men in finance"),
    "n": ("immigrants", "locals", "foreign graduates", "domestic applicants", "visa holders", "people from abroad", "native speakers", "expats"),
    "p": ("engineers", "nurses", "consultants", "teachers", "plumbers", "accountants", "designers", "drivers"),
    "t": ("planning", "night shifts", "client calls", "code review", "budget talks", "incident response", "training new staff", "reporting"),
    "r": ("lead roles", "support roles", "the board", "the help desk", "senior positions", "junior positions"),
}
# by label and subtype; a slot is a letter of FILLERS and a number, so that a template can draw from one list twice
TEMPLATES: dict[str, dict[str, tuple[str, ...]]] = {
    "gender_bias": {
        "explicit": ("{g1} are better than {g2}", "{g1} are worse than {g2} at {t1}", "{g1} are naturally made for {r1}"),
        "coded": ("{r1} usually call for the calm that {g1} bring to {t1}", "for {t1} and {t2} we tend to look at {g1} first", "{g1} add warmth, {g2} add direction in {r1}"),
    },
    "nationality_bias": {
        "explicit": ("{n1} are better than {n2}", "{n1} take {r1} away from {n2}", "{n1} are never on time for {t1}"),
        "coded": ("{n1} may lack the context for {t1} in {r1}", "a local touch in {t1} is hard to find among {n1}", "{r1} need a fit that {n1} rarely show in {t1}"),
    },
    "profession_bias": {
        "explicit": ("{p1} are smarter than {p2}", "{p1} should leave {t1} to {p2}", "{p1} are not made for {r1}"),
        "coded": ("you would not expect {p1} to enjoy {t1} in {r1}", "{p1} do {t1}, while {p2} do the thinking", "{r1} and {p1} are rarely seen together in {t1}"),
    },
    "neutral": {
        "policy": ("our report on {t1} covers {p1} and {p2} in {r1}", "the survey asked {p1} and {g1} about {t1}", "{p1} and {p2} both took part in {t1}"),
        "fairness": ("{g1} and {g2} deserve the same path to {r1}", "{n1} face barriers in {t1} despite good work in {r1}", "credit for {t1} should reach {p1} and {g1} alike"),
    },
}
# fixed values: comparisons of a group with itself
SAME_SIDE = ("women are better than women", "men are better than men", "locals are better than locals", "immigrants are better than immigrants")


def bucket_quotas(per_class: Column) -> list[tuple[str, str, Column]]:
    """(label, subtype, posts): a class's posts over its subtypes, as even as can be."""
    out = []
    for label, kinds in TEMPLATES.items():
        for i, kind in enumerate(kinds):
            out.append((label, kind, (F.floor(per_class / len(kinds)) + F.when(per_class % len(kinds) > i, 1).otherwise(0)).cast("long")))
    return out


def picked(seed: int, slot: str, n: int | Column) -> Column:
    """A number below n for this draw and slot."""
    word = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "label", "subtype", F.col("draw").cast("string"), F.lit(slot))), 1, 8)
    return (F.conv(word, 16, 10).cast("long") % n).cast("int")


def _of(words: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), at + 1)


def draws_of(buckets: DataFrame) -> DataFrame:
    """(label, subtype, draw): the draws from 0 to tries - 1 of each bucket (label, subtype, tries). A bucket is cut into blocks, and the blocks
    are dealt over the cores, as the few buckets lie in a single task."""
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tries") - 1, F.lit(BLOCK).cast("long"))).alias("_first")
    blocks = buckets.where("tries > 0").select("label", "subtype", "tries", first).repartition(4 * buckets.sparkSession.sparkContext.defaultParallelism)
    return blocks.select("label", "subtype", F.explode(F.sequence("_first", F.least(F.col("_first") + BLOCK, "tries") - 1)).alias("draw"))


def texts(draws: DataFrame, seed: int) -> DataFrame:
    """draws (label, subtype, draw) with text and style."""
    of = draws.sparkSession.createDataFrame([(label, kind, list(t)) for label, kinds in TEMPLATES.items() for kind, t in kinds.items()], "label string, subtype string, _of array<string>")
    out = draws.join(F.broadcast(of), ["label", "subtype"]).withColumn("_t", F.element_at("_of", picked(seed, "template", F.size("_of")) + 1))
    for name, words in FILLERS.items():
        for k in (1, 2):
            slot = F.lit(f"{{{name}{k}}}")
            # a template has few of the slots, and each costs a digest
            out = out.withColumn("_t", F.when(F.contains("_t", slot), F.replace("_t", slot, _of(words, picked(seed, f"{name}{k}", len(words))))).otherwise(F.col("_t")))
    tail = F.when(picked(seed, "with_tail", 100) < TAIL_PERCENT, _of(TAILS, picked(seed, "tail", len(TAILS)))).otherwise("")
    text = F.trim(F.concat(_of(LEADS, picked(seed, "lead", len(LEADS))), "_t", tail))
    text = F.regexp_replace(text, r"([^.!?])$", "$1.")
    style = F.when(picked(seed, "style", 100) < X_PERCENT, "x_like").otherwise("linkedin_like")
    # through explode, as filters on a text would else be pushed below it and make it several times
    return out.select("label", "subtype", "draw", F.explode(F.array(F.struct(text.alias("text"), style.alias("style")))).alias("x")).select("label", "subtype", "draw", "x.*")


def _drawn(quotas: DataFrame, seed: int) -> DataFrame:
    """The valid draws of quotas (label, subtype, tries), the first of each text."""
    good = texts(draws_of(quotas), seed).where(valid_comparison(F.col("text"), SAME_SIDE))
    best = good.groupBy("label", "subtype", F.lower("text").alias("_low")).agg(F.min(F.struct("draw", "text", "style")).alias("x"))
    return best.select("label", "subtype", "x.draw", "x.text", "x.style")


def generate(quotas: DataFrame, seed: int = 42, most_tries: int = MOST_TRIES) -> DataFrame:
    """(label, subtype, number, text, style): the first n distinct posts of each bucket, numbered from 1; fewer where 40 draws for each do not
    give n. quotas: label, subtype, n, one row for each bucket."""
    spark = quotas.sparkSession
    wanted = {(r["label"], r["subtype"]): r["n"] for r in quotas.collect()}  # one row for each list of templates
    form = "label string, subtype string, tries long"
    tries = {b: min(n * most_tries, n + n // 2 + 16) for b, n in wanted.items()}
    short = dict(tries)
    while short:
        got = {(r["label"], r["subtype"]): r["n"] for r in _drawn(spark.createDataFrame([(*b, m) for b, m in short.items()], form), seed).groupBy("label", "subtype").agg(F.count(F.lit(1)).alias("n")).collect()}
        short = {b: min(2 * m, wanted[b] * most_tries) for b, m in short.items() if got.get(b, 0) < wanted[b] and m < wanted[b] * most_tries}
        tries |= short
    rows = _drawn(spark.createDataFrame([(*b, m) for b, m in tries.items()], form), seed)
    # numbers in order of draws: counts of whole blocks of draws, and a window inside a block
    rows = rows.withColumn("block", F.floor(F.col("draw") / 65536))
    before = rows.groupBy("label", "subtype", "block").agg(F.count(F.lit(1)).alias("m")).withColumn("before", F.coalesce(F.sum("m").over(W.partitionBy("label", "subtype").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("m")
    numbered = rows.withColumn("at", F.row_number().over(W.partitionBy("label", "subtype", "block").orderBy("draw"))).join(before, ["label", "subtype", "block"])
    out = numbered.withColumn("number", F.col("before") + F.col("at")).join(F.broadcast(quotas.select("label", "subtype", "n")), ["label", "subtype"])
    return out.where(F.col("number") <= F.col("n")).select("label", "subtype", "number", "text", "style")


def completeness(rows: DataFrame, quotas: DataFrame, expected: DataFrame) -> DataFrame:
    """(check, item, n): what keeps a set (post_id, text, label, platform) from being complete.

    quota: posts a label and platform has too few (n > 0) or too many (n < 0), also of pairs that only one side knows. quotas: label, platform,
    n. missing_id, extra_id: expected (post_id) and present ids that the other side has not. label, empty_text, repeated_text, repeated_id:
    rows of no known label and without text, texts and ids that occur more than once."""
    have = rows.groupBy("label", "platform").agg(F.count(F.lit(1)).alias("have"))
    same = have["label"].eqNullSafe(quotas["label"]) & have["platform"].eqNullSafe(quotas["platform"])
    pair = lambda c: F.coalesce(quotas[c], have[c], F.lit("none"))
    gap = F.coalesce(quotas["n"], F.lit(0)) - F.coalesce("have", F.lit(0))
    out = have.join(quotas, same, "full").select(F.lit("quota").alias("check"), F.concat_ws("/", pair("label"), pair("platform")).alias("item"), gap.cast("long").alias("n")).where("n <> 0")
    ids = lambda df: df.select(F.col("post_id").cast("string").alias("item")).where("item IS NOT NULL").distinct()
    here, there = ids(rows), ids(expected)
    for name, a, b in (("missing_id", there, here), ("extra_id", here, there)):
        out = out.unionByName(a.join(b, "item", "left_anti").select(F.lit(name).alias("check"), "item", F.lit(1).cast("long").alias("n")))
    text = F.trim(F.coalesce("text", F.lit("")))
    flat = rows.agg(F.count_if(~F.coalesce(F.col("label").isin(*LABELS), F.lit(False))).alias("label"), F.count_if(text == "").alias("empty_text"))
    again = lambda key: rows.where(key != "").groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("m")).where("m > 1").agg(F.count(F.lit(1)).alias("n"))
    sums = [flat.select(F.lit(c).alias("check"), F.col(c).alias("n")) for c in ("label", "empty_text")]
    sums += [again(F.lower(text)).select(F.lit("repeated_text").alias("check"), "n"), again(F.col("post_id").cast("string")).select(F.lit("repeated_id").alias("check"), "n")]
    for s in sums:
        out = out.unionByName(s.where("n > 0").select("check", F.lit("").alias("item"), F.col("n").cast("long").alias("n")))
    return out


def missing_labels(rows: DataFrame, by: tuple[str, ...] = (), label: str = "label") -> DataFrame:
    """The labels that no row has, within each group of `by`; an empty result lets a builder go on."""
    groups = rows.select(*by).distinct() if by else rows.sparkSession.range(1).select()
    want = groups.select(*by, F.explode(F.array(*map(F.lit, LABELS))).alias("label"))
    have = rows.where(F.col(label).isin(*LABELS)).select(*by, F.col(label).alias("label")).distinct()
    match = want["label"] == have["label"]
    for c in by:
        match = match & want[c].eqNullSafe(have[c])
    return want.join(have, match, "left_anti")
