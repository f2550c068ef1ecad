"""Evaluation as aggregations: everything about classes follows from the cells of one confusion table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.rules import ambiguous_tone, critique_like
from ..labels import BIAS, LABELS, NEUTRAL, to_binary

def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def _labels(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, k) for i, k in enumerate(LABELS)], "label_no int, label string")


def label_counts(rows: DataFrame, label: str = "label") -> DataFrame:
    """(label, n), 0 for a class that does not occur."""
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(_labels(rows)).join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cells(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, gold, pred, n) for rows whose gold label is one of the four; another prediction becomes `unknown`."""
    pred = F.when(F.col("pred").isin(*LABELS), F.col("pred")).otherwise("unknown")
    return pairs.where(F.col("gold").isin(*LABELS)).groupBy(*by, "gold", pred.alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(pairs: DataFrame) -> DataFrame:
    """One row for each gold class, one column for each predicted class."""
    counted = cells(pairs).groupBy("gold").pivot("pred", list(LABELS)).agg(F.sum("n"))
    full = F.broadcast(_labels(pairs)).join(counted, F.col("label") == F.col("gold"), "left")
    return full.select(F.col("label").alias("gold"), *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in LABELS])


def matrix_text(matrix: DataFrame) -> DataFrame:
    """The matrix as lines of text, in label order."""
    order = F.array_position(F.array(*map(F.lit, LABELS)), F.col("gold"))
    return matrix.select(order.cast("int").alias("line"), F.concat_ws(" ", *LABELS).alias("text"))


def class_report(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, label, precision, recall, f1, support) for each class."""
    c = cells(pairs, by).crossJoin(F.broadcast(_labels(pairs)))  # at most 20 cells by 4 labels for each group
    hit = (F.col("gold") == F.col("label")) & (F.col("pred") == F.col("label"))
    sums = c.groupBy(*by, "label").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("pred") == F.col("label"), F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when(F.col("gold") == F.col("label"), F.col("n")).otherwise(0)).alias("support"),
    )
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return sums.select(*by, "label", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"), "support", "tp", "predicted")


def multiclass_summary(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, accuracy, macro, weighted and micro precision, recall and F1)."""
    r = class_report(pairs, by)
    n = F.sum("support")
    weighted = lambda c: ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"{c}_weighted")
    micro_p, micro_r = ratio(F.sum("tp"), F.sum("predicted")), ratio(F.sum("tp"), F.sum("support"))
    out = r.groupBy(*by) if by else r
    return out.agg(
        n.alias("n"),
        ratio(F.sum("tp"), n).alias("accuracy"),
        *[F.avg(c).alias(f"{c}_macro") for c in ("precision", "recall", "f1")],
        *[weighted(c) for c in ("precision", "recall", "f1")],
        micro_p.alias("precision_micro"),
        micro_r.alias("recall_micro"),
        f1(micro_p, micro_r).alias("f1_micro"),
    )


def binary_report(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Bias against neutral: the 2 x 2 cells, accuracy, precision, recall and F1. Gold labels outside the four are left out."""
    g, p = to_binary(F.col("gold")), to_binary(F.col("pred"))
    rows = pairs.where(F.col("gold").isin(*LABELS)).select(*by, g.alias("g"), p.alias("p"))
    count = lambda a, b: F.count_if((F.col("g") == a) & (F.col("p") == b))
    sums = (rows.groupBy(*by) if by else rows).agg(count(0, 0).alias("tn"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(1, 1).alias("tp"))
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    pr, rc = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select(*by, n.alias("n"), "tn", "fp", "fn", "tp", ratio(F.col("tp") + F.col("tn"), n).alias("accuracy"), pr.alias("precision"), rc.alias("recall"), f1(pr, rc).alias("f1"))


INNOCENT = ("neutral_policy", "positive_group")
HARMFUL = "explicit_or_implicit_bias"


def not_ambiguous(column: str = "ambiguous_stance") -> Column:
    return ~F.coalesce(F.lower(F.trim(F.col(column).cast("string"))).isin("1", "true", "yes"), F.lit(False))


def sanity_rates(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """False positives on innocent slices, false negatives on the harmful one, and stance-aware accuracy. rows: slice_type, pred, ambiguous_stance,
    and what they are grouped by."""
    r = rows.where(not_ambiguous())
    quiet, loud = F.col("slice_type").isin(*INNOCENT), F.col("slice_type") == HARMFUL
    found = F.col("pred") != NEUTRAL
    sums = r.groupBy(*by).agg(F.count_if(quiet & found).alias("fp"), F.count_if(quiet).alias("fp_denom"), F.count_if(loud & ~found).alias("fn"), F.count_if(loud).alias("fn_denom"))
    right = F.col("fp_denom") - F.col("fp") + F.col("fn_denom") - F.col("fn")
    return sums.select("*", ratio(F.col("fp"), F.col("fp_denom")).alias("fpr"), ratio(F.col("fn"), F.col("fn_denom")).alias("fnr"), ratio(right, F.col("fp_denom") + F.col("fn_denom")).alias("stance_aware_accuracy"))


def sanity_by_slice(rows: DataFrame) -> DataFrame:
    """(slice_type, n, errors, rate), and a row for all slices together."""
    wrong = F.when(F.col("slice_type").isin(*INNOCENT), F.col("pred") != NEUTRAL).otherwise(F.col("pred") == NEUTRAL)
    r = rows.where(not_ambiguous() & F.col("slice_type").isin(*INNOCENT, HARMFUL)).withColumn("wrong", wrong)
    return r.rollup("slice_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("wrong").alias("errors")).select(F.coalesce("slice_type", F.lit("all")).alias("slice_type"), "n", "errors", ratio(F.col("errors"), F.col("n")).alias("rate"))


def acceptance(rates: DataFrame, fpr_max: float = 0.20, fnr_max: float = 0.20) -> DataFrame:
    return rates.select("fpr", "fnr", ((F.col("fpr") <= fpr_max) & (F.col("fnr") <= fnr_max)).alias("accepted"))


def calibration_bins(rows: DataFrame, n_bins: int = 10) -> DataFrame:
    """(bin, lo, hi, mid, n, acc): accuracy by confidence, empty bins included, the last bin closed. rows: gold, pred, confidence."""
    which = F.least(F.lit(n_bins - 1), F.floor(F.col("confidence") * n_bins)).cast("int")
    counted = rows.groupBy(which.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("gold") == F.col("pred")).cast("double")).alias("acc"))
    every = rows.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    lo = F.col("bin") / n_bins
    return every.join(counted, "bin", "left").select("bin", lo.alias("lo"), (lo + 1 / n_bins).alias("hi"), (lo + 0.5 / n_bins).alias("mid"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("acc", F.lit(0.0)).alias("acc"))


def fairness(pairs: DataFrame) -> DataFrame:
    """How evenly the three bias classes are found."""
    r = class_report(pairs).where(F.col("label").isin(*BIAS))
    sums = r.agg(F.max("f1").alias("best_group_f1"), F.min("f1").alias("worst_group_f1"), F.max("recall").alias("hi"), F.min("recall").alias("lo"))
    share = ratio(F.col("lo"), F.col("hi"))
    return sums.select("best_group_f1", "worst_group_f1", (F.col("best_group_f1") - F.col("worst_group_f1")).alias("disparity_f1"), share.alias("four_fifths_recall_ratio"), (share >= 0.8).alias("four_fifths_passes"))


BUCKETS = ("cross_type_confusion", "critique_vs_endorsement", "neutral_mention_vs_stereotype", "ambiguous_tone", "other")


def errors(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("gold") != F.col("pred"))


def error_taxonomy(rows: DataFrame) -> DataFrame:
    """(bucket, n, pct) of the errors. rows: gold, pred, text."""
    g, p = F.col("gold"), F.col("pred")
    bucket = (
        F.when(g.isin(*BIAS) & p.isin(*BIAS), BUCKETS[0])
        .when(critique_like(F.col("text")), BUCKETS[1])
        .when((g == NEUTRAL) != (p == NEUTRAL), BUCKETS[2])
        .when(ambiguous_tone(F.col("text")), BUCKETS[3])
        .otherwise(BUCKETS[4])
    )
    counted = errors(rows).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    full = every.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return full.withColumn("pct", ratio(100.0 * F.col("n"), F.sum("n").over(W.partitionBy())))  # five rows


def error_summary(rows: DataFrame) -> DataFrame:
    """(system, fp, fn): bias called on neutral posts, and bias missed. rows: system, gold, pred."""
    return rows.groupBy("system").agg(F.count_if((F.col("gold") == NEUTRAL) & (F.col("pred") != NEUTRAL)).alias("fp"), F.count_if((F.col("gold") != NEUTRAL) & (F.col("pred") == NEUTRAL)).alias("fn"))


def throughput(n: Column, latency_ms: Column) -> Column:
    return F.when(latency_ms > 1e-6, n / (latency_ms / 1000.0))


def long_scores(rows: DataFrame, scores: dict[str, str]) -> DataFrame:
    """(label, positive, score): one row for each post and class."""
    pairs = F.array(*[F.struct(F.lit(k).alias("label"), F.col(c).cast("double").alias("score")) for k, c in scores.items()])
    return rows.where(F.col("gold").isin(*LABELS)).select("gold", F.explode(pairs).alias("x")).select("x.label", (F.col("gold") == F.col("x.label")).cast("int").alias("positive"), "x.score")


RANGES = 256


def _range_of(score: Column, bounds: Column) -> Column:
    """How many of the 255 bounds, which are in order, lie below the score: eight halvings."""
    steps = F.array(*(F.lit(1 << k) for k in range(7, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.element_at(bounds, at + s) < score, at + s).otherwise(at))


def _by_score(rows: DataFrame) -> DataFrame:
    """Positives and negatives of each distinct score, and of all higher and lower ones (tp, fp), and of its label (p, n).

    Equal scores meet first. Distinct scores fall into ranges of about equal size; sums of whole ranges give each range what
    lies above it, and windows only run inside a range of a label."""
    at = rows.groupBy("label", "score").agg(F.sum("positive").alias("pos"), F.sum(1 - F.col("positive")).alias("neg"))
    bounds = at.groupBy(F.col("label").alias("_label")).agg(F.percentile_approx("score", [k / RANGES for k in range(1, RANGES)], 10 * RANGES).alias("bounds"))
    placed = at.join(bounds, F.col("label").eqNullSafe(F.col("_label"))).select("label", "score", "pos", "neg", _range_of(F.col("score"), F.col("bounds")).alias("r"))
    sums = placed.groupBy("label", "r").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    above, whole = W.partitionBy("label").orderBy(F.desc("r")).rowsBetween(W.unboundedPreceding, -1), W.partitionBy("label")
    over = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    sums = sums.select(F.col("label").alias("_label"), F.col("r").alias("_r"), over("_pos", above).alias("_tp"), over("_neg", above).alias("_fp"), over("_pos", whole).alias("p"), over("_neg", whole).alias("n"))
    down = W.partitionBy("label", "r").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    inside = placed.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down)})
    out = inside.join(sums, F.col("label").eqNullSafe(F.col("_label")) & (F.col("r") == F.col("_r")))
    return out.select("label", "score", "pos", "neg", (F.col("tp") + F.col("_tp")).alias("tp"), (F.col("fp") + F.col("_fp")).alias("fp"), "p", "n")


def roc_auc(rows: DataFrame) -> DataFrame:
    """(label, auc): chance that a positive scores above a negative, ties half. rows: label, positive, score."""
    c = _by_score(rows)
    below = F.col("n") - F.col("fp")
    return c.groupBy("label").agg(F.sum(F.col("pos") * (below + 0.5 * F.col("neg"))).alias("u"), F.first("p").alias("p"), F.first("n").alias("n")).select("label", F.when(F.col("p") * F.col("n") > 0, F.col("u") / (F.col("p") * F.col("n"))).alias("auc"))


def pr_auc(rows: DataFrame) -> DataFrame:
    """(label, average_precision) over distinct scores. rows: label, positive, score."""
    c = _by_score(rows)
    return c.groupBy("label").agg(F.sum(F.col("pos") / F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("average_precision"))


def coefficient_groups(coefficients: DataFrame) -> DataFrame:
    """(feature_group, mean_abs). coefficients: class, feature_group, value."""
    return coefficients.groupBy("feature_group").agg(F.avg(F.abs("value")).alias("mean_abs"))


def quota_violations(rows: DataFrame, per_label: int, least_chars: int = 1) -> DataFrame:
    """(check, item, n): classes that miss their quota, empty texts, repeated texts and ids. rows: post_id, text, label."""
    counts = label_counts(rows).where(F.col("n") != per_label).select(F.lit("class_count").alias("check"), F.col("label").alias("item"), "n")
    short = rows.where(F.length(F.trim(F.coalesce("text", F.lit("")))) < least_chars).agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("empty_text").alias("check"), F.lit("").alias("item"), "n")
    texts = rows.groupBy(F.lower("text").alias("t")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("repeated_text").alias("check"), F.lit("").alias("item"), "n")
    ids = rows.groupBy("post_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("repeated_id").alias("check"), F.lit("").alias("item"), "n")
    return counts.unionByName(short).unionByName(texts).unionByName(ids)
