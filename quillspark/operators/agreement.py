"""Agreement between raters and between systems, and significance of their differences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..labels import LABELS
from .metrics import cells


def fleiss_kappa(rows: DataFrame, raters: list[str]) -> DataFrame:
    """(n, p_bar, p_e, kappa, all_agree) for 0/1 columns of a constant number of raters; kappa is null if chance alone agrees."""
    k = len(raters)
    yes = sum((F.col(r).cast("long") for r in raters), F.lit(0).cast("long"))
    per = rows.select(yes.alias("yes")).groupBy("yes").agg(F.count(F.lit(1)).alias("m"))  # k + 1 rows
    agree = (F.col("yes") * (F.col("yes") - 1) + (k - F.col("yes")) * (k - F.col("yes") - 1)) / (k * (k - 1))
    sums = per.agg(F.sum("m").alias("n"), F.sum(F.col("m") * agree).alias("a"), F.sum(F.col("m") * F.col("yes")).alias("y"), F.sum(F.when(F.col("yes").isin(0, k), F.col("m")).otherwise(0)).alias("same"))
    share = F.col("y") / (F.col("n") * k)
    p_e = share * share + (1 - share) * (1 - share)
    out = sums.select("n", (F.col("a") / F.col("n")).alias("p_bar"), p_e.alias("p_e"), (F.col("same") / F.col("n")).alias("all_agree"))
    return out.select("n", "p_bar", "p_e", F.when(F.col("p_e") < 1 - 1e-14, (F.col("p_bar") - F.col("p_e")) / (1 - F.col("p_e"))).alias("kappa"), "all_agree")


# Names of the bands.
BANDS = ((0.0, "below chance for this sample"), (0.21, "slight agreement beyond chance"), (0.41, "fair agreement beyond chance"), (0.61, "moderate agreement beyond chance"), (0.81, "substantial agreement beyond chance"))


def kappa_band(kappa: Column) -> Column:
    out = F.when(kappa.isNull() | F.isnan(kappa), "undefined (chance-level category distribution)")
    for limit, name in BANDS:
        out = out.when(kappa < limit, name)
    return out.otherwise("almost perfect agreement beyond chance")


def cohen_kappa(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(n, observed, expected, kappa) of two columns of labels."""
    counted = pairs.where(F.col(a).isin(*LABELS) & F.col(b).isin(*LABELS)).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("m"))
    both = F.array(*[F.struct(F.sum(F.when(F.col("a") == k, F.col("m")).otherwise(0)).alias("x"), F.sum(F.when(F.col("b") == k, F.col("m")).otherwise(0)).alias("y")) for k in LABELS])
    sums = counted.agg(F.sum("m").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("m")).otherwise(0)).alias("same"), both.alias("margins"))
    expected = F.aggregate("margins", F.lit(0.0), lambda s, x: s + x["x"] * x["y"]) / (F.col("n") * F.col("n"))
    out = sums.select("n", (F.col("same") / F.col("n")).alias("observed"), expected.alias("expected"))
    return out.select("*", F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))).alias("kappa"))


def paired(gold: DataFrame, a: DataFrame, b: DataFrame, key: str = "post_id") -> DataFrame:
    """(key, gold, a, b) for the posts that the gold set and both systems have. gold: key, gold; a, b: key, pred."""
    own = lambda df, name: df.select(key, F.col("pred").alias(name))
    return gold.select(key, "gold").join(own(a, "a"), key).join(own(b, "b"), key)


def pair_agreement(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    same = F.col(a) == F.col(b)
    return pairs.agg(F.count_if(same).alias("agree"), F.count_if(~same).alias("disagree"))


def _lgamma(x: Column) -> Column:
    """ln gamma for x >= 1: Stirling's series seven places up."""
    z = x + 7
    rise = x
    for i in range(1, 7):
        rise = rise * (x + i)
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - F.log(rise)


TERMS = 1 << 16  # so many terms of the tail are made by one task


def mcnemar(rows: DataFrame) -> DataFrame:
    """(n10, n01, p_value): exact two-sided binomial test of two systems. rows: gold, pred_a, pred_b.

    The terms of the tail are rows, dealt out in ranges and summed. Below m / 2 - 20 sqrt(m) their sum is under e^-800, that is zero in
    double precision, so there are none."""
    a, b = F.col("pred_a") == F.col("gold"), F.col("pred_b") == F.col("gold")
    sums = rows.agg(F.count_if(a & ~b).alias("n10"), F.count_if(~a & b).alias("n01"))
    m, k = F.col("m"), F.col("k")
    sized = sums.select("n10", "n01", (F.col("n10") + F.col("n01")).alias("m"), F.least("n10", "n01").alias("k")).withColumn("low", F.greatest(F.lit(0), F.floor(m / 2 - 20 * F.sqrt(m))).cast("long"))
    ranges = sized.withColumn("at", F.explode_outer(F.when(k >= F.col("low"), F.sequence("low", k, F.lit(TERMS).cast("long"))))).repartition("at")
    terms = ranges.withColumn("i", F.explode_outer(F.sequence("at", F.least(F.col("at") + TERMS - 1, k))))
    x, i = m.cast("double"), F.col("i").cast("double")
    term = F.exp(_lgamma(x + 1) - _lgamma(i + 1) - _lgamma(x - i + 1) - x * F.log(F.lit(2.0)))
    tail = F.coalesce(F.sum(term), F.lit(0.0))
    return terms.groupBy("n10", "n01").agg(tail.alias("tail")).select("n10", "n01", F.when(F.col("n10") + F.col("n01") == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.col("tail"))).alias("p_value"))


def bootstrap_macro_f1(pairs: DataFrame, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(mean, low, high) of macro F1 under resampling. Only the cells of the confusion table matter, so each draw is one multinomial
    over at most 20 cells, whatever the number of rows."""
    table = cells(pairs).groupBy().agg(F.array_sort(F.collect_list(F.struct("gold", "pred", "n"))).alias("cells"))
    work = table.crossJoin(pairs.sparkSession.range(draws))  # one row by the draws

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                cs = row["cells"]
                if not cs:
                    continue
                n = np.array([c["n"] for c in cs])
                got = np.random.default_rng([seed, row["id"]]).multinomial(n.sum(), n / n.sum())
                gold, pred = np.array([c["gold"] for c in cs]), np.array([c["pred"] for c in cs])
                f = []
                for k in LABELS:
                    tp, den = got[(gold == k) & (pred == k)].sum(), got[gold == k].sum() + got[pred == k].sum()
                    f.append(2 * tp / den if den else 0.0)
                out.append(float(np.mean(f)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], ["f1"])

    got = work.mapInArrow(run, "f1 double")
    return got.agg(F.avg("f1").alias("f1_mean"), F.percentile("f1", 0.025).alias("f1_low"), F.percentile("f1", 0.975).alias("f1_high"))
