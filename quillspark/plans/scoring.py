"""Scoring posts end to end, and the reports that follow. What hangs on the text alone is worked out once for each distinct text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decisions, explain, factors, features, rules
from ..functions.text import clean_posts
from ..labels import LABELS, NEUTRAL, to_label
from ..operators import metrics


@dataclass(frozen=True)
class FusionModel:
    """A linear fusion model by value: feature means and scales, coefficients by class, and what follows it."""

    means: dict[str, float]
    scales: dict[str, float]
    coefficients: dict[str, dict[str, float]]
    intercepts: dict[str, float]
    thresholds: dict[str, float] | None = None
    margin: float | None = None
    platt_slopes: dict[str, float] | None = None
    platt_intercepts: dict[str, float] | None = None
    blend_primary: float = 0.0
    blend_auxiliary: float = 0.0
    names: tuple[str, ...] = field(default=features.CORE_NAMES)


def per_text(posts: DataFrame, derive: Callable[[DataFrame], DataFrame], text: str = "text") -> DataFrame:
    """posts with the columns that `derive` adds to a table of their texts. A post costs a shuffle, which is far less than the patterns that a
    text goes through, so each distinct text (null is one) goes through them once. Streams cannot meet themselves and are derived row by row."""
    if posts.isStreaming:
        return derive(posts)
    derived = derive(posts.select(text).distinct()).withColumnRenamed(text, "_of")
    return posts.drop(*derived.columns).join(derived, F.col(text).eqNullSafe(F.col("_of"))).drop("_of")


def with_signals(posts: DataFrame, text: str = "clean") -> DataFrame:
    """posts with structs flags, ling, stance, meth and heur, each computed once, the index of the text in _words_in, whether it is critical in
    _critical, and its salient words in _salient."""
    t, words = F.col(text), "_words_in"
    out = posts.withColumn("_words_in", factors.index(t))
    out = out.withColumn("flags", F.struct(*[c.alias(k) for k, c in rules.flags(t, words).items()]))
    f = {k: F.col(f"flags.{k}") for k in rules.FLAG_NAMES}
    named = lambda d: F.struct(*[c.alias(k) for k, c in d.items()])
    out = out.withColumns({"ling": named(features.linguistic(t, f, words)), "stance": named(features.stance(t, words)), "meth": named(features.methodology(t, words)), "heur": rules.heuristics(t, words)})
    return out.withColumns({"_critical": rules.critique(t, words), "_salient": explain.salient_words(t)})


def _struct(name: str, keys: tuple[str, ...]) -> dict[str, Column]:
    return {k: F.col(f"{name}.{k}") for k in keys}


def with_scores(posts: DataFrame, type_scores: DataFrame, hate_scores: DataFrame | None = None, temperature: float = 1.35, key: str = "post_id") -> DataFrame:
    """posts with `dist` (tempered class distribution of a head) and p_hate, 0 where there is none. type_scores: key and a column for each label."""
    out = posts.join(type_scores, key)
    tempered = decisions.temper({k: F.col(k) for k in LABELS}, temperature)
    out = out.withColumn("dist", F.struct(*[v.alias(k) for k, v in tempered.items()])).drop(*LABELS)
    if hate_scores is None:
        return out.withColumn("p_hate", F.lit(0.0))
    return out.join(hate_scores.select(key, "p_hate"), key, "left").withColumn("p_hate", F.coalesce("p_hate", F.lit(0.0)))


def decided(scored: DataFrame, model: FusionModel | None = None) -> DataFrame:
    """with bias_detected, bias_type and confidence; hand-tuned fusion where no model is given."""
    dist, flags = _struct("dist", LABELS), _struct("flags", rules.FLAG_NAMES)
    if model is None:
        got = decisions.fuse(dist, flags, F.col("p_hate"), F.col("clean"), "_words_in", F.col("_critical"))
        return scored.withColumns({**got, "confidence": decisions.clamped(got["confidence"])}).withColumn("posterior", F.lit(None).cast("struct<" + ",".join(f"{k}:double" for k in LABELS) + ">"))
    row = features.feature_row(dist, F.col("p_hate"), flags, rules.structure_score(flags), _struct("ling", features.LINGUISTIC), _struct("stance", features.STANCE), _struct("meth", features.METHODOLOGY))
    post = decisions.linear_posterior({k: row[k] for k in model.names}, model.means, model.scales, model.coefficients, model.intercepts)
    out = scored.withColumn("posterior", F.struct(*[post[k].alias(k) for k in LABELS]))
    p = decisions.blend(_struct("posterior", LABELS), dist, None, model.blend_primary, model.blend_auxiliary)
    if model.platt_slopes:
        p = decisions.platt(p, model.platt_slopes, model.platt_intercepts)
    out = out.withColumn("posterior", F.struct(*[p[k].alias(k) for k in LABELS]))
    held = _struct("posterior", LABELS)
    label = decisions.thresholded(held, model.thresholds, model.margin) if model.thresholds else decisions.best(held)["label"]
    out = out.withColumn("bias_type", label)
    mass = F.coalesce(*[F.when(F.col("bias_type") == k, held[k]) for k in LABELS])
    return out.withColumns({"bias_detected": F.when(F.col("bias_type") == NEUTRAL, "false").otherwise("true"), "confidence": decisions.clamped(mass)})


def score_posts(posts: DataFrame, type_scores: DataFrame, hate_scores: DataFrame | None = None, model: FusionModel | None = None, temperature: float = 1.35, trace: bool = False) -> DataFrame:
    """post_id, text, bias_detected, bias_type, confidence, important_words, explanation; with trace all signals too."""
    scored = decided(per_text(with_scores(posts, type_scores, hate_scores, temperature), lambda texts: with_signals(clean_posts(texts))), model)
    dist, flags = _struct("dist", LABELS), _struct("flags", rules.FLAG_NAMES)
    words = explain.important_words(F.col("clean"), F.col("bias_type"), F.col("bias_detected"), F.col("heur.match_terms"), F.col("p_hate"), salient=F.col("_salient"))
    out = scored.withColumns({"important_words": words, "explanation": explain.lines(F.col("bias_detected"), F.col("bias_type"), flags, F.col("p_hate"), dist)})
    return out.drop("_words_in", "_critical", "_salient") if trace else out.select("post_id", "text", "bias_detected", "bias_type", "confidence", "important_words", "explanation")


def evaluate(predictions: DataFrame, gold: DataFrame, key: str = "post_id") -> dict[str, DataFrame]:
    """Reports over predictions joined with gold by key, never by position."""
    pairs = predictions.join(gold.select(key, F.col("label").alias("gold")), key).withColumn("pred", to_label(F.col("bias_detected"), F.col("bias_type")))
    return {
        "multiclass": metrics.multiclass_summary(pairs),
        "per_class": metrics.class_report(pairs),
        "binary": metrics.binary_report(pairs),
        "confusion": metrics.confusion_matrix(pairs),
        "errors": metrics.errors(pairs).select(key, "text", "gold", "pred", "confidence"),
    }


def evaluate_sanity(predictions: DataFrame, slices: DataFrame, key: str = "post_id") -> dict[str, DataFrame]:
    rows = predictions.join(slices.select(key, "slice_type", "ambiguous_stance"), key).withColumn("pred", to_label(F.col("bias_detected"), F.col("bias_type")))
    rates = metrics.sanity_rates(rows)
    return {"rates": rates, "slices": metrics.sanity_by_slice(rows), "gate": metrics.acceptance(rates)}


def sanity_by_config(slices: DataFrame, configs: dict[str, Column]) -> DataFrame:
    """Sanity rates of several ways to decide, such as before and after calibration: configs gives a predicted label over the rows of each."""
    out = None
    for name, pred in configs.items():
        one = metrics.sanity_rates(slices.withColumn("pred", pred)).withColumn("config", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def evaluate_benchmark(items: DataFrame, type_scores: DataFrame) -> DataFrame:
    """Report by class of a head on benchmark sentences: its likeliest class against the label. items: text, label;
    type_scores: text, each once, and a column for each label."""
    pred = decisions.best({k: F.col(k) for k in LABELS})["label"]
    return metrics.class_report(items.select("text", F.col("label").alias("gold")).join(type_scores, "text").select("gold", pred.alias("pred")))


def stacked(rows: DataFrame, systems: dict[str, Column]) -> DataFrame:
    """(system, gold, pred) from rows that hold what all systems decide, in one pass over them."""
    each = F.array(*[F.struct(F.lit(k).alias("system"), c.alias("pred")) for k, c in systems.items()])
    return rows.select("gold", F.explode(each).alias("x")).select("x.system", "gold", "x.pred")


def compare_systems(predictions: DataFrame) -> DataFrame:
    """Multiclass metrics for each system. predictions: system, gold, pred."""
    return metrics.multiclass_summary(predictions, ("system",))
