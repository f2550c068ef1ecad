"""Class distributions, fusion and decisions as column expressions. A distribution is a dict of label to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..labels import BIAS, LABELS, NEUTRAL
from .rules import critique, structure_score

Dist = dict[str, Column]


def _sum(columns) -> Column:  # noqa: ANN001
    columns = list(columns)
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def temper(dist: Dist, temperature: float) -> Dist:
    """p^(1/T), renormalised; T is 0.5 at least. Where T is 1 and the sum is 1 but for rounding, shares stay as they are to the last bit."""
    power = 1.0 / max(temperature, 0.5)
    raised = {k: F.pow(F.greatest(F.lit(1e-9), p), F.lit(power)) for k, p in dist.items()}
    total = _sum(raised.values())
    if power == 1:
        total = F.when(F.abs(total - 1) < 1e-12, 1.0).otherwise(total)
    return {k: p / total for k, p in raised.items()}


def normalised(dist: Dist) -> Dist:
    """Negative shares count as 0; nothing at all becomes uniform."""
    held = {k: F.greatest(F.lit(0.0), dist[k]) for k in LABELS}
    total = _sum(held.values())
    return {k: F.when(total <= 0, 1.0 / len(LABELS)).otherwise(p / total) for k, p in held.items()}


def best(dist: Dist, labels: tuple[str, ...] = LABELS) -> Column:
    """Struct (p, label) of the largest share; ties go to the first label."""
    return F.array_max(F.array(*[F.struct(dist[k].alias("p"), F.lit(-i).alias("order"), F.lit(k).alias("label")) for i, k in enumerate(labels)]))


def intent(p_hate: Column) -> Column:
    return F.when(p_hate > 0.75, "hostile").when(p_hate < 0.2, "non_hostile").otherwise("uncertain")


def fuse(dist: Dist, flags: Dist, p_hate: Column, text: Column, words: str | None = None, critical: Column | None = None) -> dict[str, Column]:
    """Hand-tuned fusion: bias_detected (true, false or uncertain), bias_type, confidence, base_score, and what led there. critical: what
    rules.critique says of the text, where that is known."""
    structure = structure_score(flags)
    top = best(dist, BIAS)
    tone = intent(p_hate)
    guarded = (structure > 0) & (p_hate < 0.2) & (critique(text, words) if critical is None else critical)
    shift = F.when(tone == "hostile", 0.15).when((tone == "non_hostile") & (structure == 0), -0.2).otherwise(0.0)
    score = 0.65 * top["p"] + 0.35 * structure + shift - F.when(guarded, 0.25).otherwise(0.0)
    # rounded far below any weight, so that cut-offs do not hang on the order of additions
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 9)
    found = F.when(score >= 0.6, "true").when(score <= 0.4, "false").otherwise("uncertain")
    return {
        "bias_detected": found,
        "bias_type": F.when(found == "true", top["label"]).otherwise(NEUTRAL),
        "confidence": F.greatest(F.lit(0.5), F.least(F.lit(0.95), score)),
        "base_score": score,
        "bias_strength": top["p"],
        "structure_score": structure,
        "intent": tone,
        "safeguard_applied": guarded,
    }


def linear_posterior(features: dict[str, Column], means: dict[str, float], scales: dict[str, float], coefficients: dict[str, dict[str, float]], intercepts: dict[str, float]) -> Dist:
    """Standardise, linear scores, softmax; a column of no variance (scale 0) counts as 0."""
    z = {k: (features[k] - means[k]) / scales[k] if scales[k] else F.lit(0.0) for k in features}
    scores = {c: _sum([F.lit(intercepts[c]), *(z[k] * w for k, w in ws.items())]) for c, ws in coefficients.items()}
    top = F.greatest(*scores.values())
    e = {c: F.exp(s - top) for c, s in scores.items()}
    total = _sum(e.values())
    return {c: x / total for c, x in e.items()}


def blend(posterior: Dist, primary: Dist, auxiliary: Dist | None = None, w_primary: float = 0.10, w_auxiliary: float = 0.35) -> Dist:
    """Posterior mixed with one or two head distributions; weights are clamped to 0.5 and 0.7. Each is brought to a sum of 1 first, if it
    is not 1 but for rounding."""
    w_p, w_a = min(max(w_primary, 0.0), 0.5), min(max(w_auxiliary, 0.0), 0.7)
    if w_p + w_a == 0:
        return posterior

    def unit(d: Dist) -> Dist:
        total = _sum(d[k] for k in LABELS)
        return {k: F.when(F.abs(total - 1) < 1e-12, d[k]).when(total > 0, d[k] / total).otherwise(1.0 / len(LABELS)) for k in LABELS}

    held = _sum(posterior[k] for k in LABELS)
    kept = F.when(F.abs(held - 1) < 1e-12, F.lit(1.0)).otherwise(F.greatest(held, F.lit(1e-12)))
    first, second = unit(primary), unit(auxiliary) if auxiliary else None
    mixed = {k: max(0.0, 1 - w_p - w_a) * posterior[k] / kept + w_p * first[k] + (w_a * second[k] if second else F.lit(0.0)) for k in LABELS}
    total = F.greatest(_sum(mixed.values()), F.lit(1e-12))
    return {k: v / total for k, v in mixed.items()}


def platt(posterior: Dist, slopes: dict[str, float], intercepts: dict[str, float]) -> Dist:
    """One-vs-rest calibration of each class's logit, floored at 1e-9 and renormalised."""

    def one(k: str) -> Column:
        p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), posterior[k]))
        return F.greatest(F.lit(1e-9), 1.0 / (1.0 + F.exp(-(slopes[k] * F.log(p / (1.0 - p)) + intercepts[k]))))

    q = {k: one(k) for k in LABELS}
    total = _sum(q.values())
    return {k: v / total for k, v in q.items()}


def thresholded(posterior: Dist, thresholds: dict[str, float], margin: float | None = None) -> Column:
    """The largest class that reaches its threshold, ties by name; neutral if none does, or if the best bias class does not
    exceed neutral by the margin."""
    rows = F.array(*[F.struct((-posterior[k]).alias("minus"), F.lit(k).alias("label"), (posterior[k] >= thresholds[k]).alias("ok")) for k in LABELS])
    passing = F.filter(rows, lambda x: x["ok"])
    first = F.array_min(passing)["label"]
    if not margin or margin <= 0:
        return F.coalesce(first, F.lit(NEUTRAL))
    lead = -F.array_min(F.transform(F.filter(passing, lambda x: x["label"] != NEUTRAL), lambda x: x["minus"]))
    return F.when(F.size(passing) == 0, NEUTRAL).when(lead - posterior[NEUTRAL] < margin, NEUTRAL).otherwise(first)


def clamped(confidence: Column) -> Column:
    """Into [0.5, 0.95], three places, half to even as Python rounds."""
    return F.bround(F.greatest(F.lit(0.5), F.least(F.lit(0.95), confidence)), 3)


def rule_only(flags: Dist, text: Column, words: str | None = None, critical: Column | None = None) -> dict[str, Column]:
    """Baseline from rules alone: the hand-tuned fusion of a head that says neutral, without hate."""
    got = fuse({k: F.lit(1.0 if k == NEUTRAL else 0.0) for k in LABELS}, flags, F.lit(0.0), text, words, critical)
    return {"pred": got["bias_type"], "base_score": got["base_score"], "confidence": got["confidence"]}


def rule_linguistic(flags: Dist, ling: Dist, meth: Dist) -> dict[str, Column]:
    """Baseline from rules and lexical features alone."""
    structure = structure_score(flags)
    mass = _sum(flags.values()) / 7.0
    activity = 0.28 * structure + 0.18 * mass + 0.22 * (ling["group_presence"] + ling["exclusion_intent"] + ling["soft_preference_norm"]) / 3.0 + 0.32 * F.greatest(meth["gender_axis_cue"], meth["nationality_cue"], meth["profession_cue"])
    activity = F.round(activity, 9)
    scores = {
        "gender_bias": F.round(meth["gender_axis_cue"] + 0.15 * ling["group_presence"] + 0.12 * flags["coded_bias"], 9),
        "nationality_bias": F.round(meth["nationality_cue"] + 0.15 * flags["preference"] + 0.1 * structure, 9),
        "profession_bias": F.round(meth["profession_cue"] + 0.15 * flags["comparison"] + 0.1 * structure, 9),
    }
    top = best(scores, BIAS)
    quiet = activity < 0.42
    return {
        "activity": activity,
        "pred": F.when(quiet, NEUTRAL).otherwise(top["label"]),
        "confidence": F.when(quiet, F.least(F.lit(0.92), 0.52 + 0.15 * activity)).otherwise(F.least(F.lit(0.95), 0.55 + 0.35 * top["p"])),
    }


def head_label(raw: Column, p: Column, least: float = 0.5) -> Column:
    """Label of a head whose names may be LABEL_n; below `least` it is neutral."""
    n = F.regexp_extract(raw, r"^LABEL_(\d)$", 1)
    name = F.when(n != "", F.element_at(F.array(*map(F.lit, LABELS)), F.least(n.cast("int"), F.lit(3)) + 1)).otherwise(F.lower(F.trim(raw)))
    return F.when(p < least, NEUTRAL).otherwise(F.when(name.isin(*LABELS), name).otherwise(NEUTRAL))


def sentiment(raw: Column) -> Column:
    low = F.lower(F.trim(raw))
    return F.when(low.isin("label_2", "pos", "positive") | low.contains("pos"), "positive").when(low.isin("label_0", "neg", "negative") | low.contains("neg"), "negative").otherwise("neutral")
