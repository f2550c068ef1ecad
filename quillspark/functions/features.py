"""Scalar text features over cleaned text, and the fixed-order feature row for the fusion model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lex
from .text import has, hits, tokens

LINGUISTIC = ("group_presence", "soft_preference_norm", "hedging_rate", "polarity_gap", "implicit_x_group", "target_negative_sentiment", "exclusion_intent", "anti_stereotype_cue")
STANCE = ("group_target_present", "sentiment_toward_group", "attribution_assertion", "attribution_denial", "attribution_critique", "attribution_endorsement", "normative_language_score", "negation_scope_over_group", "essentialist_claim_score")
METHODOLOGY = ("nationality_cue", "profession_cue", "gender_axis_cue", "counter_speech_strength", "nationality_minus_profession", "civil_policy_framing")
RULES_IN_ROW = ("generalisation", "comparison", "preference", "coded_bias", "structure_score", "soft_preference", "implicit_generalisation", "inequality_context")
CLASSES = ("gender_bias", "nationality_bias", "profession_bias", "neutral")
CORE_NAMES = (
    *(f"distilbert_{c}" for c in CLASSES),
    "p_hate_roberta",
    *(n if n == "structure_score" else f"rule_{n}" for n in RULES_IN_ROW),
    *(f"lex_{n}" for n in LINGUISTIC),
    *(f"stance_{n}" for n in STANCE),
    *(f"meth_{n}" for n in METHODOLOGY),
)
AUX_NAMES = tuple(f"social_type_{c}" for c in CLASSES)
SCHEMA_VERSION = 6


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _number(flag: Column) -> Column:
    return flag.cast("double")


def linguistic(text: Column, flags: dict[str, Column], words_in: str | None = None) -> dict[str, Column]:
    t = F.trim(F.coalesce(text, F.lit("")))
    words = tokens(t)
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    among = lambda bank: F.size(F.filter(words, lambda w: w.isin(*bank))).cast("double")
    group = _unit(hits(t, lex.GROUP_WORDS, words_in) / F.greatest(F.lit(12.0), n * 0.25))
    negative = among(lex.NEGATIVE_WORDS)
    structural = F.greatest(*[flags[k] for k in ("generalisation", "comparison", "preference", "soft_preference", "coded_bias")])
    values = (
        group,
        _unit(hits(t, lex.SOFT_PREFERENCE_HIT, words_in) / F.greatest(F.lit(8.0), n * 0.2)),
        _unit((among(lex.HEDGE_WORDS) + hits(t, lex.HEDGE, words_in)) / F.greatest(F.lit(10.0), n)),
        _unit(F.greatest(F.lit(0.0), (among(lex.POSITIVE_WORDS) - negative) / n) * structural),
        _unit(flags["implicit_generalisation"] * group),
        _unit(negative / n * group),
        _number(has(t, lex.EXCLUSION, words_in)),
        _number(has(t, lex.ANTI_STEREOTYPE, words_in)),
    )
    return dict(zip(LINGUISTIC, values))


def stance(text: Column, words: str | None = None) -> dict[str, Column]:
    t = F.trim(F.coalesce(text, F.lit("")))
    group, denial, critical = has(t, lex.STANCE_GROUP, words), has(t, lex.DENIAL, words), has(t, lex.STEREOTYPE_CRITIQUE, words)
    values = (
        _number(group),
        F.when(group, F.least(F.lit(1.0), hits(t, lex.STANCE_NEGATIVE, words) / 2)).otherwise(0.0),
        _number(group & ~denial & ~critical),
        _number(denial),
        _number(critical),
        _number(has(t, lex.ENDORSEMENT, words)),
        F.least(F.lit(1.0), hits(t, lex.NORMATIVE, words) / 2),
        _number(group & has(t, lex.NEGATION, words)),
        _number(has(t, lex.ESSENTIALIST, words)),
    )
    return dict(zip(STANCE, values))


def methodology(text: Column, words: str | None = None) -> dict[str, Column]:
    t = F.trim(F.coalesce(text, F.lit("")))
    span = F.greatest(F.length(t) / 120.0, F.lit(1.0))
    cue = lambda p: F.least(F.lit(1.0), hits(t, p, words) / span)
    nation, work = cue(lex.NATIONALITY_CUES), cue(lex.PROFESSION_CUES)
    counter = F.least(F.lit(1.0), hits(t, lex.COUNTER_SPEECH, words) / 2)
    civil = _number(has(t, lex.POLICY_EVIDENCE, words)) * (1.0 - _number(has(t, lex.DEMEANING, words))) * (1.0 - 0.35 * counter)
    lean = F.when(t == "", 0.0).otherwise(_unit((nation - work + 1.0) / 2.0))
    return dict(zip(METHODOLOGY, (nation, work, cue(lex.GENDER_CUES), counter, lean, F.least(F.lit(1.0), civil))))


def feature_row(dist: dict[str, Column], p_hate: Column, flags: dict[str, Column], structure: Column, ling: dict[str, Column], st: dict[str, Column], meth: dict[str, Column], social: dict[str, Column] | None = None) -> dict[str, Column]:
    """36 named columns in fixed order, 40 with the distribution of a second head."""
    rule = {**flags, "structure_score": structure}
    values = [*(dist[c] for c in CLASSES), p_hate, *(rule[n] for n in RULES_IN_ROW), *(ling[n] for n in LINGUISTIC), *(st[n] for n in STANCE), *(meth[n] for n in METHODOLOGY)]
    out = {n: v.cast("double") for n, v in zip(CORE_NAMES, values)}
    if social:
        total = sum((F.greatest(F.lit(0.0), social[c]) for c in CLASSES), F.lit(0.0))
        out |= {n: F.when(total <= 0, 0.25).otherwise(F.greatest(F.lit(0.0), social[c]) / total) for n, c in zip(AUX_NAMES, CLASSES)}
    return out
