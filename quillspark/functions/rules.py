"""Rule predicates over cleaned text: banks of patterns to 0/1 columns, and the scores built from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lex
from .features import stance
from .text import FLAGS, first_hit, has

FLAG_NAMES = ("generalisation", "comparison", "preference", "coded_bias", "inequality_context", "soft_preference", "implicit_generalisation")


def critique(text: Column, words: str | None = None) -> Column:
    return has(text, lex.CRITIQUE, words)


def _near_group(text: Column, words: str | None = None) -> Column:
    """A tendency marker with a group term at most 90 characters away, or "in my experience" with one around it."""
    marker = FLAGS + lex.IMPLICIT_MARKER
    between, found = F.split(text, marker, -1), F.regexp_extract_all(text, F.lit(marker), F.lit(0))
    sizes = F.transform(F.arrays_zip(F.slice(between, 1, F.size(found)).alias("b"), found.alias("m")), lambda x: F.struct(F.length(x["b"]).alias("gap"), F.length(x["m"]).alias("own")))
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("yes"))

    def step(state: Column, x: Column) -> Column:
        lo = state["at"] + x["gap"]
        hi = lo + x["own"]
        first = F.greatest(lo - 90, F.lit(0))
        window = F.substring(text, first + 1, hi + 90 - first)
        return F.struct(hi.alias("at"), (state["yes"] | window.rlike(FLAGS + lex.GROUP_OR_PROXY)).alias("yes"))

    tendency = F.aggregate(sizes, start, step, lambda s: s["yes"])
    told = F.instr(F.lower(text), "in my experience") - 1
    first = F.greatest(told - 60, F.lit(0))
    around = F.substring(text, first + 1, told + 120 - first)
    experience = has(text, r"\bin\s+my\s+experience\b", words) & (told >= 0) & around.rlike(FLAGS + lex.GROUP_OR_PROXY)
    return has(text, lex.IMPLICIT_MARKER, words) & tendency | experience


def _explicit(text: Column, critical: Column, words: str | None = None) -> Column:
    st = stance(text, words)
    shape = has(text, lex.GENERALISATION_CUES + lex.EXTRA_GENERALISATION + lex.STRONG_GENERALISATION, words)
    harm = (
        has(text, (lex.NEGATIVE_EVALUATION, lex.PRESCRIPTION), words)
        | (st["attribution_assertion"] > 0) & ((st["sentiment_toward_group"] > 0) | (st["attribution_endorsement"] > 0) | (st["essentialist_claim_score"] > 0))
    )
    return ~has(text, lex.DEBIAS_GUARDS, words) & ~(critical & has(text, lex.META_REFERENCE, words)) & shape & harm


def flags(text: Column, words: str | None = None) -> dict[str, Column]:
    """The seven flags, each 0 or 1; all 0 for empty text. words: the name of a column with the text's index (factors.index), which saves most patterns."""
    t = F.trim(F.coalesce(text, F.lit("")))
    critical = critique(t, words)
    implicit = ~critical & _near_group(t, words)
    hard = has(t, lex.HARD_PREFERENCE + lex.ROLE_ASSIGNMENT, words) | has(t, lex.HIRING_CONTEXT, words) & has(t, lex.MIGRATION_SUBTEXT, words)
    values = (
        _explicit(t, critical, words) | implicit,
        has(t, lex.EXPLICIT_COMPARISON + lex.COMPARISON_CUES, words),
        hard,
        has(t, lex.CODED_EUPHEMISM, words),
        has(t, lex.INEQUALITY_TALK, words),
        has(t, lex.SOFT_PREFERENCE, words),
        implicit,
    )
    return {n: v.cast("int") for n, v in zip(FLAG_NAMES, values)}


def structure_score(f: dict[str, Column]) -> Column:
    return 0.4 * f["generalisation"] + 0.3 * f["comparison"] + 0.2 * f["preference"] + 0.1 * f["coded_bias"]


def _firsts(text: Column, bank: tuple[str, ...], most: int, words: str | None = None) -> Column:
    """The first match of each pattern that has one, cut to `most` characters."""
    each = F.array(*[F.trim(F.substring(first_hit(text, p, words), 1, most)) for p in bank])
    return F.filter(each, lambda x: x != "")


def structural_hits(text: Column, words: str | None = None) -> Column:
    return F.slice(F.array_distinct(_firsts(F.trim(text), lex.STRUCTURAL_TALK, 80, words)), 1, 5)


def workplace_criticism(text: Column, found: Column, words: str | None = None) -> Column:
    """Whether text talks about organisations rather than about groups of people."""
    low = F.lower(F.trim(text))
    named = low.contains("servant leadership") | low.contains("transformational leadership")
    other = has(text, lex.STRUCTURAL_STRONG, words) | (F.size(found) >= 2) | has(text, lex.WORKPLACE_ROLE, words) | has(text, lex.STRUCTURAL_WEAK, words)
    return (F.size(found) > 0) & (named | other)


def heuristics(text: Column, words: str | None = None) -> Column:
    """Struct of comparison and generalisation cues, their strength, the matched terms, and workplace criticism."""
    t = F.trim(F.coalesce(text, F.lit("")))
    comp, gen = _firsts(t, lex.COMPARISON_CUES, 64, words), _firsts(t, lex.GENERALISATION_CUES, 64, words)
    has_c, has_g = F.size(comp) > 0, F.size(gen) > 0
    terms = F.slice(F.array_distinct(F.transform(F.concat(comp, gen), lambda x: F.regexp_replace(x, r"\s+", " "))), 1, 4)
    found = structural_hits(t, words)
    workplace = workplace_criticism(t, found, words)
    more = F.when(workplace & ~has_c & ~has_g, F.array_union(terms, found)).otherwise(terms)
    strength = F.when(has_c & has_g, 1.0).when(has_c, 0.5).when(has_g, 0.4).otherwise(0.0)
    return F.struct(
        has_c.alias("has_comparison"),
        has_g.alias("has_generalization"),
        strength.alias("strength"),
        F.slice(more, 1, 5).alias("match_terms"),
        has(t, lex.INEQUALITY_TALK, words).alias("is_inequality_discussion"),
        workplace.alias("is_structural_workplace_criticism"),
        found.alias("structural_phrase_hits"),
    )


def critique_like(text: Column) -> Column:
    low = F.lower(text)
    any_of = lambda words: F.greatest(*[low.contains(w) for w in words])
    return any_of(lex.CRITIQUE_MARKERS) | low.contains("stereotype") & any_of(lex.CRITIQUE_OF_STEREOTYPE)


def ambiguous_tone(text: Column) -> Column:
    low = F.lower(text)
    return F.greatest(*[low.contains(w) for w in lex.AMBIGUOUS_MARKERS])


def bias_family(text: Column) -> Column:
    """The class that a harmful post is about, by its words."""
    return F.when(has(text, r"\b(women|men|female|male|gender)\b"), "gender_bias").when(has(text, r"\b(immigrant|foreign|nationality|visa|local candidates?)\b"), "nationality_bias").otherwise("profession_bias")
