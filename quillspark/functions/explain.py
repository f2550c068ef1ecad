"""Explanations of decisions: lines of text, salient words, and attributions from word pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..labels import BIAS, NEUTRAL
from . import lexicons as lex
from .decisions import Dist, best

WORD = r"\b[0-9a-zA-Z][0-9a-zA-Z\-'’]+\b"

# The lines as users of the engine know them.
RULE_LINES = {
    "generalisation": "Generalisation or group-level phrasing detected (e.g. 'X are …').",
    "implicit_generalisation": "Hedged tendency phrasing tied to a group or role proxy (implicit generalisation cue).",
    "comparison": "Comparative or ranking phrasing (e.g. 'better than' / performance claims).",
    "preference": "Hard preference or hiring-frame language (shortlist, locals-first, migration/hiring combos, role 'should').",
    "soft_preference": "Soft evaluative or 'fit' language (smooth hire, polish, dynamics, executive presence).",
    "coded_bias": "Coded organisational euphemisms (culture fit, pedigree, low-risk hire, polish, etc.).",
}
CONTEXT_LINE = "Discusses inequality or bias in context; model still points to a specific bias class here."
HEAD_LINE = "Semantic head indicates a group / role bias signal for this post."
HOSTILE_LINE = "Hostile or highly charged tone (RoBERTa intent calibration) increases confidence in harm potential."
CALM_LINE = "Low hate-probability: primary signal is group/role stereotyping, not general toxicity."
UNCERTAIN_LINES = (
    "Score fell in the border band (0.4–0.6): combined model and structure evidence is mixed.",
    "Treat as low confidence; consider context, author intent, and follow-up moderation review.",
)
QUIET_LINES = (
    "No strong generalisation, comparison, or preference pattern met the fusion threshold.",
    "Low combined score from the DistilBERT bias head and the linguistic structure layer.",
)
DISCUSSION_LINE = "Reads partly like inequality or bias-in-society discussion rather than endorsing a stereotype."


def lines(found: Column, bias_type: Column, flags: Dist, p_hate: Column, dist: Dist, lead: Column | None = None) -> Column:
    """At most six lines. lead: a first line about the fusion model, null where the hand-tuned fusion decided."""
    first = lead if lead is not None else F.lit(None).cast("string")
    rules = F.array_compact(F.array(first, *[F.when(flags[k] > 0, line) for k, line in RULE_LINES.items()]))
    calm_context = (flags["inequality_context"] > 0) & (p_hate < 0.35)
    base = F.when(F.size(rules) > 0, rules).otherwise(F.array(F.when(calm_context, CONTEXT_LINE).otherwise(HEAD_LINE)))
    top = best(dist, BIAS)
    human = F.regexp_replace(top["label"], "_", " ")
    strongest = F.when((top["label"] == bias_type) & (top["p"] > 0.2), F.concat(F.lit("Model distribution is strongest for "), human, F.lit(" (core semantic signal).")))
    tone = F.when(p_hate > 0.75, HOSTILE_LINE).when(p_hate < 0.2, CALM_LINE)
    yes = F.slice(F.array_distinct(F.concat(base, F.array_compact(F.array(strongest, tone)))), 1, 6)
    trivial = F.when(top["p"] >= 0.35, F.concat(F.lit("Bias-class probability was non-trivial ("), human, F.lit(") but below the fused decision cutoff.")))
    opening = F.when(first.isNotNull(), F.array(first)).otherwise(F.array(*map(F.lit, QUIET_LINES)))
    no = F.concat(opening, F.array_compact(F.array(trivial, F.when(calm_context, DISCUSSION_LINE))))
    return F.when(found == "true", yes).when(found == "uncertain", F.array(*map(F.lit, UNCERTAIN_LINES))).otherwise(no)


def content_words(text: Column) -> Column:
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    return F.filter(words, lambda w: ~F.lower(w).isin(*lex.SALIENT_STOP_WORDS) & ((F.length(w) >= 3) | F.lower(w).isin(*lex.SHORT_WORDS_KEPT)))


def _first_by_lower(words: Column) -> Column:
    """Keeps the first of words that differ in case alone."""
    both = F.array(F.struct(words.alias("as_is"), F.transform(words, F.lower).alias("low")))  # made once, not for each word
    return F.element_at(F.transform(both, lambda x: F.filter(x["as_is"], lambda w, i: F.array_position(x["low"], F.lower(w)) == i + 1)), 1)


def salient_words(text: Column, k: int = 5) -> Column:
    """Long and capitalised words first, stable, without repeats; for text without such words its first tokens or its start."""
    words = content_words(text)
    score = lambda w: F.length(w) * 0.3 + F.when(F.substring(w, 1, 1) != F.lower(F.substring(w, 1, 1)), 2.0).otherwise(0.0) + F.when(w.rlike("[A-Z]"), 1.0).otherwise(0.0) + F.when(F.length(w) >= 6, 1.0).otherwise(0.0)
    ranked = F.transform(F.array_sort(F.transform(words, lambda w, i: F.struct(F.round(-score(w), 6).alias("s"), i.alias("i"), w.alias("w")))), lambda x: x["w"])
    plain = F.slice(F.filter(F.split(F.trim(text), r"\s+"), lambda w: F.length(w) > 1), 1, k)
    spare = F.when(F.size(plain) > 0, plain).otherwise(F.array(F.trim(F.substring(text, 1, 32))))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).when(F.size(words) > 0, F.slice(_first_by_lower(ranked), 1, k)).otherwise(spare)


def important_words(text: Column, bias_type: Column, found: Column, terms: Column, p_hate: Column, attributed: Column | None = None, k: int = 5, salient: Column | None = None) -> Column:
    """Attributed words, matched terms, a word for the tone, salient words; without repeats; empty unless a bias was found. salient: the
    salient words of the text, where they are known."""
    words = F.concat(attributed, F.array_except(terms, attributed)) if attributed is not None else terms
    tone = F.when(p_hate >= 0.78, "toxic").otherwise("hostile")
    loud = (p_hate >= 0.7) & ((F.size(words) == 0) | (p_hate >= 0.85))
    words = F.concat(words, F.when(loud, F.array(tone)).otherwise(F.array().cast("array<string>")), salient_words(text, k) if salient is None else salient)
    out = F.slice(_first_by_lower(words), 1, max(2, min(k, 6)))
    return F.when((found == "true") & (bias_type != NEUTRAL), out).otherwise(F.array().cast("array<string>"))


def hint(bias_type: Column) -> Column:
    out = F.lit(lex.OTHER_HINT)
    for k, v in lex.HINTS.items():
        out = F.when(bias_type == k, v).otherwise(out)
    return out


def merge_pieces(pieces: DataFrame, key: str = "post_id", position: str = "position", token: str = "token", score: str = "score") -> DataFrame:
    """(key, word_no, word, score): pieces that start with ## join the piece before, their scores add up. One window for each post."""
    t = F.trim(F.col(token))
    rows = pieces.where(t != "").withColumn("_t", t)
    head = (~F.col("_t").startswith("##")).cast("int")
    number = F.sum(head).over(W.partitionBy(key).orderBy(position).rowsBetween(W.unboundedPreceding, 0))
    part = F.struct(F.col(position).alias("at"), F.regexp_replace("_t", "^##", "").alias("t"))
    words = rows.withColumn("word_no", number).groupBy(key, "word_no").agg(F.array_sort(F.collect_list(part)).alias("p"), F.sum(score).alias("score"))
    return words.select(key, "word_no", F.array_join(F.transform("p", lambda x: x["t"]), "").alias("word"), "score")


def top_attributions(words: DataFrame, k: int = 5, key: str = "post_id") -> DataFrame:
    """(key, rank, word, score): the k best words of each post that are no noise, stop word or punctuation and score above 0."""
    low = F.lower("word")
    good = words.where((F.col("word") != "") & ~F.col("word").isin(*lex.NOISE_TOKENS) & ~low.isin(*lex.ATTRIBUTION_STOP_WORDS) & ~F.col("word").rlike(r"^[^\w]+$") & (F.col("score") > 0))
    order = [F.desc("score"), "word_no"]
    once = good.withColumn("_n", F.row_number().over(W.partitionBy(key, low).orderBy(*order))).where("_n = 1")
    return once.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k).select(key, "rank", "word", "score")


def linear_attributions(posts: DataFrame, weights: DataFrame, key: str = "post_id", text: str = "clean", label: str = "bias_type") -> DataFrame:
    """(key, word_no, word, score): each word's share in a linear text classifier's score of the post's class.

    weights: (label, word, weight). The score of a word is its count in the post times its weight."""
    from .text import tokens

    flat = posts.select(key, F.col(label).alias("label"), F.posexplode(tokens(F.col(text))).alias("at", "word"))
    counted = flat.groupBy(key, "label", "word").agg(F.min("at").alias("word_no"), F.count(F.lit(1)).alias("n"))
    return counted.join(weights, ["label", "word"]).select(key, "word_no", "word", (F.col("n") * F.col("weight")).alias("score"))


def top_of_posts(posts: DataFrame, weights: DataFrame, k: int = 5, key: str = "post_id", text: str = "clean", label: str = "bias_type") -> DataFrame:
    """(key, rank, word, score): top_attributions of linear_attributions. Posts of one text and label share their words, which are found once."""
    about = F.struct(F.col(text).alias("text"), F.col(label).alias("label"))
    each = posts.select(about.alias("about")).distinct().select("about", F.col("about.text").alias(text), F.col("about.label").alias(label))
    best = top_attributions(linear_attributions(each, weights, "about", text, label), k, "about")
    lists = best.groupBy(F.col("about").alias("_about")).agg(F.array_sort(F.collect_list(F.struct("rank", "word", "score"))).alias("_best"))
    return posts.select(key, about.alias("about")).join(lists, F.col("about") == F.col("_about")).select(key, F.explode("_best").alias("x")).select(key, "x.*")
