"""Corpus builders: weak labels, audits, fused corpora and rendered posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions.rules import bias_family
from ..functions.text import clean_generated, has
from ..labels import BIAS, LABELS, NEUTRAL
from ..operators import sampling
from ..sources import benchmarks


def weak_labels(rows: DataFrame, key: str, text: str = "text", binary: str = "binary_label", seed: int = 42) -> DataFrame:
    """rows with `label` by counts of case-sensitive cues; ties go gender, nationality, profession; harmful rows without any cue
    take turns."""
    count = lambda p: F.regexp_count(F.col(text), F.lit(p))
    r = rows.withColumns({"_g": count(lex.WEAK_GENDER), "_n": count(lex.WEAK_NATIONALITY), "_p": count(lex.WEAK_PROFESSION)})
    blank = (F.col(binary) == 1) & (F.col("_g") + F.col("_n") + F.col("_p") == 0)
    turn = sampling.ranked(r.where(blank), key, (), seed, "_turn").withColumn("label", F.element_at(F.array(*map(F.lit, BIAS)), ((F.col("_turn") - 1) % 3 + 1).cast("int"))).drop("_turn")
    top = F.when((F.col("_g") >= F.col("_n")) & (F.col("_g") >= F.col("_p")), BIAS[0]).when((F.col("_n") >= F.col("_g")) & (F.col("_n") >= F.col("_p")), BIAS[1]).otherwise(BIAS[2])
    rest = r.where(~blank | F.col(binary).isNull()).withColumn("label", F.when(F.col(binary) == 1, top).otherwise(NEUTRAL))
    return rest.unionByName(turn).drop("_g", "_n", "_p")


def audit(rows: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """rows with new_label and reason (null where nothing changed). No row is relabelled to fill a quota."""
    kind = has(F.col(text), (lex.AUDIT_ANTI_STEREOTYPE, lex.AUDIT_SUPPORTIVE))
    calm = (F.col(label) != NEUTRAL) & kind
    harsh = (F.col(label) == NEUTRAL) & has(F.col(text), lex.AUDIT_EXCLUSION)
    return rows.withColumns(
        {
            "new_label": F.when(calm, NEUTRAL).when(harsh, bias_family(F.col(text))).otherwise(F.col(label)),
            "reason": F.when(calm, "supportive_or_antistereotype_mislabeled_bias").when(harsh, "harmful_exclusion_mislabeled_neutral"),
        }
    )


def accepted(rows: DataFrame, quota: int, expected: str = "expected_label", least_chars: int = 12) -> DataFrame:
    """Generated rows with the label that was asked for, long enough, unique within a label, and the first `quota` of each label and platform.
    rows: post_id, text, label, expected_label, platform."""
    good = rows.withColumn("text", clean_generated(F.col("text"))).where(F.col("label").isin(*LABELS) & (F.col("label") == F.col(expected)) & (F.length("text") >= least_chars))
    return sampling.ranked(sampling.dedupe_text(good), "post_id", ("label", "platform")).where(F.col("rank") <= quota).drop("rank")


def benchmark_corpus(items: DataFrame, pairs: DataFrame, extra: DataFrame | None = None, ratio: float | None = None, fraction: float = 0.0) -> DataFrame:
    """Both benchmarks together, neutral capped or all classes balanced, and optionally a share of a second corpus (post_id, text, label)."""
    both = benchmarks.flatten_items(items).unionByName(benchmarks.unpivot_pairs(pairs))
    key = F.md5(F.concat_ws("|", "group_id", "label", "text"))
    keyed = both.withColumn("row_key", key).dropDuplicates(["row_key"])
    out = sampling.cap_neutral(keyed, "row_key", ratio) if ratio else sampling.balance_classes(keyed, "row_key")
    return sampling.mix_in(out, extra, fraction, "post_id") if extra is not None and fraction > 0 else out.select("text", "label", "group_id", "source")


def fused_corpus(binary: DataFrame, synthetic: DataFrame, key: str = "post_id") -> DataFrame:
    """Weakly labelled real rows and synthetic rows, 80 to 20, balanced. binary: key, text, binary_label; synthetic: key, text, label."""
    return sampling.fuse_80_20(weak_labels(binary, key), synthetic, key)


def rendered(ids: DataFrame, slots: list[list[str]], key: str = "id") -> Column:
    """A text from slots: the id picks from the first, the rest of the division by its length from the next, and so on."""
    at, parts = F.col(key), []
    for words in slots:
        parts.append(F.element_at(F.array(*map(F.lit, words)), (at % len(words) + 1).cast("int")))
        at = F.floor(at / len(words))
    return F.concat_ws(" ", *parts)


def valid_comparison(text: Column, banned: tuple[str, ...]) -> Column:
    return ~F.greatest(*[F.lower(text).contains(b) for b in banned])
