"""Published bias benchmarks as labelled rows."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import CROWS_LABELS, STEREOSET_LABELS
from ..functions.text import joined
from ..labels import NEUTRAL

STEREOTYPE = 1


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for x in chain(*table.items())]), F.lower(F.trim(key)))


def flatten_items(items: DataFrame) -> DataFrame:
    """(text, label, group_id, source): a row for each candidate sentence. items: id, bias_type, context, sentences (sentence[], gold_label[])."""
    flat = items.select("id", "bias_type", "context", F.explode(F.arrays_zip(F.col("sentences.sentence").alias("s"), F.col("sentences.gold_label").alias("g"))).alias("x"))
    label = F.when(F.col("x.g") == STEREOTYPE, _lookup(F.col("bias_type"), STEREOSET_LABELS)).otherwise(NEUTRAL)
    rows = flat.select(joined(F.col("context"), F.col("x.s")).alias("text"), label.alias("label"), F.concat(F.lit("stereoset-"), F.col("id").cast("string")).alias("group_id"), F.lit("stereoset").alias("source"))
    return rows.where("text <> '' AND label IS NOT NULL")


def unpivot_pairs(pairs: DataFrame, stereo_only: bool = True) -> DataFrame:
    """Two rows for each pair: the more stereotyping sentence has the class of its bias type, the other is neutral. Unknown types go.
    pairs: id, sent_more, sent_less, bias_type, stereo_antistereo."""
    rows = pairs.where(F.lower(F.trim("stereo_antistereo")) == "stereo") if stereo_only else pairs
    label = _lookup(F.col("bias_type"), CROWS_LABELS)
    two = F.array(F.struct(F.trim("sent_more").alias("text"), label.alias("label")), F.struct(F.trim("sent_less").alias("text"), F.lit(NEUTRAL).alias("label")))
    flat = rows.where(label.isNotNull()).select("id", F.explode(two).alias("x"))
    return flat.select("x.text", "x.label", F.concat(F.lit("crows_pairs-"), F.col("id").cast("string")).alias("group_id"), F.lit("crows_pairs").alias("source")).where("text <> ''")


def unknown_types(pairs: DataFrame) -> DataFrame:
    """(bias_type, n) of the pairs that unpivot_pairs leaves out."""
    return pairs.where(_lookup(F.col("bias_type"), CROWS_LABELS).isNull()).groupBy("bias_type").agg(F.count(F.lit(1)).alias("n"))
