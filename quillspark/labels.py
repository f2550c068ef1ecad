"""The four classes, their order, and schemas of the tables that hold posts and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELS = ("gender_bias", "nationality_bias", "profession_bias", "neutral")
NEUTRAL = "neutral"
BIAS = LABELS[:3]

POST = T.StructType([T.StructField("post_id", T.StringType()), T.StructField("text", T.StringType())])
GOLD = T.StructType([*POST.fields, *(T.StructField(n, T.StringType()) for n in ("label", "subtype", "slice_type", "ambiguous_stance"))])


def label_id(label: Column) -> Column:
    """0 to 3 in the fixed order; null for any other label."""
    return F.when(label.isin(*LABELS), F.array_position(F.array(*map(F.lit, LABELS)), label) - 1).cast("int")


def id_label(number: Column) -> Column:
    return F.when(number.between(0, 3), F.element_at(F.array(*map(F.lit, LABELS)), number.cast("int") + 1))


def to_binary(label: Column) -> Column:
    """0 for neutral in any case, 1 for every other label."""
    return F.when(F.lower(label) == NEUTRAL, 0).otherwise(1)


def to_label(bias_detected: Column, bias_type: Column) -> Column:
    """Only an explicit `true` counts as a detection."""
    return F.when(bias_detected == "true", F.coalesce(F.nullif(F.trim(bias_type), F.lit("")), F.lit(NEUTRAL))).otherwise(NEUTRAL)
