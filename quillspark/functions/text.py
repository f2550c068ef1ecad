"""Text normalisation and tokens as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .factors import any_of, may_match, required, whole_words

FLAGS = "(?iU)"
PLAIN = "(?i)"  # the same for text in ASCII
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"


def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def _clean(text: Column) -> Column:
    lone = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, "")), r"(?U)\s+", " ")
    return F.trim(lone)


def clean_posts(posts: DataFrame, text_col: str = "text", out: str = "clean") -> DataFrame:
    """NFKC, no control characters, lower case, single spaces. Only rows outside ASCII go through Python for NFKC."""
    plain = F.coalesce(~F.col(text_col).rlike(r"[^\x00-\x7f]"), F.lit(True))
    ascii_ = posts.where(plain).withColumn(out, _clean(F.col(text_col)))
    other = posts.where(~plain).withColumn(out, _clean(F.pandas_udf(_nfkc, T.StringType())(F.col(text_col))))
    return ascii_.unionByName(other)


def clean_ascii(text: Column) -> Column:
    """The same for text known to be ASCII."""
    return _clean(text)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9']+)"), F.lit(1))


def has(text: Column, bank: str | tuple[str, ...], words: str | None = None) -> Column:
    """Whether any pattern of the bank occurs. Without an index of the text (words) a bank folds into one alternation; with one, each
    pattern only runs where a literal that it needs occurs."""
    each = (bank,) if isinstance(bank, str) else bank
    whole = text.rlike(FLAGS + "|".join(f"(?:{p})" for p in each))
    if words is None:
        return whole
    out = F.lit(False)
    for p in each:
        if whole_words(p):
            one = any_of(words, whole_words(p))
        else:
            one = text.rlike(PLAIN + p) if required(p) is None else any_of(words, required(p)) & text.rlike(PLAIN + p)
        out = out | one
    return F.when(F.col(words).isNull(), whole).otherwise(out)


def hits(text: Column, pattern: str, words: str | None = None) -> Column:
    found = lambda flags: F.regexp_count(text, F.lit(flags + pattern)).cast("double")
    return found(FLAGS) if words is None else F.when(F.col(words).isNull(), found(FLAGS)).when(may_match(words, pattern), found(PLAIN)).otherwise(0.0)


def first_hit(text: Column, pattern: str, words: str | None = None) -> Column:
    """The first match, empty without one."""
    found = lambda flags: F.regexp_extract(text, flags + pattern, 0)
    return found(FLAGS) if words is None else F.when(F.col(words).isNull(), found(FLAGS)).when(may_match(words, pattern), found(PLAIN)).otherwise("")


def clean_generated(text: Column) -> Column:
    """Generated text: zero-width marks and line breaks to spaces, no list marker in front, no quotes around."""
    t = F.translate(F.coalesce(text, F.lit("")), "​﻿\r\n", "    ")
    t = F.trim(F.regexp_replace(t, r"(?U)\s+", " "))
    return F.btrim(F.regexp_replace(t, r"^\s*[-*•\d\.\)\(]+\s*", ""), F.lit(" \"'"))


def joined(context: Column, sentence: Column) -> Column:
    """Context and sentence with a space, or the one that is not empty."""
    return F.concat_ws(" ", F.nullif(F.trim(context), F.lit("")), F.nullif(F.trim(sentence), F.lit("")))


def shortened(text: Column, most: int = 500) -> Column:
    return F.when(F.length(text) > most, F.substring(text, 1, most)).otherwise(text)


def number_of(post_id: Column) -> Column:
    """The number at the end of an id such as p3_017, for ordering; 99999 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(post_id, r"(\d+)$", 1), F.lit("")).cast("int"), F.lit(99999))
