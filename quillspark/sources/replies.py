"""Replies of language models and of a hate classifier, read from a table of raw texts."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..labels import LABELS

ITEM = "struct<text:string,label:string>"
WRAPPERS = ("data", "items", "posts", "results", "samples")


def unfenced(reply: Column) -> Column:
    """Without a code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def json_items(replies: DataFrame, key: str = "reply_id", reply: str = "reply") -> DataFrame:
    """(key, at, text, label): the items of an array, of an array under a wrapper key, of a lone object, or of the outermost brackets."""
    body = unfenced(F.col(reply))
    many = lambda c: F.from_json(c, f"array<{ITEM}>")
    wrapped = [many(F.get_json_object(body, f"$.{k}")) for k in WRAPPERS]
    lone = F.from_json(body, ITEM)
    inner = many(F.regexp_extract(body, r"(?s)(\[.*\])", 1))
    items = F.when(body.startswith("["), many(body)).otherwise(F.coalesce(*wrapped, F.when(lone["text"].isNotNull(), F.array(lone)), inner))
    return replies.select(key, F.posexplode(items).alias("at", "item")).select(key, "at", "item.text", "item.label").where("text IS NOT NULL")


def csv_items(replies: DataFrame, key: str = "reply_id", reply: str = "reply") -> DataFrame:
    """(key, at, text, label) from CSV with a header line, when no field holds a line break."""
    lines = F.filter(F.split(unfenced(F.col(reply)), r"\r?\n"), lambda x: F.trim(x) != "")
    rows = replies.select(key, F.posexplode(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))).alias("at", "line"))
    return rows.select(key, "at", F.from_csv("line", "text string, label string", {"escape": '"'}).alias("x")).select(key, "at", "x.text", F.trim("x.label").alias("label"))


def csv_items_quoted(replies: DataFrame, key: str = "reply_id", reply: str = "reply") -> DataFrame:
    """The same for fields with line breaks: each reply is parsed whole, in Arrow batches."""
    rows = replies.select(F.col(key).cast("string").alias("k"), unfenced(F.col(reply)).alias("reply"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(k, i, r.get("text"), (r.get("label") or "").strip()) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, r in enumerate(csv.DictReader(io.StringIO(v or "")))]
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string()))], [key, "at", "text", "label"])

    return rows.mapInArrow(run, f"{key} string, at int, text string, label string")


def label_of(reply: Column) -> Column:
    """The label in the first {...} of a reply, else the first label, in label order, that it names; null without one."""
    whole = F.trim(F.coalesce(reply, F.lit("")))
    blob = F.regexp_extract(whole, r"(?s)\{[^{}]*\}", 0)
    told = F.trim(F.get_json_object(F.when(blob != "", blob).otherwise(whole), "$.label"))
    named = F.coalesce(*[F.when(F.lower(whole).rlike(rf"\b{k}\b"), k) for k in LABELS])
    return F.when(told.isin(*LABELS), told).otherwise(named)


def _norm(label: Column) -> Column:
    t = F.trim(label)
    low, up = F.lower(t), F.translate(F.upper(t), " -", "__")
    return (
        F.when(low.contains("hate") & low.contains("not") | low.isin("neither", "not hate", "not_hate", "no_hate", "nohate"), "NOT_HATE")
        .when(low.contains("hate"), "HATE")
        .when(up.isin("LABEL_0", "0"), "HATE")
        .when(up.isin("LABEL_1", "1"), "NOT_HATE")
        .otherwise(t)
    )


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hate_of(reply: Column) -> Column:
    """Struct (label, label_norm, hate, not_hate, p_hate) from a JSON array of (label, score); null for an empty reply."""
    def side(x: Column) -> Column:
        low = F.lower(x["label"])
        no = low.rlike(r"\bnot(\s+|-)hate\b") | low.rlike(r"\bno(\s+|-)hate\b") | low.isin("nohate", "neither")
        return F.when(low.contains("hate"), F.when(no, "NOT_HATE").otherwise("HATE")).otherwise(_norm(x["label"]))

    def read(items: Column) -> Column:
        most = lambda k: F.coalesce(F.array_max(F.transform(F.filter(items, lambda x: x["side"] == k), lambda x: F.greatest(x["score"], F.lit(0.0)))), F.lit(0.0))
        first = F.struct(items[0]["label"].alias("label"), _norm(items[0]["label"]).alias("norm"), most("HATE").alias("hate"), most("NOT_HATE").alias("no"))
        return F.when(F.size(items) > 0, _once(first, judged))

    def judged(x: Column) -> Column:
        hate, no = x["hate"], x["no"]
        return _once(F.when(hate + no > 1e-9, hate / (hate + no)).otherwise(F.greatest(F.lit(0.0), hate)), lambda p: F.struct(x["label"].alias("label"), F.when(x["norm"].isin("HATE", "NOT_HATE"), x["norm"]).when(p >= 0.5, "HATE").otherwise("NOT_HATE").alias("label_norm"), hate.alias("hate"), no.alias("not_hate"), p.alias("p_hate")))

    items = F.from_json(reply, "array<struct<label:string,score:double>>")
    return _once(F.transform(items, lambda x: F.struct(x["label"].alias("label"), x["score"].alias("score"), side(x).alias("side"))), read)
