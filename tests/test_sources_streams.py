"""Malformed input, saved results, row numbers, natural order, corpora end to end, and the duplicate guard over micro-batches."""

import collections
import json
import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions.text import number_of
from quillspark.labels import LABELS
from quillspark.operators.sampling import numbered
from quillspark.plans import corpus, generator
from quillspark.sources import loaders
from quillspark.streaming import live


def test_broken_csv_rows_go_to_quarantine(spark, tmp_path):
    path = tmp_path / "posts.csv"
    path.write_text('post_id,text,label\n1,"good, with a comma",neutral\n2,too,many,fields\n3,"two\nlines",neutral\n4\n5,  ,neutral\n6,last,gender_bias\n')
    rows, bad = loaders.read_checked(spark, str(path))
    assert {(r["post_id"], r["text"]) for r in rows.collect()} == {("1", "good, with a comma"), ("3", "two\nlines"), ("6", "last")}
    assert collections.Counter(r["reason"] for r in bad.collect()) == {"malformed": 2, "no text": 1}
    assert {r["record"] for r in bad.where("reason = 'malformed'").collect()} == {"2,too,many,fields", "4"}
    assert {r["post_id"] for r in loaders.standard_gold(rows).collect()} == {"1", "3", "6"}


def test_broken_json_rows_go_to_quarantine(spark, tmp_path):
    lines = tmp_path / "posts.jsonl"
    lines.write_text('{"id": 1, "text": "one", "label": "neutral"}\n{"id": 2, "text": "no end\n{"id": 3}\nnot json\n{"id": "x", "text": "four", "other": [1]}\n')
    rows, bad = loaders.read_checked(spark, str(lines))
    assert {(r["id"], r["text"]) for r in rows.collect()} == {("1", "one"), ("x", "four")}
    assert collections.Counter(r["reason"] for r in bad.collect()) == {"malformed": 2, "no text": 1}
    array = tmp_path / "array.json"
    array.write_text(json.dumps([{"id": 1, "text": "a"}, {"id": 2, "text": None}]))
    rows, bad = loaders.read_checked(spark, str(array))
    assert [r["text"] for r in rows.collect()] == ["a"] and [r["reason"] for r in bad.collect()] == ["no text"]
    empty = tmp_path / "none.csv"
    empty.write_text("post_id,text\n")
    assert [df.count() for df in loaders.read_checked(spark, str(empty))] == [0, 0]


@pytest.mark.parametrize("form", ["parquet", "json", "csv"])
def test_saved_results_come_back(spark, tmp_path, form):
    df = spark.createDataFrame([("p1", 'a "quoted", text\nin two lines', "neutral"), ("p2", "é", "gender_bias")], "post_id string, text string, label string")
    loaders.save(df, str(tmp_path / form), form)
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"') if form == "csv" else spark.read
    back = getattr(reader, form)(str(tmp_path / form))
    assert {tuple(r[c] for c in df.columns) for r in back.collect()} == {tuple(r) for r in df.collect()}


def test_rows_are_numbered_once_and_sorted_by_natural_id(spark):
    got = [r["post_id"] for r in numbered(spark.range(50).repartition(7).select(F.col("id").alias("text")), "post_id").collect()]
    assert len(set(got)) == 50
    ids = spark.createDataFrame([("p3_010",), ("p3_9",), ("x",), ("p3_2",)], "post_id string")
    assert [r["post_id"] for r in ids.orderBy(number_of(F.col("post_id")), "post_id").collect()] == ["p3_2", "p3_9", "p3_010", "x"]


def test_benchmark_corpus_is_balanced_and_complete(spark):
    kinds = ["gender", "profession", "race", "religion"]
    items = [(f"i{k}", kinds[k % 4], f"context {k}.", {"sentence": [f"bad {k}", f"good {k}", f"odd {k}"], "gold_label": [1, 0, 2]}) for k in range(40)]
    items = spark.createDataFrame([(i, b, c, (s["sentence"], s["gold_label"])) for i, b, c, s in items], "id string, bias_type string, context string, sentences struct<sentence: array<string>, gold_label: array<int>>")
    pairs = spark.createDataFrame([(f"p{k}", f"more {k}", f"less {k}", ["gender", "nationality", "socioeconomic"][k % 3], "stereo") for k in range(12)], "id string, sent_more string, sent_less string, bias_type string, stereo_antistereo string")
    out = corpus.benchmark_corpus(items, pairs)
    n = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert set(n) == set(LABELS) and len(set(n.values())) == 1 and out.columns == ["text", "label", "group_id", "source"]
    assert generator.missing_labels(out).count() == 0
    assert [r["label"] for r in generator.missing_labels(out.where("label <> 'neutral'")).collect()] == ["neutral"]
    assert out.groupBy("text", "label", "group_id").count().where("count > 1").isEmpty()


def test_fused_corpus_is_eighty_to_twenty(spark):
    real = spark.createDataFrame([(f"r{i}", f"{['pretty women', 'foreign border', 'office jobs', 'a calm text'][i % 4]} {i}", int(i % 4 < 3)) for i in range(400)], "post_id string, text string, binary_label int")
    made = spark.createDataFrame([(f"s{i}", f"made {i}", LABELS[i % 4]) for i in range(400)], "post_id string, text string, label string")
    out = corpus.fused_corpus(real, made)
    n = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert set(n) == set(LABELS) and len(set(n.values())) == 1
    share = out.where(F.col("text").startswith("made")).count() / out.count()
    assert 0.1 <= share <= 0.4


def test_generated_posts_fill_their_quota(spark):
    quotas = spark.createDataFrame([("gender_bias", "explicit", 300), ("neutral", "policy", 7), ("profession_bias", "coded", 0)], "label string, subtype string, n long")
    got = generator.generate(quotas).collect()
    by = collections.Counter((r["label"], r["subtype"]) for r in got)
    assert by == {("gender_bias", "explicit"): 300, ("neutral", "policy"): 7}
    assert len({(r["label"], r["text"].lower()) for r in got}) == 307 and all(r["text"][-1] in ".!?" for r in got)
    assert not any(x in r["text"].lower() for r in got for x in generator.SAME_SIDE)
    tails = sum(any(t.strip() in r["text"] for t in generator.TAILS) for r in got)
    assert 0.25 < tails / len(got) < 0.45 and 0.35 < sum(r["style"] == "x_like" for r in got) / len(got) < 0.55
    again = {(r["number"], r["text"]) for r in generator.generate(quotas.where("n = 7")).collect()}
    assert again == {(r["number"], r["text"]) for r in got if r["label"] == "neutral"}  # a bucket does not hang on the others


def test_completeness_of_a_finished_set(spark):
    rows = spark.createDataFrame([("1", "a", "neutral", "x"), ("2", "b", "gender_bias", "x"), ("2", "B ", "gender_bias", "x"), ("3", " ", None, "y")], "post_id string, text string, label string, platform string")
    quotas = spark.createDataFrame([("neutral", "x", 1), ("gender_bias", "x", 1), ("gender_bias", "y", 2)], "label string, platform string, n long")
    expected = spark.createDataFrame([("1",), ("2",), ("4",)], "post_id string")
    got = {(r["check"], r["item"], r["n"]) for r in generator.completeness(rows, quotas, expected).collect()}
    assert got == {("quota", "gender_bias/x", -1), ("quota", "gender_bias/y", 2), ("quota", "none/y", -1), ("missing_id", "4", 1), ("extra_id", "3", 1), ("label", "", 1), ("empty_text", "", 1), ("repeated_text", "", 1), ("repeated_id", "", 1)}
    whole = rows.where("post_id = '1'")
    assert generator.completeness(whole, quotas.where("label = 'neutral'"), expected.where("post_id = '1'")).count() == 0


def test_duplicate_guard_over_micro_batches(spark, tmp_path):
    """Repeats inside the delay go, also in later batches; later ones stay; state shrinks as the watermark moves on."""
    source = tmp_path / "in"
    source.mkdir()
    at = lambda minute: f"2024-01-01T{10 + minute // 60:02d}:{minute % 60:02d}:00"
    batches = [
        [("a", 0), ("b", 1), ("a", 2)],
        [("a", 5), ("c", 6)],  # a again, five minutes after the first
        [(f"n{i}", 60) for i in range(3)],  # moves the watermark on
        [("m", 61)],  # what is older than it goes at the end of this batch
        [("a", 62), ("n0", 63)],  # a is new by now, n0 is not
        [("z", 180)],
        [("y", 181)],
    ]
    for i, rows in enumerate(batches):
        (source / f"{i}.json").write_text("".join(json.dumps({"post_id": k, "at": at(m)}) + "\n" for k, m in rows))
        time.sleep(0.05)
    posts = spark.readStream.schema("post_id string, at timestamp").option("maxFilesPerTrigger", 1).json(str(source))
    query = live.write_parquet(live.once(posts, "at", "10 minutes"), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    got = collections.Counter(r["post_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == {"a": 2, "b": 1, "c": 1, "n0": 1, "n1": 1, "n2": 1, "m": 1, "z": 1, "y": 1}
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) >= 4 and held[-1] <= 2, held
