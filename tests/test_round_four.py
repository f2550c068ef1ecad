"""Rounding as in SQL, replies parsed once, attributions and counts of words by distinct text, thresholds over groups of like rows."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark import catalogue
from quillspark.functions import explain
from quillspark.labels import LABELS
from quillspark.plans import generator, training
from quillspark.sources import replies


def test_confidence_is_rounded_as_in_sql(spark):
    sf, con = "/root/testdata/sf0.01", duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    want = con.sql(catalogue.SQL["score_posts_all"]).df().set_index("post_id")["confidence"].sort_index()
    got = catalogue.QUERIES["score_posts_all"](spark, sf).select("post_id", "confidence").toPandas().set_index("post_id")["confidence"].sort_index()
    assert len(got) == 10000 and (got.to_numpy() == want.to_numpy()).all()


def test_a_hate_reply_is_parsed_once(spark):
    df = spark.createDataFrame([('[{"label": "not hate", "score": 0.3}, {"label": "hate", "score": 0.6}]',), ("[]",), ("",), (None,), ('[{"label": null, "score": null}]',)], "r string").coalesce(1)
    got = df.select(replies.hate_of(F.col("r")).alias("h"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    rows = [r["h"] for r in got.collect()]
    assert tuple(rows[0])[:4] == ("not hate", "NOT_HATE", 0.6, 0.3) and rows[0]["p_hate"] == pytest.approx(2 / 3)
    assert rows[1:4] == [None, None, None] and tuple(rows[4])[1:] == ("NOT_HATE", 0.0, 0.0, 0.0)


def test_words_of_copies_are_found_once(spark):
    texts = ["men are bad men", "a good team", "", "men and the team"]
    posts = spark.createDataFrame([(i, texts[i % 4], LABELS[i % 3]) for i in range(60)], "post_id long, clean string, bias_type string")
    weights = spark.createDataFrame([(k, w, (i + 1) * s) for i, k in enumerate(LABELS) for w, s in (("men", 0.5), ("bad", 0.9), ("team", 0.5), ("good", -1.0))], "label string, word string, weight double")
    got = explain.top_of_posts(posts, weights, 2)
    want = explain.top_attributions(explain.linear_attributions(posts, weights), 2)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 60


def test_counts_of_words_train_the_same_classifier(spark):
    rows = spark.createDataFrame([(i, f"word{i % 4} men and women {i % 7}", LABELS[i % 4]) for i in range(80)], "post_id long, text string, label string")
    counts, rest = training.counted(rows, training.text_pipeline(1 << 10), "post_id")
    assert counts.columns == ["post_id", "label", "counts"]
    told = {r["post_id"]: r["pred"] for r in rest.fit(counts).transform(counts).collect()}
    whole = training.text_pipeline(1 << 10).fit(rows)
    assert told == {r["post_id"]: r["pred"] for r in whole.transform(rows).collect()}


def test_rows_the_grid_cannot_tell_apart_are_one(spark):
    rng = random.Random(4)
    steps, gaps = np.array([0.25, 0.5, 0.75]), np.array([0.0, 0.1])
    rows = [(*[round(rng.random(), 2) for _ in LABELS], rng.randrange(7)) for _ in range(3000)]
    alike = training._alike(spark.createDataFrame(rows, ", ".join(f"{k} double" for k in sorted(LABELS)) + ", `group` int"), steps, gaps).toPandas()
    order = sorted(LABELS).index("neutral")

    def sign(p):
        others = [i for i in range(4) if i != order]
        return tuple(sum(x >= s for s in steps) for x in p), tuple(sorted(range(4), key=lambda i: (-p[i], i))), tuple(sum(p[i] - p[order] >= g for g in gaps) for i in others)

    assert len(alike) == len({sign(r[:4]) for r in rows}) < 3000
    assert [int(alike[f"n{g}"].sum()) for g in range(7)] == [sum(r[4] == g for r in rows) for g in range(7)]


def test_candidates_meet_whole_chunks(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def work(p, g):
        seen.add(1)
        return np.array([len(p), int(g.sum())])

    rows = spark.range(0, 60000, 1, 2).select(*[F.lit(0.25).alias(k) for k in sorted(LABELS)], (F.col("id") % 7).cast("int").alias("group"))
    assert training._added(rows, (2,), work).tolist() == [60000, sum(i % 7 for i in range(60000))]
    assert seen.value == 2


def test_draws_of_a_bucket_are_dealt_over_the_tasks(spark):
    n = generator.BLOCK
    tries = {("neutral", "policy"): 3 * n + 1, ("neutral", "fairness"): n, ("gender_bias", "explicit"): 1, ("gender_bias", "coded"): 0}
    buckets = spark.createDataFrame([(*b, m) for b, m in tries.items()], "label string, subtype string, tries long").coalesce(1)
    got = generator.texts(generator.draws_of(buckets), 42).withColumn("task", F.spark_partition_id()).cache()
    said = {(r["label"], r["subtype"]): tuple(r[2:]) for r in got.groupBy("label", "subtype").agg(F.count("*"), F.count_distinct("draw"), F.min("draw"), F.max("draw")).collect()}
    assert said == {b: (m, m, 0, m - 1) for b, m in tries.items() if m}
    assert got.select("task").distinct().count() >= 3 and got.where(F.contains("text", F.lit("{"))).isEmpty()
    none = spark.createDataFrame([("neutral", "policy", 0)], "label string, subtype string, tries long")
    assert generator.draws_of(none).isEmpty()
