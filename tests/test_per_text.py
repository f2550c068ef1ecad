"""What hangs on a post's text alone is worked out once for each distinct text, and comes back to every post."""

from pyspark.sql import functions as F

from quillspark import catalogue
from quillspark.functions import explain
from quillspark.plans import scoring


def test_each_text_is_worked_on_once(spark):
    texts = ["women are lazy", "Immigrants are usually late", "", None, "ſtaff are  lazy"]
    posts = spark.createDataFrame([(i, texts[i % 5], i) for i in range(500)], "post_id long, text string, flags long")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    def derive(t):
        return t.mapInArrow(counted, t.schema).withColumn("n", F.coalesce(F.length("text"), F.lit(-1))).withColumn("flags", F.lit("own"))

    got = scoring.per_text(posts, derive).collect()
    assert seen.value == 5
    assert sorted((r["post_id"], r["text"] is None, r["n"], r["flags"]) for r in got) == [(i, i % 5 == 3, len(texts[i % 5]) if texts[i % 5] is not None else -1, "own") for i in range(500)]


def test_scores_of_copies_are_those_of_single_posts(spark):
    texts = ["women are lazy", "ſtaff are  lazy", None, "We PREFER locals", "it is a myth that men are better than others"]
    posts = spark.createDataFrame([(i, texts[i % 5]) for i in range(50)], "post_id long, text string")
    p = [0.7, 0.1, 0.1, 0.1]
    scores = posts.select("post_id", *[F.lit(x).alias(k) for x, k in zip(p, catalogue.LABELS)])
    hate = posts.select("post_id", F.lit(0.1).alias("p_hate"))
    got = {r["post_id"]: r[1:] for r in scoring.score_posts(posts, scores, hate).collect()}
    one = {r["post_id"]: r[1:] for r in scoring.score_posts(posts.where("post_id < 5"), scores, hate).collect()}
    # row by row, as on a stream
    parts = scoring.decided(scoring.with_signals(scoring.clean_posts(scoring.with_scores(posts, scores, hate))))
    assert len(got) == 50 and all(got[i] == one[i % 5] for i in got)
    assert {r["post_id"]: (r["bias_detected"], r["bias_type"], r["confidence"]) for r in parts.collect()} == {i: tuple(v[1:4]) for i, v in got.items()}


def test_words_without_repeats(spark):
    df = spark.createDataFrame([(["B", "a", "b", "A", "c"],), ([],)], "w array<string>")
    assert [r[0] for r in df.select(explain._first_by_lower(F.col("w"))).collect()] == [["B", "a", "c"], []]
