"""Hand cases for rules, features, decisions and reports."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import decisions, features, rules, text
from quillspark.labels import LABELS, to_label
from quillspark.operators import agreement, metrics, sampling
from quillspark.sources import loaders, replies


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "text string").select(*columns).first()


def flags(spark, value):
    return one(spark, value, *[c.alias(k) for k, c in rules.flags(F.col("text")).items()]).asDict()


def test_empty_text_has_no_flags(spark):
    assert not any(flags(spark, "").values()) and not any(flags(spark, None).values())


@pytest.mark.parametrize(
    "value,on",
    [
        ("women are always lazy", {"generalisation"}),
        ("locals are better than others", {"comparison"}),
        ("we prefer to hire locals", {"comparison", "preference"}),
        ("a real culture fit", {"coded_bias"}),
        ("there is unfairness in pay", {"inequality_context"}),
        ("she brings a smoother tone", {"soft_preference"}),
        ("engineers usually skip the meeting", {"implicit_generalisation", "generalisation"}),
    ],
)
def test_flags(spark, value, on):
    got = flags(spark, value)
    assert on <= {k for k, v in got.items() if v}


def test_debias_guard_and_critique(spark):
    assert flags(spark, "immigrants are not stealing jobs and people are usually kind")["generalisation"] == flags(spark, "people are usually kind")["implicit_generalisation"]
    assert not flags(spark, "the stereotype that women are always weak is wrong")["generalisation"]


def test_structure_score(spark):
    f = {k: F.lit(1) for k in rules.FLAG_NAMES}
    assert one(spark, "x", rules.structure_score(f).alias("s"))["s"] == pytest.approx(1.0)


def test_stance(spark):
    got = one(spark, "women are not inferior", *[c.alias(k) for k, c in features.stance(F.col("text")).items()])
    assert (got["group_target_present"], got["attribution_denial"], got["attribution_assertion"]) == (1.0, 1.0, 0.0)


def test_linguistic(spark):
    f = {k: F.lit(0) for k in rules.FLAG_NAMES}
    got = one(spark, "do not trust them, keep out", *[c.alias(k) for k, c in features.linguistic(F.col("text"), f).items()])
    assert got["exclusion_intent"] == 1.0 and got["anti_stereotype_cue"] == 0.0


def test_feature_names():
    assert len(features.CORE_NAMES) == 36 and len(features.AUX_NAMES) == 4 and features.SCHEMA_VERSION == 6


def test_nfkc_and_spaces(spark):
    df = spark.createDataFrame([("Ｈｅｌｌｏ\u0007  World",), ("A\tB ",), (None,)], "text string")
    assert {r["clean"] for r in text.clean_posts(df).collect()} == {"hello world", "a b", ""}


@pytest.mark.parametrize("p,margin,want", [((0.1, 0.1, 0.1, 0.7), None, "neutral"), ((0.5, 0.3, 0.1, 0.1), None, "gender_bias"), ((0.4, 0.1, 0.12, 0.38), 0.05, "neutral"), ((0.2, 0.2, 0.2, 0.2), None, "neutral")])
def test_thresholds(spark, p, margin, want):
    d = {k: F.lit(v) for k, v in zip(LABELS, p)}
    assert one(spark, "x", decisions.thresholded(d, dict.fromkeys(LABELS, 0.3), margin).alias("l"))["l"] == want


def test_distributions_sum_to_one(spark):
    d = {k: F.lit(v) for k, v in zip(LABELS, (0.2, 0.3, 0.4, 0.1))}
    for got in (decisions.temper(d, 0.1), decisions.normalised(d), decisions.blend(d, d, d), decisions.platt(d, dict.fromkeys(LABELS, 1.0), dict.fromkeys(LABELS, 0.0))):
        assert sum(one(spark, "x", *[c.alias(k) for k, c in got.items()])) == pytest.approx(1.0)
    zero = decisions.normalised({k: F.lit(0.0) for k in LABELS})
    assert one(spark, "x", *zero.values()) == (0.25,) * 4


def test_only_true_counts(spark):
    df = spark.createDataFrame([("true", "gender_bias"), ("uncertain", "gender_bias"), ("false", "x"), ("true", None)], "d string, t string")
    assert [r[0] for r in df.select(to_label(F.col("d"), F.col("t"))).collect()] == ["gender_bias", "neutral", "neutral", "neutral"]


def test_empty_reports(spark):
    none = spark.createDataFrame([], "gold string, pred string, confidence double")
    assert metrics.confusion_matrix(none).count() == 4
    assert metrics.binary_report(none).first()["f1"] == 0.0
    assert metrics.calibration_bins(none).count() == 10


def test_fleiss_on_published_counts(spark):
    counts = {(0, 0, 0): 143, (0, 1, 0): 56, (1, 0, 1): 29, (1, 1, 1): 172}
    df = spark.createDataFrame([k for k, n in counts.items() for _ in range(n)], "a int, b int, c int")
    r = agreement.fleiss_kappa(df, ["a", "b", "c"]).first()
    assert r["kappa"] == pytest.approx(0.716, abs=5e-4) and r["all_agree"] == pytest.approx(0.7875)


def test_group_split_keeps_groups_whole(spark):
    df = spark.range(400).select("id", (F.col("id") % 40).cast("string").alias("g"))
    assert sampling.group_split(df, "g").select("g", "split").distinct().count() == 40


def test_ranks_are_a_permutation(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("label"))
    got = sampling.ranked(df, "id", ("label",)).collect()
    for k in range(3):
        mine = sorted(r["rank"] for r in got if r["label"] == k)
        assert mine == list(range(1, len(mine) + 1))


def test_loader(spark):
    raw = spark.createDataFrame([(1, " a "), (2, "  "), (3, None)], "id int, text string")
    assert [tuple(r) for r in loaders.standard_posts(raw).collect()] == [("1", "a")]
    auto = loaders.standard_posts(raw.select("text"))
    assert [tuple(r) for r in auto.collect()] == [("0", "a")]


def test_replies_with_line_breaks_in_fields(spark):
    df = spark.createDataFrame([("r", 'text,label\n"a\nb",neutral\n')], "reply_id string, reply string")
    assert [tuple(r) for r in replies.csv_items_quoted(df).collect()] == [("r", 0, "a\nb", "neutral")]


def test_stream_equals_batch(spark, tmp_path):
    from quillspark.plans.scoring import score_posts
    from quillspark.streaming.live import score_stream, write_parquet

    posts = spark.createDataFrame([(str(i), f"most women are usually better than others {i}") for i in range(20)], "post_id string, text string")
    posts.write.parquet(str(tmp_path / "in"))
    scores = posts.select("post_id", *[F.lit(v).alias(k) for k, v in zip(LABELS, (0.6, 0.2, 0.1, 0.1))])
    live = score_stream(spark.readStream.schema(posts.schema).parquet(str(tmp_path / "in")), scores)
    write_parquet(live, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {tuple(map(str, r)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {tuple(map(str, r)) for r in score_posts(posts, scores).collect()}
