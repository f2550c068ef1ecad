"""Shares at a cut-off."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark import catalogue
from quillspark.functions import decisions
from quillspark.labels import LABELS


def test_a_share_of_just_the_cut_off_is_explained_as_in_sql(spark, tmp_path):
    ids = [4298478, 4483129, *range(40)]  # the first two have a share of 0.35, the others nothing of the kind
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.sql(f"SELECT post_id, confidence, bias_type, explanation FROM ({catalogue.SQL['score_posts_all']})").fetchall())
    got = catalogue.QUERIES["score_posts_all"](spark, str(tmp_path)).select("post_id", "confidence", "bias_type", "explanation")
    assert sorted(map(tuple, got.collect())) == want and sum("non-trivial" in x[3] for x in want if x[0] > 40) == 2


def test_temperature_one_leaves_shares_as_they_are(spark):
    rows = [(w % 97 + 1, w * 37 % 101 + 1, w * 71 % 89 + 1, w * 29 % 103 + 1) for w in range(300)]
    held = [tuple(x / (r[0] + r[1] + r[2] + r[3]) for x in r) for r in rows]
    assert any(sum(r) != 1 for r in held)
    df = spark.createDataFrame(held, ", ".join(f"{k} double" for k in LABELS))
    got = df.select(*[v.alias(k) for k, v in decisions.temper({k: F.col(k) for k in LABELS}, 1.0).items()]).collect()
    assert [tuple(r) for r in got] == held
    (half,) = spark.createDataFrame([(0.1, 0.2, 0.1, 0.1)], df.schema).select(*[v.alias(k) for k, v in decisions.temper({k: F.col(k) for k in LABELS}, 1.0).items()]).collect()
    assert tuple(half) == pytest.approx((0.2, 0.4, 0.2, 0.2))
