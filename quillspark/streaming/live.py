"""Scoring posts as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.scoring import FusionModel, score_posts


def score_stream(posts: DataFrame, type_scores: DataFrame, hate_scores: DataFrame | None = None, model: FusionModel | None = None) -> DataFrame:
    """The batch scorer on a stream of (post_id, text); score tables are static."""
    return score_posts(posts, type_scores, hate_scores, model)


def once(posts: DataFrame, time: str, delay: str = "10 minutes", key: str = "post_id") -> DataFrame:
    """Each post once, as long as its repeats come within the delay; state older than that goes."""
    return posts.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def write_parquet(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
