"""Connected components of a table of links, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

LINKS_PER_FILE = 200_000


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each id in links (a, b); component is the smallest id that is reachable.

    Each round takes the smallest label among the neighbours and then the label of that label, so a chain shortens by half. It ends
    when a round changes no label. The labels of each round go to the shared folder, which cuts their lineage, in as many files as
    the number of links calls for.
    """
    files = 1 + 2 * links.count() // LINKS_PER_FILE
    both = settle(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), files)
    labels = settle(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), files)
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", F.least("label", "m").alias("new"), F.col("label").alias("old"))
        up = labels.select(F.col("id").alias("root"), F.col("label").alias("above"))
        jumped = settle(step.join(up, step["new"] == up["root"], "left").select("id", F.least("new", F.coalesce("above", "new")).alias("label"), "old"), files)
        if jumped.where("label <> old").isEmpty():
            return jumped.select("id", F.col("label").alias("component"))
        labels = jumped.select("id", "label")
