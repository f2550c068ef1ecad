"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern; each pattern offers its tokens once at
no cost and, up to `max_repeats`, again at a cost that rises with each repetition. The flow routes these offers to the
sources' quotas at least cost, so that repetition starts only where single use cannot fill a quota. What a pattern has to
give is then taken from its documents in a seeded order: all of them so many whole times, and once more as many as fit.

The flow sees one number per pattern and source. Documents are dealt by hash into bins of about `BIN_DOCS` for each pattern;
only the bin in which the running total meets the quota looks at single documents.

Defined cases: null or empty text has size 0 and is never taken; a null source is a source of its own, the last; without
documents the result is empty; rows that share an id are taken or left each by itself; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import hold

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, MAX_REPEATS = 1.5, 2
BIN_DOCS = 128


def targets(sizes: list[float], weights: list[float], total: float, most: float = MAX_REPEATS) -> list[float]:
    """Shares of total by weight, none above most times its size; the excess is shared again by weight."""
    out = [0.0] * len(sizes)
    open_, left = [i for i, s in enumerate(sizes) if s > 0], total
    while open_:
        base = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / base >= most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / base
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def route(supply: list[int], members: list[list[int]], quota: list[int], repeats: int) -> list[dict[int, int]]:
    """Min-cost flow by successive shortest paths: for each pattern the tokens that it gives to each source.

    Arcs: start -> pattern, `repeats` of them with the pattern's tokens as capacity and costs 0, 1, 3, 6, ...;
    pattern -> its sources; source -> end with the quota as capacity.
    """
    n_p, n_s = len(supply), len(quota)
    start, end = n_p + n_s, n_p + n_s + 1
    to, room, cost, out = [], [], [], [[] for _ in range(n_p + n_s + 2)]

    def arc(a: int, b: int, cap: int, c: int) -> int:
        for x, y, w, z in ((a, b, cap, c), (b, a, 0, -c)):
            out[x].append(len(to))
            to.append(y)
            room.append(w)
            cost.append(z)
        return len(to) - 2

    for p, s in enumerate(supply):
        for k in range(repeats):
            arc(start, p, s, k * (k + 1) // 2)
    inner = [[(s, arc(p, n_p + s, repeats * supply[p], 0)) for s in ms] for p, ms in enumerate(members)]
    for s, q in enumerate(quota):
        arc(n_p + s, end, q, 0)
    while True:
        far = [None] * len(out)
        far[start], via, queue = 0, [-1] * len(out), [start]
        while queue:
            nxt = []
            for x in queue:
                for e in out[x]:
                    if room[e] and (far[to[e]] is None or far[x] + cost[e] < far[to[e]]):
                        far[to[e]] = far[x] + cost[e]
                        via[to[e]] = e
                        nxt.append(to[e])
            queue = list(dict.fromkeys(nxt))
        if far[end] is None:
            break
        path, x = [], end
        while x != start:
            path.append(via[x])
            x = to[via[x] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    return [{s: room[e ^ 1] for s, e in arcs} for arcs in inner]


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """In seeded order, each document of one bin that still fits, and one more if that comes nearer to what is wanted."""
    pdf = pdf.sort_values(["draw", "id", "size", *(["tag"] if "tag" in pdf else [])], na_position="first")
    left, got = int(pdf["want"].iloc[0]), []
    for s in pdf["size"].tolist():
        got.append(0 < s <= left)
        left -= s if got[-1] else 0
    gaps = [(abs(left - s), k) for k, s in enumerate(pdf["size"].tolist()) if s > 0 and not got[k]]
    if gaps and min(gaps)[0] < left:
        got[min(gaps)[1]] = True
    return pdf.assign(extra=got)[["id", *(["tag"] if "tag" in pdf else []), "members", "size", "base", "extra"]]


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sources: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    max_repeats: int = MAX_REPEATS,
    seed: int = 11,
    tag_col: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(documents, sources). `sources` is a string column, or an array of strings for overlapping sources.

    documents: id, members (array of source names), size, taken, one row for each row of docs. tag_col: a column of longs that
    tells rows apart; it comes back as tag, after id.
    sources: source, source_size, weight, target, routed.
    """
    kind = dict(docs.dtypes)[sources]
    tag = ["tag"] if tag_col else []
    member = F.col(sources) if kind.startswith("array") else F.array(F.col(sources).cast("string"))
    rows = hold(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            *[F.col(tag_col).cast("long").alias(t) for t in tag],
            F.array_sort(F.array_distinct(F.coalesce(member, F.array(F.lit(None).cast("string"))))).alias("members"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ).withColumn("draw", F.xxhash64("id", "size", F.lit(seed)))
    )
    patterns = rows.groupBy("members").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()
    patterns.sort(key=lambda r: [(m is None, m or "") for m in r["members"]])
    names = sorted({m for r in patterns for m in r["members"]}, key=lambda m: (m is None, m or ""))
    at = {m: i for i, m in enumerate(names)}
    sizes = [0] * len(names)
    for r in patterns:
        for m in r["members"]:
            sizes[at[m]] += r["tokens"]
    weight = [weights[i % len(weights)] for i in range(len(names))]
    target = targets(sizes, weight, share * sum(sizes), max_repeats)
    flows = route([r["tokens"] for r in patterns], [[at[m] for m in r["members"]] for r in patterns], [round(t) for t in target], max_repeats)
    routed = [sum(f.get(i, 0) for f in flows) for i in range(len(names))]
    spark = docs.sparkSession
    about = spark.createDataFrame([(n, s, float(w), t, r) for n, s, w, t, r in zip(names, sizes, weight, target, routed)], "source string, source_size long, weight double, target double, routed long")
    plan = []
    for r, f in zip(patterns, flows):
        give = sum(f.values())
        base = give // r["tokens"] if r["tokens"] else 0
        plan.append((r["members"], base, give - base * r["tokens"], max(1, r["n"] // BIN_DOCS)))
    plan = spark.createDataFrame(plan, "members array<string>, base long, want long, bins long")
    # null members: arrays compare by value and hold the null, so the plain join is right
    dealt = rows.join(F.broadcast(plan) if len(patterns) <= 10_000 else plan, "members").withColumn("bin", F.pmod(F.col("draw"), F.col("bins")))
    filled = dealt.groupBy("members", "bin").agg(F.sum("size").alias("held"), F.first("want").alias("whole"))
    before = F.coalesce(F.sum("held").over(W.partitionBy("members").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edges = filled.withColumn("before", before).select("members", "bin", F.when(F.col("before") + F.col("held") <= F.col("whole"), -1).otherwise(F.greatest(F.col("whole") - F.col("before"), F.lit(0))).alias("rest"))
    met = hold(dealt.join(edges, ["members", "bin"]))
    plain = met.where("rest <= 0").select("id", *tag, "members", "size", "base", ((F.col("rest") < 0) & (F.col("size") > 0)).alias("extra"))
    edge = met.where("rest > 0").withColumn("want", F.col("rest")).groupBy("members", "bin").applyInPandas(_fill, "id long, " + "tag long, " * len(tag) + "members array<string>, size long, base long, extra boolean")
    out = plain.unionByName(edge).select("id", *tag, "members", "size", (F.col("size") * (F.col("base") + F.col("extra").cast("long"))).alias("taken"))
    return out, about
