"""Exact top-k inner-product search: a ball tree in each shard, branch and bound, the kth score shared between shards.

Vectors are scaled and floored to integers, so scores are exact and ties are real. They are dealt to the nearest of a few pivots, and each
pivot's vectors by hash into shards of about `SHARD_ROWS`; each shard is a ball tree (every node has a centre and a radius), built once. No
vector below a node can score more than query . centre + |query| * radius, so nodes are visited by that bound, best first, until the
bound drops below the kth score.

Round 1 searches each query's own shard and so gets a kth score that the answer cannot fall below. The bound of a shard's root ball
then tells which other shards a query can gain from; only these pairs of query and shard are made, in blocks of balls and queries. Round 2
searches them with the kth score as the start of the bound.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part; so do rows without an id; vectors of
different lengths are not compared with each other; rows that repeat an id are candidates of their own, and queries of their own if their
vectors differ, but no row is a candidate for a query of its own id; with fewer than k candidates all are returned; a component beyond 64 bits counts as the nearest 64-bit number, and so does a score, after ranking; empty tables give an empty result;
other columns are not looked at.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import hold

SHARD_ROWS, QUERY_BLOCK, BALL_BLOCK, PIVOTS, LEAF = 1 << 14, 1 << 13, 1 << 12, 64, 64
SCALE = 1024.0
# of a decimal of 38 digits; larger scores cannot be told apart
MOST = 10**38 - 1


def upper(centres: np.ndarray, radii: np.ndarray, q: np.ndarray) -> np.ndarray:
    """What no vector of each ball exceeds, with more than the rounding of these sums on top."""
    size = np.sqrt(q @ q)
    reach = np.sqrt((centres**2).sum(1)) + radii
    return centres @ q + size * radii + size * reach * 1e-11 + 1e-6


class BallTree:
    """Built top down: a node is split at the median of the projection on the line between two far points."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.most = max(abs(int(vectors.min())), abs(int(vectors.max())))
        points = vectors.astype(np.float64)
        self.order = np.arange(len(ids))
        self.nodes: list[tuple] = []  # centre, radius, low, high, left, right
        todo = [(0, len(ids), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            own = points[self.order[lo:hi]]
            centre = own.mean(0)
            off = np.sqrt(((own - centre) ** 2).sum(1))
            # a little more than the radius, so that rounding never cuts a branch
            node = [centre, float(off.max()) * (1 + 1e-9) + 1e-6, lo, hi, -1, -1]
            if parent >= 0:
                self.nodes[parent][4 + side] = len(self.nodes)
            self.nodes.append(node)
            if hi - lo > LEAF and off.max() > 0:
                a = own[off.argmax()]
                b = own[((own - a) ** 2).sum(1).argmax()]
                along = own @ (a - b)
                half = np.argpartition(along, (hi - lo) // 2)
                self.order[lo:hi] = self.order[lo:hi][half]
                mid = lo + (hi - lo) // 2
                todo += [(lo, mid, len(self.nodes) - 1, 0), (mid, hi, len(self.nodes) - 1, 1)]
        self.ids, self.vectors = ids[self.order], vectors[self.order]
        del self.order
        self.centres = np.array([n[0] for n in self.nodes])
        self.radii = np.array([n[1] for n in self.nodes])
        # within a node of equal vectors the smallest ids come first, so k of them are enough
        for node in self.nodes:
            if node[4] < 0:
                lo, hi = node[2], node[3]
                by = np.argsort(self.ids[lo:hi], kind="stable")
                self.ids[lo:hi], self.vectors[lo:hi] = self.ids[lo:hi][by], self.vectors[lo:hi][by]

    def use(self, kind: np.dtype) -> None:
        """Doubles, where they are exact, or Python's integers."""
        self.vectors, self.exact = self.vectors.astype(kind), kind == object

    def search(self, own_id: int, q: np.ndarray, k: int, floor: int | None) -> list[tuple[int, int]]:
        """(score, id) of the k best of this tree that are not below floor; ties to smaller ids."""
        qf = q.astype(np.float64)
        # the bound of every node at once; their number is the shard's rows over LEAF
        bounds = upper(self.centres, self.radii, qf)
        best: list[tuple[int, int]] = []  # a heap of (score, -id)
        line = floor if floor is not None else -np.inf
        heap = [(-bounds[0], 0)]
        while heap:
            low, n = heapq.heappop(heap)
            if -low < line:
                break
            _, _, lo, hi, left, right = self.nodes[n]
            if left >= 0:
                for c in (left, right):
                    if bounds[c] >= line:
                        heapq.heappush(heap, (-bounds[c], c))
                continue
            scores = self.vectors[lo:hi] @ q
            if not self.exact:
                scores = scores.astype(np.int64)
            # a large leaf holds equal vectors in order of id: k of them are enough
            left = len(scores) if hi - lo <= LEAF else k
            for i in np.flatnonzero(scores >= line).tolist():
                if (v := int(self.ids[lo + i])) != own_id and left:
                    left -= 1
                    item = (int(scores[i]), -v)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
            if len(best) == k:
                line = max(line, best[0][0])
        return [(s, -v) for s, v in best]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<i8").reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.int64)


def _number(v: np.ndarray) -> np.ndarray:
    """As doubles where all sums of products are exact in them, else as Python's integers."""
    most = max(abs(int(v.min())), abs(int(v.max()))) if v.size else 0
    return v.astype(np.float64) if v.shape[1] * most**2 < 2**53 else v.astype(object)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    tree = BallTree(pdf["id"].to_numpy(np.int64), _matrix(pdf["v"]))
    return pd.DataFrame({"shard": [pdf["shard"].iat[0]], "dim": [pdf["dim"].iat[0]], "centre": [tree.centres[0].astype("<f8").tobytes()], "radius": [float(tree.radii[0])], "tree": [pickle.dumps(tree, 5)]})


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE, shard_rows: int = SHARD_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, id, score: for each row whose id is divisible by `every`, its k best other rows."""
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    whole = clean.select("id", F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("v"))
    # a bounded number of vectors, in seeded order, that only decide which vectors share a tree
    some = [(len(r["v"]), np.array(r["v"], float)) for r in whole.orderBy(F.xxhash64("id", "v"), "id").limit(pivots).collect()]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = {d: np.array([x for n, x in some if n == d]) for d in {n for n, _ in some}}
        for b in batches:
            v = b.column(1)
            dims = np.diff(v.offsets.to_numpy())
            flat = v.flatten().to_numpy(zero_copy_only=False).astype("<i8")
            starts = np.cumsum(dims) - dims
            pivot = np.zeros(b.num_rows, np.int64)
            for d in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == d)
                if (points := near.get(d)) is not None:
                    for lo in range(0, len(mine), 4096):
                        x = flat[starts[mine[lo : lo + 4096]][:, None] + np.arange(d)].astype(float)
                        pivot[mine[lo : lo + 4096]] = (2 * x @ points.T - (points**2).sum(1)).argmax(1)
            data = [flat[s : s + d].tobytes() for s, d in zip(starts.tolist(), dims.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims.astype(np.int64)), pa.array(pivot), pa.array(data, pa.binary())], ["id", "dim", "pivot", "v"])

    dealt = hold(whole.mapInArrow(deal, "id long, dim long, pivot long, v binary"))
    parts = dealt.groupBy("dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("parts"))
    shard = F.xxhash64("dim", "pivot", F.pmod(F.xxhash64("id"), F.col("parts")))
    rows = hold(dealt.join(parts, ["dim", "pivot"]).select("id", "dim", "v", shard.alias("shard")))
    trees = hold(rows.groupBy("shard").applyInPandas(_build, "shard long, dim long, centre binary, radius double, tree binary"))
    queries = rows.where(F.col("id") % every == 0).dropDuplicates(["id", "v"])
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    asked = queries.select("id", F.xxhash64("id", "v").alias("tag"), "dim", "v", "shard", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))
    form = "query_id long, tag long, id long, score decimal(38,0)"

    def probe(key: tuple, shards: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        out = []
        q = _matrix(questions["q_v"]) if len(questions) else None
        floors = questions["q_line"].tolist() if "q_line" in questions else [None] * len(questions)
        for data in shards["tree"] if len(questions) else ():
            tree: BallTree = pickle.loads(data)
            # one kind of numbers for both sides
            both = _number(np.concatenate([[[tree.most] * q.shape[1]], q]))
            tree.use(both.dtype)
            for i, (query, tag, line) in enumerate(zip(questions["q_id"].tolist(), questions["q_tag"].tolist(), floors)):
                out += [(query, tag, v, Decimal(max(-MOST, min(MOST, s)))) for s, v in tree.search(int(query), both[i + 1], k, None if line is None or pd.isna(line) else int(line))]
        return pd.DataFrame(out, columns=["query_id", "tag", "id", "score"])

    def search(questions: DataFrame, on: list[str], shards: DataFrame) -> DataFrame:
        named = questions.toDF(*[f"q_{c}" for c in questions.columns])
        return shards.groupBy(*on).cogroup(named.groupBy(*[f"q_{c}" for c in on])).applyInPandas(probe, form)

    near = hold(search(asked.select("shard", "id", "tag", "v"), ["shard"], trees.select("shard", "tree")))
    line = near.groupBy(F.col("query_id").alias("id"), "tag").agg(F.min("score").alias("line"), F.count(F.lit(1)).alias("found")).select("id", "tag", F.when(F.col("found") >= k, F.col("line")).alias("line"))
    lined = asked.join(line, ["id", "tag"], "left")
    piles = max(1, -(-trees.count() // BALL_BLOCK))
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    balls = trees.select("shard", "dim", "centre", "radius", F.pmod(F.col("shard"), F.lit(piles)).cast("int").alias("pile")).withColumn("block", span(blocks))
    sent = lined.withColumn("pile", span(piles))
    sent = sent.toDF(*[f"q_{c}" for c in sent.columns])

    def choose(key: tuple, ball: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        """The pairs of a query and another shard whose ball may hold a better score, or an equal one."""
        out: dict[str, list] = {"shard": [], "block": [], "id": [], "tag": [], "v": [], "line": []}
        for d in set(ball["dim"]) & set(questions["q_dim"]):
            b = ball[ball["dim"] == d]
            centres, radii, names = np.frombuffer(b"".join(b["centre"]), "<f8").reshape(len(b), -1), b["radius"].to_numpy(), b["shard"].to_numpy()
            for r in questions[questions["q_dim"] == d].itertuples():
                own = pd.isna(r.q_line)
                may = names != r.q_shard
                if not own:
                    may &= upper(centres, radii, np.frombuffer(r.q_v, "<i8").astype(float)) >= float(r.q_line) * (1 - np.sign(float(r.q_line)) * 1e-15)
                for n in names[may].tolist():
                    for c, v in zip(out.values(), (n, r.q_block, r.q_id, r.q_tag, r.q_v, None if own else r.q_line)):
                        c.append(v)
        return pd.DataFrame(out)

    pairs = hold(balls.groupBy("pile", "block").cogroup(sent.groupBy("q_pile", "q_block")).applyInPandas(choose, "shard long, block int, id long, tag long, v binary, line decimal(38,0)"))
    far = search(pairs, ["shard", "block"], trees.select("shard", "tree").join(pairs.select("shard", "block").distinct(), "shard"))
    rank = F.row_number().over(W.partitionBy("query_id", "tag").orderBy(F.desc("score"), "id"))
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    return near.unionByName(far).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", F.greatest(F.least("score", most), -most).cast("long").alias("score"))
