"""Exact top-k inner-product search with a KD-tree per shard.

Vectors become integers first (floor(scale * x)), so scores are exact and ties
are real. Each shard of at most ``SHARD`` vectors is one task: median splits on
the widest side build a tree whose nodes keep tight bounding boxes. No vector
of a box scores more against q than the sum of max(q_i lo_i, q_i hi_i), so a
node is opened best-first only while that bound reaches the query's k-th score.

*Propagated k-th score.* Before the search each query is scored against the
tree of one shard only (its own); the k-th score found there is a lower bound
for the answer and travels with the query to every shard.

*Queries against all rows, in blocks.* The vectors of a shard and a block of at
most ``BLOCK`` queries meet in one task; each task returns k rows per query at
most, and the k best over the shards remain. Nothing is broadcast.

Defined cases: vectors that are null, empty or hold null or non-finite
components take no part, neither do rows with a null id. Dimensions may differ:
only vectors of a query's own dimension are its candidates. All rows that repeat
an id are candidates but those with the query's own id; of a query id's
different vectors the least asks. Ties go to the smaller id. Components and scores of any size are exact
as far as a long goes; beyond, they saturate at its bounds (and tie there). An
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read_table

SCALE = 256
SHARD = 16_384
BLOCK = 8_192
LEAF = 128
RESULT = "query_id long, vec_id long, score long"
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, q array<long>`` of the vectors that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite)
    return rows.select("vec_id", F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("q"))


def _long(scores: np.ndarray) -> np.ndarray:
    """Scores of unbounded integers brought into the range of a long; others are within it."""
    return np.clip(scores, LOWEST, HIGHEST) if scores.dtype == object else scores


def _reach(x: np.ndarray) -> int:
    return max(-int(x.min(initial=0)), int(x.max(initial=0)))


class BoxTree:
    """KD-tree over integer vectors: ids sorted into leaves, a bounding box for each node."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.points = ids[order], points[order]
        self.reach = _reach(points) * points.shape[1]
        perm = np.arange(len(ids))
        self.nodes: list[tuple[int, int, int, int]] = []  # start, end, left, right
        low, high = [], []
        stack = [(0, len(ids), -1, 0)]
        while stack:
            s, e, parent, side = stack.pop()
            part = self.points[perm[s:e]]
            lo, hi = part.min(axis=0), part.max(axis=0)
            number = len(self.nodes)
            self.nodes.append((s, e, -1, -1))
            low.append(lo)
            high.append(hi)
            if parent >= 0:
                a = list(self.nodes[parent])
                a[2 + side] = number
                self.nodes[parent] = tuple(a)
            if e - s > leaf:
                axis = int(np.argmax(hi.astype(np.float64) - lo))
                if hi[axis] > lo[axis]:
                    mid = (e - s) // 2
                    perm[s:e] = perm[s:e][np.argpartition(part[:, axis], mid)]
                    stack += [(s, s + mid, number, 0), (s + mid, e, number, 1)]
        self.ids, self.points = self.ids[perm], self.points[perm]
        self.low, self.high = np.array(low), np.array(high)
        self._cast: dict[type, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _for(self, q: np.ndarray) -> tuple[type, np.ndarray, np.ndarray, np.ndarray]:
        """Points and boxes in the narrowest type in which every product sum with q is exact."""
        most = self.reach * _reach(q)
        kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object
        if kind not in self._cast:
            self._cast[kind] = tuple(x.astype(kind) for x in (self.points, self.low, self.high))
        return kind, *self._cast[kind]

    def search(self, q: np.ndarray, own: int, k: int, least: int) -> list[tuple[int, int]]:
        """The best k (score, id) by score, then smaller id, among those that score at least ``least``."""
        kind, points, low, high = self._for(q)
        q = q.astype(kind)
        # the most that any vector of each node can score
        bound = _long((np.where(q > 0, high, low) * q).sum(axis=1))
        found: list[tuple[int, int]] = []  # heap of (score, -id): its head is the worst kept
        heap = [(-bound[0], 0)]
        while heap:
            b, node = heapq.heappop(heap)
            floor = max(least, found[0][0]) if len(found) == k else least
            if -b < floor:
                break
            s, e, left, right = self.nodes[node]
            if left >= 0:
                heapq.heappush(heap, (-bound[left], left))
                heapq.heappush(heap, (-bound[right], right))
                continue
            scores = _long(points[s:e] @ q)
            for i in np.flatnonzero(scores >= floor):
                if self.ids[s + i] != own:
                    item = (int(scores[i]), -int(self.ids[s + i]))
                    if len(found) < k:
                        heapq.heappush(found, item)
                    elif item > found[0]:
                        heapq.heapreplace(found, item)
        return [(s, -i) for s, i in sorted(found, reverse=True)]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.int64)


def _search_shard(key: tuple, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """One shard and one block of queries; both come in one group, queries marked by ``least``."""
    is_query = rows["asks"].to_numpy(bool)
    points, asks = rows[~is_query], rows[is_query]
    out = []
    if len(points) and len(asks):
        tree = BoxTree(points["vec_id"].to_numpy(np.int64), _matrix(points["q"]))
        for own, q, least in zip(asks["vec_id"], _matrix(asks["q"]), asks["least"], strict=True):
            out += [(own, i, s) for s, i in tree.search(q, own, k, least)]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")


def topk(vectors: DataFrame, is_query, k: int = 5, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of each vector for which ``is_query`` holds."""
    rows = materialise(quantised(vectors).withColumn("dim", F.size("q")).withColumn("h", F.xxhash64("vec_id", "q")), "vectors")
    n = rows.count()
    shards, query_rows = max(1, -(-n // shard)), rows.where(is_query)
    blocks = max(1, -(-query_rows.count() // block))
    data = rows.select("dim", F.pmod("h", F.lit(shards)).cast("int").alias("shard"), "vec_id", "q")
    place = (F.pmod(F.shiftright("h", 7), F.lit(blocks)).cast("int").alias("block"), F.pmod("h", F.lit(shards)).cast("int").alias("home"))
    asks = query_rows.groupBy("vec_id").agg(F.min(F.struct("q", "dim", "h")).alias("x")).select("vec_id", "x.*").select("dim", *place, "vec_id", "q")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    points = data.select("dim", "shard", every.alias("block"), "vec_id", "q", F.lit(False).alias("asks"), F.lit(LOWEST).alias("least"))

    def searched(points: DataFrame, asked: DataFrame) -> DataFrame:
        both = points.unionByName(asked)
        return both.groupBy("dim", "shard", "block").applyInPandas(lambda key, x: _search_shard(key, x, k), RESULT)

    home = asks.select("dim", F.col("home").alias("shard"), "block", "vec_id", "q", F.lit(True).alias("asks"), F.lit(LOWEST).alias("least"))
    seed = materialise(searched(points, home), "seed")
    kth = seed.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("worst")).where(F.col("n") >= k)
    told = asks.join(kth, asks["vec_id"] == kth["query_id"], "left")
    away = told.select("dim", "home", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "block", "vec_id", "q", F.lit(True).alias("asks"), F.coalesce("worst", F.lit(LOWEST)).alias("least"))
    found = seed
    if shards > 1:
        found = seed.unionByName(searched(points, away.where("shard <> home").drop("home")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0
)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s) WHERE rn <= 5
"""
