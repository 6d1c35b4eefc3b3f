"""An inverted-file index over stored vectors, with upsert, delete and an exact way.

Vectors are dealt to cells around k-means centres. The centres are fitted once,
on at most ``SAMPLE`` rows (those of the least hashed ids); every row is indexed.
Rows lie in a :class:`~folioflow.operators.keyed_table.KeyedTable` by cell: a search reads
the cells nearest to its queries, a change rewrites the cells that hold one of
its ids, and each is committed by one manifest.

Defined cases: rows without an id, a vector, or with a null, non-finite or missing
component are not indexed; an empty index gives no answers; of several rows for one id in a
batch the greatest vector stays; equal scores go to the smaller id; the
zero vector's cosine with anything is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vector
from .keyed_table import KeyedTable

#: Rows that the centres are fitted on, at most.
SAMPLE = 20_000
CELLS = 64
PROBES = 16
#: Rows of one cell that meet its queries in one task, and queries that meet them there, about.
SHARE = 50_000
ASKS = 4_000
#: Scores that are held at once, and the most by which a product of whole matrices may be off.
AT_ONCE = 1 << 22
NEAR = 1e-9
ROWS = "id long, cell int, embedding array<double>"


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column as a matrix, shorter ones filled up with zeros."""
    rows = vectors.combine_chunks()
    sizes = np.diff(rows.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = rows.flatten().to_numpy(zero_copy_only=False)
    return out


def _norms(v: np.ndarray) -> np.ndarray:
    total = np.zeros(len(v))
    for column in v.T:
        total += column * column
    total = np.sqrt(total)
    return np.where(total == 0, 1.0, total)


def best_by_cosine(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query rows, ids, scores): the ``k`` best of each query, equal scores to the smaller id; some of the queries at a time.

    A matrix product tells which rows may be among the best. These are scored
    term by term in the vectors' order, as :func:`vector.cosine` does, so equal vectors have equal scores.
    """
    with np.errstate(all="ignore"):
        q_norm, v_norm = _norms(q), _norms(v)
        unit = (v / v_norm[:, None]).T
        step = max(1, AT_ONCE // max(1, len(v)))
        for at in range(0, len(q), step):
            part, norm = q[at : at + step], q_norm[at : at + step]
            rough = (part / norm[:, None]) @ unit
            rough[~np.isfinite(rough)] = np.inf  # too large for the product: scored below
            least = np.partition(rough, len(v) - k, axis=1)[:, len(v) - k] if len(v) > k else np.full(len(part), -np.inf)
            row, col = np.nonzero(rough >= (least - NEAR)[:, None])
            for some in np.array_split(np.arange(len(row)), len(row) // AT_ONCE + 1):
                r, c = row[some], col[some]
                score = np.zeros(len(r))
                for j in range(q.shape[1]):
                    score += part[r, j] * v[c, j]
                score /= norm[r] * v_norm[c]
                order = np.lexsort((ids[c], -score, r))
                r, c, score = r[order], c[order], score[order]
                first = np.searchsorted(r, r)
                kept = np.arange(len(r)) - first < k
                yield at + r[kept], ids[c[kept]], score[kept]


class VectorIndex:
    """``build``, ``upsert``, ``delete`` and ``search`` over ``id, embedding`` in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str, cells: int = CELLS):
        self.spark, self.path, self.cells = spark, path.rstrip("/"), cells
        self.rows = KeyedTable(spark, f"{self.path}/rows", "cell", ROWS, buckets=cells)

    def _usable(self, rows: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        one = rows.select(F.col("id").cast("long").alias("id"), v.alias("embedding")).where(F.col("id").isNotNull() & (F.size("embedding") > 0) & good)
        return one.groupBy("id").agg(F.max("embedding").alias("embedding"))

    def build(self, rows: DataFrame) -> None:
        """Fit the centres and index every row; replaces what the index held."""
        usable = self._usable(rows)
        sample = usable.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select(array_to_vector("embedding").alias("v"))
        model = KMeans(k=self.cells, seed=7, maxIter=10, featuresCol="v", predictionCol="cell").fit(sample)
        model.write().overwrite().save(f"{self.path}/centres")
        self.rows.overwrite(self._dealt(usable, model))

    def _model(self) -> KMeansModel:
        return KMeansModel.load(f"{self.path}/centres")

    def _dealt(self, usable: DataFrame, model: KMeansModel | None = None) -> DataFrame:
        dealt = (model or self._model()).transform(usable.withColumn("v", array_to_vector("embedding")))
        return dealt.select("id", F.col("cell").cast("int").alias("cell"), "embedding")

    def upsert(self, rows: DataFrame) -> int:
        """Rows take the place of those of their ids, whatever cells they are in."""
        batch = self._dealt(self._usable(rows))
        return self.rows.replace("id", batch.select("id"), batch)

    def delete(self, ids: DataFrame) -> int:
        """Rows of these ids go; only cells that hold one are rewritten."""
        return self.rows.replace("id", ids.select(F.col("id").cast("long").alias("id")))

    def _nearest(self, queries: DataFrame, probes: int) -> DataFrame:
        """``query_id, q, cell``: the ``probes`` cells whose centres are nearest to each query."""
        centres = self.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(self._model().clusterCenters())], "cell int, centre array<double>")
        apart = F.aggregate(F.zip_with("q", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        w = Window.partitionBy("query_id").orderBy(apart, "cell")
        met = queries.crossJoin(F.broadcast(centres))  # as many rows as cells for each query
        return met.withColumn("_near", F.row_number().over(w)).where(F.col("_near") <= probes).select("query_id", "q", "cell")

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = PROBES, score: Column | None = None) -> DataFrame:
        """``query_id, rank, id, score`` of the ``k`` best by cosine (or ``score`` of ``q`` and ``embedding``). No ``probes``: all cells, the exact answer.

        Queries meet the rows of their cells in shares, so a large cell is several tasks' work.
        """
        asks = queries.select("query_id", F.col("q").cast("array<double>").alias("q"))
        n = self.rows.read().count()
        if not n:
            return self.spark.createDataFrame([], "query_id long, rank int, id long, score double")
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        ranked = lambda rows: rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
        # queries with a component that is no finite number are scored pair by pair
        plain = F.coalesce(F.forall("q", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        if score is None:
            found = self._blocks(asks.where(plain), n, k, probes).unionByName(self._pairs(asks.where(~plain), n, probes, vector.cosine(F.col("q"), F.col("embedding"))))
            return ranked(found)
        return ranked(self._pairs(asks, n, probes, score))

    def _asked(self, asks: DataFrame, probes: int | None) -> tuple[DataFrame, DataFrame]:
        """``query_id, q, cell`` and the rows of these cells; without ``probes`` all rows are one cell's."""
        if probes is None:
            return asks.withColumn("cell", F.lit(0)), self.rows.read().withColumn("cell", F.lit(0))
        asked = self._nearest(asks, min(probes, self.cells))
        return asked, self.rows.read_keys(asked.select("cell"))

    def _pairs(self, asks: DataFrame, n: int, probes: int | None, score: Column) -> DataFrame:
        """``query_id, id, score`` of every query with every row of its cells."""
        asked, held = self._asked(asks, probes)
        shares = max(1, -(-n // SHARE))
        held = held.withColumn("_share", F.pmod(F.xxhash64("id"), F.lit(shares)))
        dealt = asked.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
        return dealt.join(held, ["cell", "_share"]).select("query_id", "id", score.alias("score"))

    def _blocks(self, asks: DataFrame, n: int, k: int, probes: int | None) -> DataFrame:
        """``query_id, id, score``: the ``k`` best by cosine of each share of the rows, scored as blocks of queries and rows."""
        asked, held = self._asked(asks, probes)
        shares, parts = max(1, -(-n // SHARE)), max(1, -(-asks.count() // ASKS))
        spread = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
        keys = ["cell", "_share", "_part"]
        held = held.withColumn("_share", F.pmod(F.xxhash64("id"), F.lit(shares))).withColumn("_part", spread(parts)).select(*keys, "id", "embedding")
        dealt = asked.withColumn("_share", spread(shares)).withColumn("_part", F.pmod(F.xxhash64("query_id"), F.lit(parts))).select(*keys, "query_id", "q")
        kind = dict(asks.dtypes)["query_id"]

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            names, made = ["query_id", "id", "score"], []
            if len(left) and len(right):
                width = max(len(x) for t, c in ((left, "q"), (right, "embedding")) for x in t[c])
                ids, asking = right["id"].to_numpy(), left["query_id"]
                for row, found, score in best_by_cosine(_matrix(left["q"], width), _matrix(right["embedding"], width), ids, k):
                    made.append(pa.table([asking.take(pa.array(row)), pa.array(found), pa.array(score)], names))
            return pa.concat_tables(made) if made else pa.table([left["query_id"].slice(0, 0), pa.array([], pa.int64()), pa.array([], pa.float64())], names)

        return dealt.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(run, f"query_id {kind}, id long, score double")

    def recall(self, queries: DataFrame, k: int = 10, probes: int = PROBES) -> float:
        """The share of the exact answers that a search with ``probes`` finds."""
        exact = self.search(queries, k, None).select("query_id", "id")
        found = self.search(queries, k, probes).select("query_id", "id", F.lit(1).alias("_found"))
        n, hit = exact.join(found, ["query_id", "id"], "left").agg(F.count("*"), F.sum(F.coalesce("_found", F.lit(0)))).first()
        return hit / n if n else 1.0

