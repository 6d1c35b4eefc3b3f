"""Hashed embeddings, cosine similarity and retrieval over stored vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

DIM = 128
RECENT = 50


def bucket(token: Column, dim: int = DIM) -> Column:
    """md5(token) mod dim for a power of two up to 256: the hash's last byte decides."""
    if dim & (dim - 1) or not 0 < dim <= 256:
        raise ValueError("the native bucket needs a power of two up to 256")
    return (F.conv(F.right(F.md5(token.cast("binary")), F.lit(2)), 16, 10).cast("int") % dim).cast("int")


def norm(v: Column) -> Column:
    """L2 norm, 1 for the zero vector."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(n == 0, 1.0).otherwise(n)


def hashed_counts(texts: DataFrame, key: str = "doc_id", dim: int = DIM) -> DataFrame:
    """``key, bucket, n``: the histogram of hashed blank-separated lower-case words."""
    return texts.select(key, F.explode(X.words(F.lower("text"))).alias("w")).groupBy(key, bucket(F.col("w"), dim).alias("bucket")).agg(F.count("*").alias("n"))


def dense_counts(text: Column, dim: int = DIM) -> Column:
    """array<double> of ``dim`` entries: words of a text per bucket; zeros for a null text."""

    @F.arrow_udf("array<double>")
    def counted(buckets: pa.Array) -> pa.Array:
        sizes = pc.list_value_length(buckets).to_numpy(zero_copy_only=False)
        at = np.repeat(np.arange(len(sizes)), sizes) * dim + buckets.flatten().to_numpy(zero_copy_only=False)
        counts = np.bincount(at, minlength=len(sizes) * dim).astype(np.float64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * dim), pa.array(counts))

    return counted(F.coalesce(F.transform(X.words(F.lower(text)), lambda w: bucket(w, dim)), F.array().cast("array<int>")))


def embed(texts: DataFrame, key: str = "doc_id", dim: int = DIM) -> DataFrame:
    """``key, embedding array<double>`` of every text, L2-normalised, zeros for texts without words; no shuffle."""
    return texts.select(key, X.let(dense_counts(F.col("text"), dim), lambda v: X.let(norm(v), lambda n: F.transform(v, lambda x: x / n))).alias("embedding"))


def embedder(backend: str = "hash"):
    """The embedding of a backend by name: ``hash``, or ``given`` for frames that bring an ``embedding`` column of another model."""
    if backend == "hash":
        return embed
    if backend == "given":
        return lambda texts, key="doc_id": texts.select(key, F.col("embedding").cast("array<double>").alias("embedding"))
    raise ValueError(f"unknown embedding backend {backend!r}")


def cosine(a: Column, b: Column) -> Column:
    """Dot product over the shorter length, norms over each whole vector, a zero norm counted as 1."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double"), F.lit(0.0)) * F.coalesce(y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    return dot / (norm(a) * norm(b))


def recent(rows: DataFrame, user: str = "user_id", at: str = "stored_at", tie: str = "id", k: int = RECENT) -> DataFrame:
    """The k latest rows of each user; rows without a vector count among them."""
    w = Window.partitionBy(user).orderBy(F.desc(at), F.desc(tie))
    return rows.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= k)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """For each query (``query_id, user_id, q``): the k best of its user's 50 latest vectors, later rows first among equals.

    One join on the user; every user has at most 50 candidates.
    """
    candidates = recent(rows).where(F.size("embedding") > 0)
    scored = queries.join(candidates, "user_id").withColumn("score", cosine(F.col("q"), F.col("embedding")))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "recency")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
