"""Profile tables: append, latest-wins upsert, delete, retrieval.

The store is a table bucketed by user (:mod:`folioflow.operators.keyed_table`): appends
read nothing, a delete rewrites the buckets that hold one of its users, a caller's
rows are read from one bucket, and every change is one commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vector
from .keyed_table import KeyedTable


def latest(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """One row per key: that of the greatest ``seq``."""
    names = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*names), seq).alias("x"))
    return best.select(key, *[F.col(f"x.{c}").alias(c) for c in names]).select(rows.columns)


def without_users(rows: DataFrame, users: DataFrame, key: str = "user_id") -> DataFrame:
    return rows.join(users.select(key).distinct(), key, "left_anti")


def merge_new(existing: DataFrame, fresh: DataFrame, name: str = "name") -> DataFrame:
    """Existing rows and the fresh ones whose lower-case name is not there yet."""
    known = existing.select(F.lower(name).alias("k")).distinct()
    return existing.unionByName(fresh.join(known, F.lower(fresh[name]) == known["k"], "left_anti"))


class ProfileStore:
    """``store``, ``query``, ``delete``, ``users`` over a bucketed table of profiles in the folder ``path``."""

    SCHEMA = "id string, user_id string, vector_id string, profile_json string, embedding array<double>, stored_at double"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.table = KeyedTable(spark, path, "user_id", self.SCHEMA, buckets)

    def rows(self) -> DataFrame:
        return self.table.read()

    def store(self, profiles: DataFrame) -> None:
        """Append ``user_id, profile_json, text, stored_at``: many rows per user are kept."""
        embedded = vector.embed(profiles.withColumn("row", F.monotonically_increasing_id()).withColumn("key", F.struct("row", "user_id", "profile_json", "stored_at")), "key")
        rows = embedded.select(F.expr("uuid()").alias("id"), "key.user_id", F.concat_ws("_", "key.user_id", F.col("key.stored_at").cast("long").cast("string")).alias("vector_id"), "key.profile_json", "embedding", "key.stored_at")
        self.table.append(rows)

    def query(self, asks: DataFrame, k: int = 3) -> DataFrame:
        """``query_id, user_id, text`` to the k most similar of the user's latest profiles."""
        q = vector.embed(asks.withColumn("key", F.struct("query_id", "user_id")), "key").select("key.query_id", "key.user_id", F.col("embedding").alias("q"))
        return vector.top_k(self.rows(), q, k).select("query_id", "user_id", "rank", "score", "profile_json")

    def delete(self, users: DataFrame) -> None:
        """Rows of these users go; deleting a user that is not there changes nothing."""
        self.table.delete(users.select("user_id"))

    def users(self) -> DataFrame:
        return self.rows().select("user_id").distinct()

    def for_caller(self, user_id: str) -> DataFrame:
        """Row-level security: only the caller's rows, read from the caller's bucket."""
        return self.table.lookup(user_id)


def append_versions(rows: DataFrame, path: str) -> None:
    """Add versions (``extras.version_rows``) to the table at ``path``, a folder for each branch; earlier ones stay."""
    rows.write.mode("append").partitionBy("branch").parquet(path)
