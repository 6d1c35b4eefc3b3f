"""Connected components of an edge table by alternating large-star and small-star steps.

All data stays in tables; the driver sees counts only. Each step's result is
written to the shared folder, so a lost executor costs no recomputation of
earlier steps; the table before it goes. The least neighbour of a node with very
many of them is found by partial aggregation, and its rows are joined by an
exchange that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, spread_by


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = spread_by(both, "u", F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = spread_by(down, "u", F.min("v").alias("m"))
    moved = down.join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the least node of the component of each node that an edge ``u, v`` names."""
    now = materialise(edges.where("u <> v").distinct(), "edges")
    mark = None
    while True:
        # a node with itself is no edge, but keeps its root known
        step = materialise(_small_star(_large_star(now)).where("u <> v").distinct(), "stars")
        seen = step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = step
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = materialise(roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots")
    discard(now)
    return roots


def joined_roots(roots: DataFrame, moved: DataFrame) -> DataFrame:
    """``roots`` after ``moved``, the components of its roots (and of nodes it does not name)."""
    to = moved.select(F.col("node").alias("root"), F.col("root").alias("to"))
    old = roots.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    new = moved.join(roots, "node", "left_anti").select("node", "root")
    out = materialise(old.unionByName(new), "roots")
    discard(moved)
    return out
