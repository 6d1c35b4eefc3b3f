"""Usage metering over an event log: counts, admission, plans and rate alarms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vocab import FREE_LIMIT
from . import temporal


def monthly_usage(events: DataFrame) -> DataFrame:
    """``user_id, month, resume_count`` from ``user_id, ts``."""
    return events.groupBy("user_id", X.month_key(F.col("ts")).alias("month")).agg(F.count("*").alias("resume_count"))


def latest_plans(events: DataFrame, upgrade: str, downgrade: str) -> DataFrame:
    """Plan after all events: an upgrade makes "pro", a downgrade "free", others change nothing. ``user_id, event_type, ts, event_id``."""
    plan = F.when(F.col("event_type") == upgrade, "pro").when(F.col("event_type") == downgrade, "free")
    rows = events.withColumn("plan", plan).where(F.col("plan").isNotNull())
    return rows.groupBy("user_id").agg(F.max_by("plan", F.struct("ts", "event_id")).alias("plan"))


def upsert_plans(changes: DataFrame) -> DataFrame:
    """Latest plan, and the latest customer id that is not null. ``user_id, seq, plan, customer_id``."""
    known = F.when(F.col("customer_id").isNotNull(), F.col("seq"))
    return changes.groupBy("user_id").agg(F.max_by("plan", "seq").alias("plan"), F.max_by("customer_id", known).alias("customer_id"))


def usage_info(usage: DataFrame, plans: DataFrame) -> DataFrame:
    """Usage with plan (default free), limit (null for pro) and whether the next call is allowed."""
    rows = usage.join(plans, "user_id", "left").withColumn("plan", F.coalesce("plan", F.lit("free")))
    return rows.withColumn("usage_limit", F.when(F.col("plan") != "pro", FREE_LIMIT)).withColumn("allowed", (F.col("plan") == "pro") | (F.col("resume_count") < FREE_LIMIT))


def admitted(events: DataFrame, limit: int = FREE_LIMIT) -> DataFrame:
    """Each event with its place in the user's month and whether it is within the limit. Places are counted within days and carried over."""
    placed = temporal.running_place(events, [F.col("user_id"), X.month_key(F.col("ts"))], "ts", "event_id", 86_400_000_000)
    return placed.withColumn("allowed", F.col("place") <= limit)


def busy_hours(events: DataFrame, seconds: int = 3600, limit: int = 20) -> DataFrame:
    """Events that are more than ``limit`` of a user's events within the last ``seconds`` (the event included)."""
    return temporal.trailing_count(events, ["user_id"], "ts", seconds).where(F.col("in_window") > limit)


def customer_of(plans: DataFrame, revoked: DataFrame) -> DataFrame:
    """Plans after the customers of ``revoked`` lost theirs: plan "free" by lookup on ``customer_id``."""
    gone = revoked.select("customer_id").distinct().withColumn("gone", F.lit(True))
    rows = plans.join(gone, "customer_id", "left")
    return rows.withColumn("plan", F.when(F.col("gone"), "free").otherwise(F.col("plan"))).select(plans.columns)


def night_bulk(events: DataFrame, until: int = 6, limit: int = 50) -> DataFrame:
    """``user_id, day, n``: more than ``limit`` events of a user between midnight and ``until`` o'clock."""
    rows = events.where(F.hour("ts") < until).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return rows.where(F.col("n") > limit)


def repeated_requests(events: DataFrame, text: str = "text", seconds: int = 300, limit: int = 10) -> DataFrame:
    """Events that are more than ``limit`` of a user's events with one text within the last ``seconds``."""
    return temporal.trailing_count(events, ["user_id", text], "ts", seconds).where(F.col("in_window") > limit)


def seed_month(ts: Column, back: int) -> Column:
    """Month key of the first of the month, ``back`` times 28 days earlier."""
    return X.month_key(F.date_sub(F.trunc(ts, "month"), 28 * back).cast("timestamp"))


def with_plan_columns(usage: DataFrame) -> DataFrame:
    """Rows of an older table under the newer schema: ``plan`` (free) and ``customer_id`` (null) where they are missing."""
    new = {"plan": F.lit("free"), "customer_id": F.lit(None).cast("string")}
    return usage.withColumns({c: v for c, v in new.items() if c not in usage.columns})
