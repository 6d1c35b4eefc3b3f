"""Streaming counterparts of metering: monthly counts, admission and rate alarms over an event stream.

The input is a streaming frame ``user_id, ts, event_id``. Late events within the
watermark count; later ones are dropped by Spark. State is bounded by the
watermark plus the window length, per active user.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as X
from ..functions.vocab import FREE_LIMIT


def monthly_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """``user_id, month, resume_count``, in update mode."""
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return marked.groupBy("user_id", X.month_key(F.col("ts")).alias("month")).agg(F.count("*").alias("resume_count"))


def admissions(events: DataFrame, limit: int = FREE_LIMIT, late: str = "2 days") -> DataFrame:
    """``event_id, user_id, ts, place, allowed``: each event's place in its user's month, in append mode.

    The state of a user's month is one number. It is dropped when the watermark
    passes the month's end, so what is kept follows the users of the present
    month. Events of one micro-batch are placed in the order of ``ts`` and
    ``event_id``, those of a later batch behind them; where batches follow time the
    places are those of the whole log.
    """
    month_end = F.add_months(F.trunc("ts", "month"), 1).cast("timestamp")
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    keyed = marked.select("event_id", "user_id", "ts", F.unix_millis(month_end).alias("ends"))

    def place(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = state.get[0] if state.exists else 0
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        places = range(n + 1, n + 1 + len(batch))
        state.update((n + len(batch),))
        # a month that is over already can't wait for its end
        state.setTimeoutTimestamp(max(int(key[1]), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": batch["event_id"].to_numpy(), "user_id": key[0], "ts": batch["ts"].to_numpy(), "place": list(places), "allowed": [p <= limit for p in places]})

    kinds = dict(events.dtypes)
    out = f"event_id {kinds['event_id']}, user_id {kinds['user_id']}, ts timestamp, place int, allowed boolean"
    return keyed.groupBy("user_id", "ends").applyInPandasWithState(place, out, "n long", "append", GroupStateTimeout.EventTimeTimeout)


def run_admissions(events: DataFrame, path: str, checkpoint: str, limit: int = FREE_LIMIT, late: str = "2 days") -> None:
    """Place all events that are there now and end; the next run goes on where this one stopped."""
    sink = admissions(events, limit, late).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    sink.trigger(availableNow=True).start().awaitTermination()


def rate_alarms(events: DataFrame, window: str = "60 minutes", slide: str = "5 minutes", limit: int = 20, late: str = "10 minutes") -> DataFrame:
    """``user_id, start, n`` of windows in which a user has more than ``limit`` events."""
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = marked.groupBy(F.window("ts", window, slide).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > limit).select("user_id", F.col("w.start").alias("start"), "n")


def slice_counts(events: DataFrame, slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """``user_id, slice, n``: events by user and slice of time, in update mode; an event is part of one number, however many windows hold it."""
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return marked.groupBy(F.window("ts", slide).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("slice"), "n")


def alarms_of(slices: DataFrame, limit: int = 20, slices_a_window: int = 12, slide_seconds: int = 300) -> DataFrame:
    """:func:`rate_alarms` from the counts of :func:`slice_counts`, as a table.

    A window with more than ``limit`` events needs as many within its length around
    each of its slices; only such slices are shown to their windows. A user has
    few slices (288 a day), whatever the number of events.
    """
    step = slide_seconds * 1_000_000
    reach = (slices_a_window - 1) * step
    around = Window.partitionBy("user_id").orderBy("_at").rangeBetween(-reach, reach)
    rows = slices.withColumn("_at", F.unix_micros("slice")).withColumn("_around", F.sum("n").over(around)).where(F.col("_around") > limit)
    shown = rows.select("user_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(slices_a_window - 1)), lambda k: F.timestamp_micros(F.col("_at") - k.cast("long") * F.lit(step)))).alias("start"), "n")
    return shown.groupBy("user_id", "start").agg(F.sum("n").alias("n")).where(F.col("n") > limit)


def repeated_requests(requests: DataFrame, limit: int = 10, late: str = "5 minutes") -> DataFrame:
    """Texts (``text_hash``) sent more than ``limit`` times within five minutes."""
    marked = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = marked.groupBy(F.window("ts", "5 minutes").alias("w"), "text_hash").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > limit).select("text_hash", F.col("w.start").alias("start"), "n")


def upsert_counts(counts: DataFrame, path: str, checkpoint: str):
    """Write each batch's updated counts as a new generation of the usage table: one folder per batch, the newest counts win."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("generation", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)


def run_counts(counts: DataFrame, keys: list[str], value: str, path: str, checkpoint: str) -> DataFrame:
    """Count all events that are there now and end: ``keys, value`` as the newest batch that told of a key has it."""
    upsert_counts(counts, path, checkpoint).trigger(availableNow=True).start().awaitTermination()
    told = counts.sparkSession.read.parquet(path)
    return told.groupBy(*keys).agg(F.max_by(value, "generation").alias(value))
