"""Joins and counts along time that split a key's rows by time, so that no key is one task's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(at: Column, width: int | float | None) -> Column:
    """Number of the bucket of ``width`` (microseconds for timestamps) that holds ``at``; one bucket where there is no width."""
    return F.lit(0).cast("long") if width is None else F.floor(at / F.lit(width)).cast("long")


def _number(df: DataFrame, column: str) -> Column:
    """A column to order by, as a number: timestamps and dates in microseconds."""
    kind = df.schema[column].dataType.typeName()
    return F.unix_micros(F.col(column).cast("timestamp")) if kind in ("timestamp", "timestamp_ntz", "date") else F.col(column)


def asof(left: DataFrame, right: DataFrame, by: str, at: str, take: list[str], width: int | float | None = None, tie: str | None = None) -> DataFrame:
    """Every row of ``left`` with the columns ``take`` of the latest row of ``right`` of its key at or before its ``at``.

    Rows of both sides with one key (and one bucket of ``width``) meet in one
    shuffle, in order; the latest right row is carried along by a window, never
    joined pair by pair. With a width a key's rows are spread over its buckets:
    the latest row of each bucket (a small aggregate) is carried to the next
    bucket that has left rows, and opens it. Of right rows of one time the
    greatest ``tie`` counts. Left rows without an earlier right row get nulls;
    rows with a null key or time match nothing, left ones stay.
    """
    names = left.columns
    lead = F.struct(*[F.col(f"`{c}`") for c in names])
    l_rows = left.select(F.col(by).alias("_by"), _number(left, at).alias("_at"), lead.alias("_row"))
    found = F.struct(*[F.col(c).alias(c) for c in take])
    order = F.col(tie) if tie else F.lit(0)
    r_rows = right.where(F.col(by).isNotNull() & F.col(at).isNotNull()).select(F.col(by).alias("_by"), _number(right, at).alias("_at"), order.alias("_tie"), found.alias("_found"))
    l_rows, r_rows = (x.withColumn("_bucket", _bucket(F.col("_at"), width)) for x in (l_rows, r_rows))
    empty = l_rows.schema["_row"].dataType
    none = F.lit(None).cast(r_rows.schema["_found"].dataType)
    no_tie = F.lit(None).cast(r_rows.schema["_tie"].dataType)
    # 0: what an earlier bucket leaves, 1: right rows, 2: left rows
    parts = [
        r_rows.select("_by", "_bucket", "_at", F.lit(1).alias("_side"), "_tie", F.lit(None).cast(empty).alias("_row"), "_found"),
        l_rows.select("_by", "_bucket", "_at", F.lit(2).alias("_side"), no_tie.alias("_tie"), "_row", none.alias("_found")),
    ]
    if width is not None:
        last = r_rows.groupBy("_by", "_bucket").agg(F.max_by("_found", F.struct("_at", "_tie")).alias("_found"))
        asked = l_rows.where(F.col("_by").isNotNull() & F.col("_at").isNotNull()).groupBy("_by", "_bucket").agg(F.lit(True).alias("_asked"))
        both = last.join(asked, ["_by", "_bucket"], "full")
        before = Window.partitionBy("_by").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        carried = both.withColumn("_head", F.last("_found", ignorenulls=True).over(before)).where(F.col("_asked") & F.col("_head").isNotNull())
        first = F.lit(None).cast(r_rows.schema["_at"].dataType)
        parts.append(carried.select("_by", "_bucket", first.alias("_at"), F.lit(0).alias("_side"), no_tie.alias("_tie"), F.lit(None).cast(empty).alias("_row"), F.col("_head").alias("_found")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    order_ = Window.partitionBy("_by", "_bucket").orderBy(F.col("_at").asc_nulls_first(), "_side", "_tie")
    filled = rows.withColumn("_found", F.last("_found", ignorenulls=True).over(order_.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("_side") == 2)
    matched = F.col("_by").isNotNull() & F.col("_at").isNotNull()
    return filled.select(*[F.col(f"_row.`{c}`").alias(c) for c in names], *[F.when(matched, F.col(f"_found.{c}")).alias(c if c not in names else f"{c}_right") for c in take])


def trailing_count(rows: DataFrame, keys: list[str], at: str, seconds: int, name: str = "in_window") -> DataFrame:
    """Add to every row how many rows of its keys lie within the last ``seconds``, itself and rows of its own time included.

    Rows are dealt by keys and by the bucket of one window's length; each is
    also shown to the bucket behind its own, as what that one looks back on. So
    a key's rows are spread over its buckets, and nothing is shuffled twice.
    """
    span = seconds * 1_000_000
    # rows without a time have no window: they count nothing and are counted by none
    shown = rows.withColumn("_at", _number(rows, at)).withColumn("_own", F.explode(F.when(F.col("_at").isNull(), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))))
    bucket = F.floor(F.col("_at") / span).cast("long") + F.when(F.col("_own"), 0).otherwise(1)
    w = Window.partitionBy(*[F.col(k) for k in keys], "_bucket").orderBy("_at").rangeBetween(-span, 0)
    counted = shown.withColumn("_bucket", bucket).withColumn(name, F.when(F.col("_at").isNotNull(), F.count("*").over(w)))
    return counted.where("_own").drop("_at", "_own", "_bucket")


def running_place(rows: DataFrame, keys: list[Column], at: str, tie: str, width: int, name: str = "place") -> DataFrame:
    """Add each row's place, from 1, among the rows of its keys in the order of ``at`` and ``tie``.

    Rows are numbered within their keys and time bucket of ``width``
    microseconds; what earlier buckets hold is a running sum over one count a
    bucket, joined to the rows. Rows without a time come first, as one bucket.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    dealt = rows.withColumns(dict(zip(names, keys, strict=True))).withColumn("_bucket", F.coalesce(_bucket(_number(rows, at), width), F.lit(-(1 << 62))))
    counts = dealt.groupBy(*names, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(c).alias(f"_o{c}") for c in names], F.col("_bucket").alias("_ob"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within =F.row_number().over(Window.partitionBy(*names, "_bucket").orderBy(at, tie))
    numbered = dealt.withColumn("_within", within)
    same = numbered["_bucket"] == offsets["_ob"]
    for c in names:
        same = same & numbered[c].eqNullSafe(offsets[f"_o{c}"])
    found = numbered.join(offsets, same).withColumn(name, (F.col("_before") + F.col("_within")).cast("int"))
    return found.drop("_within", "_before", "_bucket", "_ob", *names, *[f"_o{c}" for c in names])
