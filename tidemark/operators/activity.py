"""Activity split into sessions by inactivity gaps.

Events are first combined, before any shuffle, into cells of the threshold's width: no gap can
lie between two events of one cell, so a cell is one row with its first and last event and their
number, however many events a hot entity has. The lag inside an entity then flags a gap above
the threshold and the running sum of flags numbers the sessions. It runs twice: inside buckets of
many cells, so no task holds a whole entity, then over the stretches that touch a bucket's edge. A
stretch that is neither first nor last in its bucket is final already, so the second pass sees at
most two rows per entity and bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.scratch import Scratch

#: Cells per bucket: what one task sorts of one entity.
CELLS_AT_ONCE = 4_096


def cell_of(at: Column, gap: int) -> Column:
    """The cell of an instant: whole numbers of one cell are at most ``gap`` apart."""
    return F.floor(at / F.lit(gap + 1)).cast("bigint")


def cells(events: DataFrame, keys: Sequence[str], at: str, gap: int, count: str | None = None) -> DataFrame:
    """``keys, __cell, __a, __b, __n``: first and last instant and number of events (or sum of ``count``) of every cell."""
    at_col = F.col(at).cast("bigint")
    n = F.count(F.lit(1)) if count is None else F.sum(count)
    return (
        events.where(at_col.isNotNull())
        .groupBy(*keys, cell_of(at_col, gap).alias("__cell"))
        .agg(F.min(at_col).alias("__a"), F.max(at_col).alias("__b"), n.alias("__n"))
    )


def numbered(df: DataFrame, keys: Sequence[str], gap: int) -> DataFrame:
    """``df(keys, __a, __b)`` plus ``__no``, the number of its session within the keys."""
    order = Window.partitionBy(*keys).orderBy("__a", "__b")
    away = F.col("__a") - F.lag("__b").over(order)
    flagged = df.withColumn("__flag", F.when(away > gap, 1).otherwise(0))
    return flagged.withColumn("__no", F.sum("__flag").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__flag")


def stretches(df: DataFrame, keys: Sequence[str], gap: int) -> DataFrame:
    """``keys, __a, __b, __n`` of the sessions of ``df(keys, __a, __b, __n)``."""
    per = numbered(df, keys, gap).groupBy(*keys, "__no")
    return per.agg(F.min("__a").alias("__a"), F.max("__b").alias("__b"), F.sum("__n").alias("__n")).drop("__no")


def activity_sessions(
    events: DataFrame, keys: Sequence[str], at_us: str, gap_us: int = 300_000_000, count: str | None = None
) -> DataFrame:
    """``keys, start_us, end_us, event_count``: stretches with no inner gap above ``gap_us``.

    A gap of exactly ``gap_us`` does not split. Events without a time do not count; null
    keys form their own group; equal times and repeated rows all count as events. ``count`` names a
    column that says how many events a row stands for. The stretches of the buckets are written to the
    shared folder before the second pass.
    """
    bucket = F.floor(F.col("__cell") / F.lit(CELLS_AT_ONCE)).cast("bigint").alias("__bucket")
    single = cells(events, keys, at_us, gap_us, count).select(*keys, bucket, "__a", "__b", "__n")
    inside = Window.partitionBy(*keys, "__bucket")
    edge = (F.col("__a") == F.min("__a").over(inside)) | (F.col("__b") == F.max("__b").over(inside))
    local = stretches(single, [*keys, "__bucket"], gap_us).withColumn("__edge", edge)
    local = Scratch(events.sparkSession).cut(local, "stretches")
    final = local.where(~F.col("__edge")).select(*keys, "__a", "__b", "__n")
    joined = stretches(local.where("__edge").select(*keys, "__a", "__b", "__n"), list(keys), gap_us)
    return final.unionByName(joined).select(
        *keys, F.col("__a").alias("start_us"), F.col("__b").alias("end_us"), F.col("__n").alias("event_count")
    )
