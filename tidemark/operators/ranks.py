"""Ranks and prefix sums over groups of any size without gathering a group.

A group is cut into buckets of its ordering value. Bucket totals are summed with
map-side combining, a running sum over the few buckets of a group gives each
bucket its offset, and the rank inside a bucket is local. The window over a whole
group therefore only ever sees one row per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(
    df: DataFrame, by: Sequence[str], value: str, weight: str, bucket: Column, out: str, whole: str | None = None
) -> DataFrame:
    """Adds ``out``: the sum of ``weight`` over rows of the group up to and including this value; and ``whole``, the group's sum.

    ``value`` must be distinct within its group and ``bucket`` must not decrease with it.
    Null group keys form a group. Empty input gives an empty frame.
    """
    cut = df.withColumn("__bucket", bucket)
    keys = [*by, "__bucket"]
    totals = cut.groupBy(*keys).agg(F.sum(weight).alias("__total"))
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"__o_{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"),
        *([F.sum("__total").over(Window.partitionBy(*by)).alias(whole)] if whole else []),
    )
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__o_{i}"))
    local = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.join(offsets, same)
        .withColumn(out, F.sum(weight).over(local) + F.col("__offset"))
        .drop("__bucket", "__offset", *[f"__o_{i}" for i in range(len(keys))])
    )
