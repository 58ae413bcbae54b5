"""Interval operators of the attention and agent clocks.

All take ``by``, the keys of independent timelines; an empty list is one global timeline.
None orders a whole timeline in one task: instants are combined before the shuffle into cells in
which no gap can lie (or into whole seconds), cells are cut into buckets of time, and what
crosses a bucket's edge is stitched. What a task sorts depends on the span of time and not on
the number of observations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.activity import CELLS_AT_ONCE, activity_sessions, cell_of, cells, numbered
from tidemark.scratch import Scratch
from tidemark.schema import AFTER, BEFORE, CLUSTER_GAP, DAY


#: Seconds of a group that one task orders row by row.
NARROW = 300


def _bucket(t: str, width: int) -> Column:
    return F.floor(F.col(t) / F.lit(width)).cast("bigint")


def _same(keys: Sequence[str], prefix: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return out


def clusters(instants: DataFrame, by: Sequence[str], t: str = "instant", gap: int = CLUSTER_GAP, count: str | None = None) -> DataFrame:
    """``by, start, end, n``: runs of instants in which no neighbour is more than ``gap`` seconds away.

    Null instants do not count; a gap of exactly ``gap`` joins; equal instants count each. ``count`` names a
    column that says how many instants a row stands for.
    """
    runs = activity_sessions(instants, list(by), t, gap, count)
    return runs.select(*by, F.col("start_us").alias("start"), F.col("end_us").alias("end"), F.col("event_count").alias("n"))


def window_union(anchors: DataFrame, by: Sequence[str], t: str = "instant", before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """``by, start, end``: the merged windows ``[t - before, t + after)``; touching windows merge.

    Windows of one width touch or overlap exactly when their anchors are within that width, so
    the union is the clusters of the anchors, widened.
    """
    runs = clusters(anchors, by, t, before + after)
    return runs.select(*by, (F.col("start") - before).alias("start"), (F.col("end") + after).alias("end"))


def seconds(spans: DataFrame, by: Sequence[str], out: str) -> DataFrame:
    """``by, out``: the summed length of disjoint spans."""
    return spans.groupBy(*by).agg(F.sum(F.col("end") - F.col("start")).alias(out))


def cluster_cells(instants: DataFrame, by: Sequence[str], t: str = "instant", gap: int = CLUSTER_GAP) -> DataFrame:
    """``by, __cell, first, __n``: every cell that holds instants, and the first instant of its cluster."""
    keys = [*by, "__bucket"]
    single = cells(instants, by, t, gap).withColumn("__bucket", F.floor(F.col("__cell") / F.lit(CELLS_AT_ONCE)).cast("bigint"))
    inside = Window.partitionBy(*keys)
    local = numbered(single, keys, gap)
    run = Window.partitionBy(*keys, "__no")
    lo, hi = F.min("__a").over(run), F.max("__b").over(run)
    local = local.withColumns({"__lo": lo, "__hi": hi})
    local = local.withColumn("__edge", (F.col("__lo") == F.min("__lo").over(inside)) | (F.col("__hi") == F.max("__hi").over(inside)))
    local = Scratch(instants.sparkSession).cut(local.select(*by, "__bucket", "__cell", "__n", "__lo", "__hi", "__edge"), "cells")
    line = Window.partitionBy(*by).orderBy("__lo")
    stitched = (
        local.where("__edge").select(*by, "__lo", "__hi").distinct()
        .withColumn("__new", F.when(F.col("__lo") - F.lag("__hi").over(line) <= gap, F.lit(None)).otherwise(F.col("__lo")))
        .select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col("__lo").alias("__k"), F.last("__new", ignorenulls=True).over(line).alias("first"))
    )
    edged = local.where("__edge").join(stitched, (F.col("__lo") == F.col("__k")) & _same(by, "__k_"))
    inner = local.where("not __edge").withColumn("first", F.col("__lo"))
    out = [*by, "__cell", "first", "__n"]
    return edged.select(*out).unionByName(inner.select(*out))


def labelled_clusters(instants: DataFrame, by: Sequence[str], t: str = "instant", gap: int = CLUSTER_GAP, out: str = "block") -> DataFrame:
    """``instants`` plus ``out``, the first instant of the cluster each belongs to (null for a null instant).

    Rows find their cluster by their cell, in a many-to-one join.
    """
    found = cluster_cells(instants, by, t, gap)
    named = found.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col("__cell").alias("__k_cell"), F.col("first").alias(out))
    labelled = instants.withColumn("__cell", cell_of(F.col(t), gap)).join(named, (F.col("__cell") == F.col("__k_cell")) & _same(by, "__k_"), "left")
    return labelled.drop("__cell", "__k_cell", *[f"__k_{c}" for c in by])


def nearest_anchor_shares(
    anchors: DataFrame, by: Sequence[str], label: str = "repository", t: str = "instant", before: int = BEFORE, after: int = AFTER
) -> DataFrame:
    """``by, label, seconds``: the union of all windows divided among labels, summing to the union.

    The union is cut at every window edge; each piece goes to the covering anchor whose instant is
    nearest the piece's middle, ties to the smallest label, null first. Anchors of one instant are
    one anchor with the smallest label, so a second holds at most one candidate.
    """
    width = before + after
    one = anchors.where(F.col(t).isNotNull()).groupBy(*by, F.col(t).alias("__t")).agg(F.min(F.struct(F.col(label).alias("l"))).alias("__l"))
    one = one.select(*by, "__t", F.col("__l.l").alias("__label"), (F.col("__t") - before).alias("__s"))
    edges = one.select(*by, F.explode(F.array("__s", F.col("__s") + width)).alias("__lo")).distinct()
    # An edge near the start of a bucket also looks ahead for the bucket before; covered pieces are never longer.
    own = _bucket("__lo", DAY)
    ahead = F.when(F.pmod(F.col("__lo"), F.lit(DAY)) <= width, own - 1)
    seen = edges.withColumn("__bucket", F.explode(F.filter(F.array(own, ahead), lambda x: x.isNotNull())))
    after_edge = F.lead("__lo").over(Window.partitionBy(*by, "__bucket").orderBy("__lo"))
    pieces = seen.withColumn("__hi", after_edge).where((F.col("__bucket") == own) & F.col("__hi").isNotNull())
    pieces = pieces.select(*[F.col(c).alias(f"__p_{c}") for c in by], "__lo", "__hi", _bucket("__lo", width).alias("__bin"))
    first_bin = _bucket("__s", width)
    covers = one.withColumn("__cbin", F.explode(F.array(first_bin, first_bin + 1)))
    hit = (F.col("__bin") == F.col("__cbin")) & (F.col("__s") <= F.col("__lo")) & (F.col("__lo") < F.col("__s") + width)
    far = F.abs(F.col("__lo") + F.col("__hi") - 2 * F.col("__t"))
    best = (
        covers.join(pieces, hit & _same(by, "__p_"))
        .groupBy(*by, "__lo", "__hi")
        .agg(F.min(F.struct(far.alias("d"), F.col("__label").alias("l"))).alias("__best"))
    )
    return best.groupBy(*by, F.col("__best.l").alias(label)).agg(F.sum(F.col("__hi") - F.col("__lo")).alias("seconds"))


def previous_row(df: DataFrame, by: Sequence[str], order: Sequence[str], t: str, values: Sequence[str], prefix: str) -> DataFrame:
    """``df`` plus ``prefix + value``: the values of the row before in ``order`` within ``by`` (null for the first).

    ``order`` must start with ``t`` and be total. The last row of each stretch of NARROW seconds is carried to the
    next stretch that has rows, so a hot group is spread over its stretches.
    """
    keys = [*by, "__bucket"]
    cut = df.withColumn("__bucket", _bucket(t, NARROW)).withColumn("__v", F.struct(*[F.col(v).alias(f"v_{v}") for v in values]))
    last = cut.groupBy(*keys).agg(F.max_by("__v", F.struct(*order)).alias("__last"))
    carried = last.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.lag("__last").over(Window.partitionBy(*by).orderBy("__bucket")).alias("__carry")
    )
    local = cut.withColumn("__prev", F.lag("__v").over(Window.partitionBy(*keys).orderBy(*order)))
    joined = local.join(carried, _same(keys, "__k_")).withColumn("__prev", F.coalesce("__prev", "__carry"))
    named = joined.withColumns({f"{prefix}{v}": F.col(f"__prev.v_{v}") for v in values})
    return named.drop("__bucket", "__v", "__prev", "__carry", *[f"__k_{k}" for k in keys])


def containing_span(points: DataFrame, spans: DataFrame, t: str, start: str, end: str, out: str) -> DataFrame:
    """``points`` plus ``out``: the start of the disjoint span with ``start <= t <= end``, else null.

    Spans are listed under every day they touch, so the join is on the day.
    """
    days = F.sequence(_bucket(start, DAY), _bucket(end, DAY))
    listed = spans.select(F.col(start).alias("__a"), F.col(end).alias("__b"), F.explode(days).alias("__day"))
    inside = (_bucket(t, DAY) == F.col("__day")) & (F.col(t) >= F.col("__a")) & (F.col(t) <= F.col("__b"))
    return points.join(listed, inside, "left").withColumn(out, F.col("__a")).drop("__a", "__b", "__day")
