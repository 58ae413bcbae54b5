"""Continuous periods and gaps of overlapping intervals.

Starts and ends are ranked independently per entity. A gap exists exactly where
the start of rank ``i + 1`` lies after the end of rank ``i``; the boundaries of
neighbouring gaps, paired by their own rank, are the periods. Equal starts (ends)
are one row with a count before anything is ranked, and ranks come from bucket
offsets, so an entity that holds a third of all spans stays spread over tasks.

Every step that is read more than once is written once to the shared folder, so
jobs run while the frame is being built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import running_total
from tidemark.scratch import Scratch

DAY = 86_400


def _day(col: str, width: int) -> Column:
    return F.floor(F.col(col) / F.lit(width)).cast("bigint")


def periods_and_gaps(
    spans: DataFrame, entity: str = "repository", start: str = "span_start", end: str = "span_end", width: int = DAY
) -> DataFrame:
    """``entity, stretch_kind ('period' | 'gap'), from_s, to_s`` of half-open integer spans.

    Touching spans form one period. Spans with a null entity or bound, and spans whose
    end is not after the start, do not count; repeated spans change nothing. An entity
    with one period has no gap. ``width`` is the bucket of the rank offsets only and
    never changes the result.
    """
    scratch = Scratch(spans.sparkSession)
    bound = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).cast("bigint").alias("v"))
    valid = spans.where(F.col(entity).isNotNull() & (F.col(end).cast("bigint") > F.col(start).cast("bigint")))
    bounds = valid.select(F.col(entity).alias("e"), F.inline(F.array(bound("start", start), bound("end", end))))
    counted = scratch.cut(bounds.groupBy("e", "kind", "v").agg(F.count(F.lit(1)).alias("n")), "bounds")
    ranked = scratch.cut(running_total(counted, ["e", "kind"], "v", "n", _day("v", width), "upto", "of"), "ranked")
    starts = ranked.where("kind = 'start'").select(
        F.col("e").alias("se"), (F.col("upto") - F.col("n")).alias("sr"), F.col("v").alias("next_start")
    )
    ends = ranked.where("kind = 'end'").select(F.col("e").alias("ee"), F.col("upto").alias("er"), F.col("v").alias("last_end"), "of")
    # Rank 0 has a start only, the last rank an end only: the outer boundaries of an entity.
    met = ends.join(starts, (F.col("ee") == F.col("se")) & (F.col("er") == F.col("sr")), "full")
    outer = (F.col("sr") == 0) & F.col("er").isNull() | (F.col("er") == F.col("of")) & F.col("sr").isNull()
    boundaries = scratch.cut(
        met.where(outer | (F.col("next_start") > F.col("last_end"))).select(
            F.coalesce("ee", "se").alias("e"), "last_end", "next_start", F.coalesce("last_end", "next_start").alias("at"), F.lit(1).alias("one")
        ),
        "boundaries",
    )
    numbered = running_total(boundaries, ["e"], "at", "one", _day("at", width), "no")
    none, no = F.lit(None).cast("bigint"), F.col("no")
    part = lambda kind, k, a, b: F.struct(F.lit(kind).alias("stretch_kind"), k.alias("k"), a.alias("a"), b.alias("b"))
    parts = F.array(
        F.when(F.col("next_start").isNotNull(), part("period", no, F.col("next_start"), none)),
        F.when(F.col("last_end").isNotNull(), part("period", no - 1, none, F.col("last_end"))),
        F.when(F.col("next_start") > F.col("last_end"), part("gap", no, F.col("last_end"), F.col("next_start"))),
    )
    each = numbered.select("e", F.inline(F.filter(parts, lambda x: x.isNotNull())))
    stretches = each.groupBy("e", "stretch_kind", "k").agg(F.max("a").alias("from_s"), F.max("b").alias("to_s"))
    return stretches.select(F.col("e").alias(entity), "stretch_kind", "from_s", "to_s")
