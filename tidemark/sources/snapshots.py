"""Snapshots of raw files as a table: filters, objects, the observations taken from them, and what a period was observed by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import GAP


def find(snapshots: DataFrame, kind: str | None = None, prefix: str | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Snapshots of a kind, below a locator prefix, acquired in ``[start, end)``; every filter may be left out.

    The prefix is compared by characters: ``%`` and ``_`` stand for themselves. A null locator has no prefix.
    """
    out = snapshots
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    if prefix is not None:
        out = out.where(F.col("locator").startswith(F.lit(prefix)))
    if start is not None:
        out = out.where(F.col("acquired_at") >= start)
    if end is not None:
        out = out.where(F.col("acquired_at") < end)
    return out


def history(snapshots: DataFrame, locator: str) -> DataFrame:
    """All snapshots of one locator with their ``version`` from 1, oldest first."""
    return snapshots.where(F.col("locator") == locator).withColumn("version", F.row_number().over(Window.orderBy("snapshot_id")))


def read_objects(snapshots: DataFrame, objects: DataFrame) -> DataFrame:
    """``snapshots`` plus ``content``, the bytes of their object; null where the object is lost, and ``intact`` says whether it is what its id names."""
    held = objects.select(F.col("object_id").alias("__o"), "content")
    joined = snapshots.join(held, F.col("object_id") == F.col("__o"), "left").drop("__o")
    return joined.withColumn("intact", F.coalesce(F.concat(F.lit("sha256:"), F.sha2("content", 256)) == F.col("object_id"), F.lit(False)))


def counts(snapshots: DataFrame) -> DataFrame:
    """``kind, snapshots, locators`` of every kind."""
    return snapshots.groupBy("kind").agg(F.count(F.lit(1)).alias("snapshots"), F.count_distinct("locator").alias("locators"))


def with_snapshot(observations: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Observations joined with the kind and locator of their snapshot; those whose snapshot is unknown are left out."""
    named = snapshots.select(F.col("snapshot_id").alias("__s"), F.col("kind").alias("snapshot_kind"), "locator")
    return observations.join(named, F.col("snapshot_id") == F.col("__s")).drop("__s")


def channel_range(observations: DataFrame, snapshots: DataFrame, kind: str) -> DataFrame:
    """``earliest, latest`` time text of the observations a kind of snapshot gave, gap markers left out; no row where there is none."""
    taken = with_snapshot(observations, snapshots.where(F.col("kind") == kind)).where(F.col("event_type") != GAP)
    return taken.agg(F.min("occurred_at").alias("earliest"), F.max("occurred_at").alias("latest")).where("earliest is not null")


def within_observed_range(ranges: DataFrame, start: int, end: int, instant) -> DataFrame:
    """One row, ``within``: whether any source's range ``(earliest, latest)`` meets ``[start, end)``; false without a range.

    ``instant`` is the function from a time text to epoch seconds; a text it cannot read meets nothing.
    """
    meets = (instant(F.col("earliest")) < end) & (instant(F.col("latest")) >= start)
    return ranges.agg(F.coalesce(F.bool_or(F.coalesce(meets, F.lit(False))), F.lit(False)).alias("within"))


def present(keys: DataFrame, ledger: DataFrame) -> DataFrame:
    """``dedupe_key, present, obs_id`` of the keys asked for: whether the ledger holds each, and under which id."""
    held = ledger.groupBy(F.col("dedupe_key").alias("__k")).agg(F.min("obs_id").alias("obs_id"))
    asked = keys.select("dedupe_key").distinct().join(held, F.col("dedupe_key") == F.col("__k"), "left")
    return asked.select("dedupe_key", F.col("__k").isNotNull().alias("present"), "obs_id")


def id_collisions(incoming: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """``obs_id, keys``: ids that stand for more than one dedupe key, within a batch or against the ledger.

    Every such id is an error of whoever minted it, and a batch with one must not be written.
    """
    both = incoming.select("obs_id", "dedupe_key")
    if ledger is not None:
        met = ledger.join(both.select("obs_id").distinct(), "obs_id", "left_semi")
        both = both.unionByName(met.select("obs_id", "dedupe_key"))
    return both.groupBy("obs_id").agg(F.count_distinct("dedupe_key").alias("keys")).where("keys > 1 and obs_id is not null")
