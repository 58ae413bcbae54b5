"""Structured Streaming over the hook spool. Its results are provisional: a watermark drops late lines, a batch never does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timecols import epoch_seconds
from tidemark.sources.live import hook_drafts, hook_records


def spool(spark: SparkSession, folder: str) -> DataFrame:
    """New lines of the spool folder as a stream of text."""
    return spark.readStream.option("maxFilesPerTrigger", 1000).text(folder)


def live_drafts(lines: DataFrame, device: str, watermark: str = "1 hour") -> DataFrame:
    """Drafts of a stream of hook lines, each dedupe key once within the watermark."""
    drafts = hook_drafts(hook_records(lines), device)
    timed = drafts.withColumn("at", F.timestamp_seconds(epoch_seconds(F.col("time"))))
    return timed.withWatermark("at", watermark).dropDuplicatesWithinWatermark(["dedupe_key"])


def live_sessions(drafts: DataFrame, gap: str = "300 seconds", keys: tuple[str, ...] = ("repository_ref",)) -> DataFrame:
    """Activity sessions of a stream of drafts; the end is the last event and not the end of the gap."""
    grouped = drafts.groupBy(*keys, F.session_window("at", gap).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last")).select(*keys, F.col("w.start").alias("start"), F.col("last").alias("end"), "n")
