"""Gap drafts: the lines of a snapshot that should have given an observation and did not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import dedupe_key, plausible_label
from tidemark.functions.timecols import utc_text
from tidemark.schema import GAP

#: Outcomes of a line that are gaps.
REASONS = ("parse_error", "unmapped_kind", "missing_field")


def kind_detail(kind: Column) -> Column:
    """A record's kind as a gap's detail; null where it is no plausible name."""
    return plausible_label(kind)


def _given(rows: DataFrame, *names: str) -> Column:
    """The first of the columns the table has, as text; null if it has none."""
    return next((F.col(n).cast("string") for n in names if n in rows.columns), F.lit(None).cast("string"))


def _acquired(rows: DataFrame) -> Column:
    """When a row was acquired: ``acquired_at``, else the instant it was received, else null."""
    if "acquired_at" not in rows.columns and "received_at" in rows.columns:
        return F.concat(utc_text(F.unix_seconds(F.col("received_at").cast("timestamp"))), F.lit("Z"))
    return _given(rows, "acquired_at")


def gap_drafts(rows: DataFrame, vendor: str, reasons: tuple[str, ...] = REASONS, live: str = "occurred_at") -> DataFrame:
    """``row_id, event_type, subject, time, time_basis, reason, detail, dedupe_key`` of rows whose ``outcome`` is a gap.

    The subject names the line, and the key the snapshot and the line alone, so the same line gives the same gap
    on every run. Optional columns: ``line_no`` (else the row's number stands for the line), ``object_id`` (the
    snapshot's digest, else ``file_ref``), ``acquired_at`` (text, else the timestamp ``received_at``) and ``inherited``. The time is the
    record's own; one without a time, or one that cannot be read, is dated to its acquisition, which is null where
    the table has neither column. A time on an inherited line is the copy's. ``live`` is the basis of a record's own time.
    """
    line = F.concat(F.lit("line:"), _given(rows, "line_no", "row_id"))
    own = F.when(F.col("outcome") != "parse_error", F.col("ts_raw"))
    inherited = F.coalesce(F.col("inherited"), F.lit(False)) if "inherited" in rows.columns else F.lit(False)
    return rows.where(F.col("outcome").isin(*reasons)).select(
        "row_id", F.lit(GAP).alias("event_type"), F.concat(F.lit("source/gap/"), line).alias("subject"),
        F.coalesce(own, _acquired(rows)).alias("time"),
        F.when(own.isNull(), "acquired_at").when(inherited, "copied_at").otherwise(live).alias("time_basis"),
        F.col("outcome").alias("reason"), "detail",
        dedupe_key(F.lit(vendor), F.col("device_ref"), F.lit(GAP), _given(rows, "object_id", "file_ref"), line).alias("dedupe_key"),
    )
