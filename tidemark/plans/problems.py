"""Queries of the general data problems (p2 to p7) and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.identifiers import canonical_uuid
from tidemark.functions.steps import step
from tidemark.operators.activity import activity_sessions
from tidemark.operators.blocks import block_table
from tidemark.operators.copies import duplicate_rows, kept_rows, transcript_key
from tidemark.operators.drift import field_counts, field_profiles, schema_changes, union_schema, unified_table
from tidemark.operators.instants import CANONICAL, normalise_instants
from tidemark.operators.periods import periods_and_gaps
from tidemark.plans import problem_sql
from tidemark.tables import table

DEVICE_OF_URI = r"^[a-z]+://device/([^/]+)"


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Instants of the time texts not already in canonical form."""
    src = {"transcripts": ("ts_raw", F.col("device_ref")), "rollouts": ("ts_raw", F.col("device_ref")),
           "observations": ("obs_time", F.regexp_extract("source_uri", DEVICE_OF_URI, 1))}
    rows = reduce(
        DataFrame.unionByName,
        [
            table(spark, d, name).select(F.lit(name).alias("src_table"), "row_id", F.col(text).alias("text"), device.alias("device"))
            for name, (text, device) in src.items()
        ],
    )
    written = rows.where(F.col("text").isNotNull() & ~F.col("text").rlike(CANONICAL))
    found = normalise_instants(written, table(spark, d, "devices"), "text", "device")
    return found.where(F.col("epoch_us").isNotNull()).select("src_table", "row_id", "epoch_us")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every content block of the kept transcript rows, with its link to a tool use."""
    rows = table(spark, d, "transcripts").select("row_id", "session_id", "rec_uuid", "content_json")
    kept = kept_rows(rows, transcript_key(), F.col("row_id"))
    return block_table(kept.withColumn("session_id", canonical_uuid("session_id")), "row_id", "session_id", "content_json")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every schema change between neighbouring versions of a vendor."""
    return schema_changes(field_profiles(table(spark, d, "meta_lines")))


def p4_table(spark: SparkSession, d: str) -> DataFrame:
    """All readable meta lines of both vendors in one consistent table."""
    lines = table(spark, d, "meta_lines")
    return unified_table(lines, union_schema(field_profiles(lines)))


def p4_fields(spark: SparkSession, d: str) -> DataFrame:
    """Every field of every version with its types and the number of records that hold it."""
    return field_counts(field_profiles(table(spark, d, "meta_lines")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of activity per source kind and session."""
    rows = table(spark, d, "observations").select(
        "row_id", "dedupe_key", "source_kind", "obs_time",
        F.regexp_extract("subject", r"^session/([^/]+)", 1).alias("session_ref"),
        F.regexp_extract("source_uri", DEVICE_OF_URI, 1).alias("device"),
    )
    kept = kept_rows(rows, [F.col("dedupe_key")], F.col("row_id"))
    # A step of its own, which a filter does not pass: singletons and repeated groups then need the same columns and
    # rows, and share one shuffle of them.
    named = step(kept, session=F.col("session_ref"), one=F.when(F.col("row_id").isNotNull(), 1)).where("session <> ''")
    timed = normalise_instants(named, table(spark, d, "devices"), "obs_time", "device")
    return activity_sessions(timed, ["source_kind", "session_ref"], "epoch_us", count="one")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Continuous periods and gaps of each repository."""
    return periods_and_gaps(table(spark, d, "block_parts"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The rows of transcripts and observations that are further copies of a record."""
    t = duplicate_rows(table(spark, d, "transcripts").select("row_id", "session_id", "rec_uuid"), transcript_key(), F.col("row_id"))
    o = duplicate_rows(table(spark, d, "observations").select("row_id", "dedupe_key"), [F.col("dedupe_key")], F.col("row_id"))
    named = lambda df, name: df.select(F.lit(name).alias("src_table"), "row_id")
    return named(t, "transcripts").unionByName(named(o, "observations"))


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p4_found, p4_table, p4_fields, p5_found, p6_found, p7_found)}

SQL = {
    "p2_found": problem_sql.P2,
    "p3_found": problem_sql.P3,
    "p4_found": problem_sql.P4_FOUND,
    "p4_table": problem_sql.P4_TABLE,
    "p4_fields": problem_sql.P4_FIELDS,
    "p5_found": problem_sql.P5,
    "p6_found": """
        WITH v AS (SELECT repository, span_start AS s, span_end AS e FROM block_parts
                   WHERE repository IS NOT NULL AND span_end > span_start),
        m AS (SELECT *, max(e) OVER (PARTITION BY repository ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM v),
        i AS (SELECT *, sum(CASE WHEN prev IS NULL OR s > prev THEN 1 ELSE 0 END)
                     OVER (PARTITION BY repository ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m),
        p AS (SELECT repository, k, min(s) AS a, max(e) AS b FROM i GROUP BY repository, k)
        SELECT repository, 'period' AS stretch_kind, a AS from_s, b AS to_s FROM p
        UNION ALL
        SELECT repository, 'gap', b, nxt FROM (SELECT *, lead(a) OVER (PARTITION BY repository ORDER BY a) AS nxt FROM p)
        WHERE nxt IS NOT NULL""",
    "p7_found": f"""
        WITH t AS (SELECT row_id, {problem_sql.uuid_text('session_id')} AS s, {problem_sql.uuid_text('rec_uuid')} AS u FROM transcripts),
        t2 AS (SELECT *, row_number() OVER (PARTITION BY s, u ORDER BY row_id) AS n FROM t WHERE s IS NOT NULL AND u IS NOT NULL),
        o AS (SELECT row_id, row_number() OVER (PARTITION BY dedupe_key ORDER BY row_id) AS n FROM observations WHERE dedupe_key IS NOT NULL)
        SELECT 'transcripts' AS src_table, row_id FROM t2 WHERE n > 1
        UNION ALL SELECT 'observations', row_id FROM o WHERE n > 1""",
}
