"""The ``events`` table and the ledger table seen as observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import COMMIT, FAMILIES, GAP, PROMPT, RESPONSE, TOOL_STARTED
from tidemark.tables import table

KINDS = {"click": PROMPT, "view": RESPONSE, "purchase": TOOL_STARTED, "signup": COMMIT, "error": GAP}


def events_as_observations(spark: SparkSession, d: str) -> DataFrame:
    """instant, session, repository, event_type, ingest_seq, tool_family, time_basis, origin, source_kind of every event.

    The instant is taken from the zone-free timestamp, independent of the session's zone.
    """
    k = F.get_json_object("props", "$.k").try_cast("int")
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    family = F.element_at(F.array(*[F.lit(x) for x in FAMILIES]), F.pmod(k, F.lit(7)) + 1)
    micros = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("ts"))
    return table(spark, d, "events").select(
        F.floor(micros / 1_000_000).cast("bigint").alias("instant"),
        (F.col("user_id") % 20).cast("string").alias("session"),
        F.when(F.col("user_id") % 8 != 7, F.concat(F.lit("repo/"), (F.col("user_id") % 8).cast("string"))).alias("repository"),
        kind[F.col("event_type")].alias("event_type"),
        F.col("event_id").alias("ingest_seq"),
        family.alias("tool_family"),
        F.when(k % 10 == 0, "copied_at").when(k % 10 == 1, "received_at").alias("time_basis"),
        F.when(k % 9 == 0, "subagent").alias("origin"),
        F.when(F.col("user_id") % 3 == 0, "codex").otherwise("claude-code").alias("source_kind"),
    )


#: The same in SQL, as the head of a query.
EVENTS_SQL = """WITH obs AS (
  SELECT epoch_us(ts) // 1000000 AS instant, CAST(user_id % 20 AS VARCHAR) AS session,
         CASE WHEN user_id % 8 <> 7 THEN 'repo/' || (user_id % 8) END AS repository,
         CASE event_type WHEN 'click' THEN 'prompt.submitted' WHEN 'view' THEN 'response.completed' WHEN 'purchase' THEN 'tool.started'
                         WHEN 'signup' THEN 'commit.observed' WHEN 'error' THEN 'source.gap' END AS event_type,
         event_id AS ingest_seq, (['shell','edit','read','search','web','mcp','other'])[k % 7 + 1] AS tool_family,
         CASE WHEN k % 10 = 0 THEN 'copied_at' WHEN k % 10 = 1 THEN 'received_at' END AS time_basis,
         CASE WHEN k % 9 = 0 THEN 'subagent' END AS origin, CASE WHEN user_id % 3 = 0 THEN 'codex' ELSE 'claude-code' END AS source_kind
  FROM (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k FROM events)),
routed AS (
  SELECT *, CASE WHEN event_type = 'source.gap' THEN 'gap'
                 WHEN time_basis IS NOT NULL AND time_basis NOT IN ('occurred_at','received_at') THEN 'inherited'
                 WHEN instant IS NULL THEN 'unusable' WHEN event_type = 'commit.observed' THEN 'commit'
                 WHEN event_type = 'prompt.submitted' AND coalesce(origin,'') NOT IN ('subagent','scheduled') THEN 'anchor'
                 ELSE 'agent' END AS route
  FROM obs)"""
