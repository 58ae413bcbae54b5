"""Rollout lines to observation drafts, with the facts that need a whole file or all files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import (
    CODEX_TOOLS, HOME, dedupe_key, pseudonym, record_kind, resolve_cwd, tool_family, variant_integer, variant_present, variant_string,
)
from tidemark.functions.steps import step
from tidemark.functions.timecols import duration_ms, epoch_millis
from tidemark.scratch import Scratch
from tidemark.schema import PROMPT, RESPONSE, TOOL_FINISHED, TOOL_STARTED
from tidemark.sources.gaps import gap_drafts

CALLS = ("response_item:function_call", "response_item:custom_tool_call")
OUTPUTS = ("response_item:function_call_output", "response_item:custom_tool_call_output")
MCP_END, USER, AGENT = "event_msg:mcp_tool_call_end", "event_msg:user_message", "event_msg:agent_message"
META, STARTED, COMPLETE, SUBAGENT = "session_meta", "event_msg:task_started", "event_msg:task_complete", "event_msg:sub_agent_activity"
MAPPED = (USER, AGENT, META, *CALLS, *OUTPUTS, MCP_END, COMPLETE)
#: Fixed value: a copied history is written within this many milliseconds of its first line.
FLUSH_MS = 1_000


#: Payload fields read as strings, as whole numbers, and only for their presence.
STRINGS = ("session_id", "id", "call_id", "name", "turn_id", "cwd", "source", "status", "agent_thread_id", "invocation.server", "invocation.tool")
INTEGERS = ("duration.secs", "duration.nanos", "duration_ms", "subagent_history_start_ordinal")
PRESENT = ("history_base", "forked_from_id", "parent_thread_id", "started_at")


def _name(field: str) -> str:
    return "p_" + field.replace(".", "_")


def with_fields(rows: DataFrame) -> DataFrame:
    """``rows`` with their kind, place in the file, time and payload fields, each payload parsed once.

    A field of another type counts as absent, so a number where a string belongs is no string.
    """
    v = F.col("v")
    success = F.try_variant_get(v, "$.success", "variant")
    parsed = step(step(rows, ms=epoch_millis(F.col("ts_raw"))), v=F.try_parse_json("payload_json"), kind=record_kind(F.col("rec_type"), F.col("payload_type")), at=F.struct("line_no", "row_id"))
    fields = {_name(f): variant_string(v, f"$.{f}") for f in STRINGS}
    fields |= {_name(f): variant_integer(v, f"$.{f}") for f in INTEGERS}
    fields |= {_name(f): variant_present(v, f"$.{f}") for f in PRESENT}
    fields |= {"p_error": F.try_variant_get(v, "$.error", "variant").isNotNull()}
    fields |= {"p_success": F.when(F.schema_of_variant(success) == "BOOLEAN", F.try_variant_get(v, "$.success", "boolean"))}
    fields |= {"payload_text": F.to_json("v"), "message_text": F.to_json(F.try_variant_get(v, "$.message", "variant"))}
    names = list(fields)
    for i in range(0, len(names), 5):  # a step of all fields would outgrow one generated method
        parsed = step(parsed, **{n: fields[n] for n in names[i : i + 5]})
    return parsed.drop("v")


def file_facts(rows: DataFrame, home: str = HOME) -> DataFrame:
    """Per file: session (of the first meta), thread (first id seen), repository and workspace (last directory that resolves)."""
    repository, workspace = resolve_cwd(F.col("p_cwd"), home)
    is_meta = F.col("kind") == META
    session = F.coalesce("p_session_id", "p_id")
    facts = rows.withColumns({"m": is_meta, "s": session, "i": F.col("p_id"), "r": repository, "w": workspace})
    first = lambda keep, value: F.min(F.when(keep, F.struct("at", value)))
    grouped = facts.groupBy("file_ref").agg(
        first(F.col("m"), F.col("s").alias("v")).alias("session"),
        first(F.col("m") & F.col("i").isNotNull(), F.col("i").alias("v")).alias("thread"),
        F.max(F.when(F.col("r").isNotNull(), F.struct("at", "r", "w"))).alias("place"),
    )
    return grouped.select(
        F.col("file_ref").alias("f_file"), F.col("session.v").alias("file_session"), F.col("thread.v").alias("file_thread"),
        F.col("place.r").alias("file_repository"), F.col("place.w").alias("file_workspace"),
    )


def call_key() -> Column:
    """A call's key: its id, else its call_id."""
    return F.coalesce("p_id", "p_call_id")


def call_starts(rows: DataFrame) -> DataFrame:
    """``file_ref, key, tool, start_family, started_at``; both spellings of a call lead to its call_id, the last line wins."""
    a, b = F.col("p_id"), F.col("p_call_id")
    calls = rows.where(F.col("kind").isin(*CALLS)).select(
        "file_ref", "at", F.col("ts_raw").alias("started_at"), F.coalesce(b, a).alias("tool"),
        tool_family(F.col("p_name"), CODEX_TOOLS).alias("f"), F.explode(F.array_distinct(F.array(a, b))).alias("key"),
    )
    last = calls.where(F.col("key").isNotNull()).groupBy("file_ref", "key").agg(F.max(F.struct("at", "tool", "f", "started_at")).alias("s"))
    return last.select(
        F.col("file_ref").alias("c_file"), F.col("key").alias("c_key"), F.col("s.tool").alias("tool"),
        F.col("s.f").alias("start_family"), F.col("s.started_at").alias("started_at"),
    )


def subagent_threads(rows: DataFrame) -> DataFrame:
    """Threads any file names as a subagent's."""
    named = rows.where(F.col("payload_type") == "sub_agent_activity")
    return named.select(F.col("p_agent_thread_id").alias("a_thread")).where("a_thread is not null").distinct()


def inherited_lines(rows: DataFrame) -> DataFrame:
    """``row_id, inherited``: whether a line was copied from another thread's history.

    A first meta with a history base: none. With a start ordinal: lines of a lower ordinal. Without any
    named parent: none. Else, if the opening run (lines within FLUSH_MS of the first, ended by the first line
    that is not, or has no time) holds another thread's meta: the run without the file's own meta. All
    of it is minima per file, so no file is walked in one task.
    """
    ordinal = F.col("ordinal") if "ordinal" in rows.columns else F.lit(None)
    r = rows.withColumns({"m": F.col("kind") == META, "i": F.col("p_id"), "ord": ordinal.cast("bigint")})
    r = r.withColumns({
        "base": F.col("p_history_base"), "start": F.col("p_subagent_history_start_ordinal"),
        "parent": F.col("p_forked_from_id") | F.col("p_parent_thread_id"),
    })
    file = r.groupBy("file_ref").agg(
        F.min(F.struct("at", "ms")).alias("opening"),
        F.min(F.when(F.col("m"), F.struct("at", "i", "base", "start"))).alias("meta"),
        F.max(F.col("m") & F.col("parent")).alias("has_parent"),
    )
    near = r.join(file.withColumnRenamed("file_ref", "g_file"), F.col("file_ref") == F.col("g_file"))
    stays = F.coalesce(F.abs(F.col("ms") - F.col("opening.ms")) <= FLUSH_MS, F.lit(False))
    ends = near.groupBy("file_ref").agg(
        F.min(F.when(~stays, F.col("at"))).alias("stop"),
        F.min(F.when(F.col("m") & ~F.col("i").eqNullSafe(F.col("meta.i")), F.col("at"))).alias("foreign"),
    )
    full = near.join(ends.withColumnRenamed("file_ref", "e_file"), F.col("file_ref") == F.col("e_file"))
    in_run = F.col("stop").isNull() | (F.col("at") < F.col("stop"))
    foreign_in_run = F.col("foreign").isNotNull() & (F.col("stop").isNull() | (F.col("foreign") < F.col("stop")))
    flush = F.col("has_parent") & F.col("meta.i").isNotNull() & F.col("opening.ms").isNotNull() & foreign_in_run & in_run & (F.col("at") != F.col("meta.at"))
    copied = (
        F.when(F.col("meta").isNull() | F.col("meta.base"), False)
        .when(F.col("meta.start").isNotNull(), F.coalesce(F.col("ord") < F.col("meta.start"), F.lit(False)))
        .otherwise(flush)
    )
    return full.select("row_id", F.coalesce(copied, F.lit(False)).alias("inherited"))


def content_identity(prefix: str, time: Column, canonical: Column) -> Column:
    """Pseudonym of a time and a JSON text in canonical form (keys sorted, no blanks)."""
    return pseudonym(prefix, F.concat_ws("|", time, F.coalesce(canonical, F.lit("null"))))


def _parsed(rows: DataFrame) -> DataFrame:
    """Rows with their fields, written once: seven passes over a file's lines need them."""
    return rows if "payload_text" in rows.columns else Scratch(rows.sparkSession).cut(with_fields(rows), "rollouts")


def rollout_drafts(rows: DataFrame, home: str = HOME) -> DataFrame:
    """At most one draft per rollout line.

    Lines without a time, of unmapped kinds, messages and metas of no session, and completed tasks whose
    start the file lacks give none. Copied lines carry the time basis copied_at.
    """
    rows = _parsed(rows)
    base = rows.where(F.col("ts_raw").isNotNull() & F.col("kind").isin(*MAPPED))
    base = base.join(file_facts(rows, home), F.col("file_ref") == F.col("f_file"), "left")
    base = base.withColumns({"c": F.when(F.col("kind").isin(*CALLS, *OUTPUTS), call_key()).when(F.col("kind") == MCP_END, F.col("p_call_id")),
                             "turn": F.when(F.col("kind") == COMPLETE, F.col("p_turn_id"))})
    base = base.join(call_starts(rows), (F.col("file_ref") == F.col("c_file")) & (F.col("c") == F.col("c_key")), "left")
    begun = rows.where((F.col("kind") == STARTED) & F.col("p_started_at"))
    begun = begun.select(F.col("file_ref").alias("t_file"), F.col("p_turn_id").alias("t_turn"), F.lit(True).alias("begun")).distinct()
    base = base.join(begun, (F.col("file_ref") == F.col("t_file")) & (F.col("turn") == F.col("t_turn")), "left")
    base = base.join(subagent_threads(rows).withColumn("sub", F.lit(True)), F.col("file_thread") == F.col("a_thread"), "left")
    base = base.join(inherited_lines(rows).withColumnRenamed("row_id", "h_row"), F.col("row_id") == F.col("h_row"), "left")

    kind = F.col("kind")
    is_call, is_output, is_mcp, is_turn = kind.isin(*CALLS), kind.isin(*OUTPUTS), kind == MCP_END, kind == COMPLETE
    session = pseudonym("ses", F.coalesce(F.col("p_session_id"), F.col("file_session")))
    event = (
        F.when(kind == USER, PROMPT).when(kind == AGENT, RESPONSE).when(kind == META, "session.started")
        .when(is_call, TOOL_STARTED).when(is_output | is_mcp, TOOL_FINISHED).when(is_turn, "turn.completed")
    )
    tool = F.coalesce(
        pseudonym("tol", F.col("tool")),
        F.when(is_call, content_identity("tcal", F.col("ts_raw"), F.col("payload_text"))).when(is_output, content_identity("tout", F.col("ts_raw"), F.col("payload_text"))),
        content_identity("mcpc", F.col("ts_raw"), F.to_json(F.struct(
            F.col("p_call_id").alias("call_id"), F.col("p_invocation_server").alias("server"),
            F.col("p_invocation_tool").alias("tool")), {"ignoreNullFields": "false"})),
    )
    turn = pseudonym("trn", F.col("turn"))
    on_tool = is_call | is_output | is_mcp
    tail = F.when(on_tool, F.concat(F.lit("tool/"), tool)).when(is_turn, F.concat(F.lit("turn/"), turn))
    success = F.col("p_success")
    status = F.col("p_status")
    judged = (
        F.when(success, "succeeded").when(~success, "failed").when(status == "completed", "succeeded")
        .when(status.isin("failed", "error", "incomplete"), "failed").otherwise("unknown")
    )
    has_error = F.col("p_error")
    outcome = (
        F.when(kind == AGENT, "unknown").when(is_output | is_mcp, judged).when(is_turn, F.when(has_error, "failed").otherwise("succeeded"))
    )
    secs, nanos = F.col("p_duration_secs"), F.col("p_duration_nanos")
    took = (
        F.when(is_output, duration_ms(F.col("started_at"), F.col("ts_raw"))).when(is_mcp, secs * 1_000 + F.floor(nanos / 1_000_000))
        .when(is_turn, F.col("p_duration_ms"))
    )
    family = (
        F.when(is_call, tool_family(F.col("p_name"), CODEX_TOOLS)).when(is_mcp, "mcp")
        .when(is_output, F.coalesce("start_family", F.lit("other")))
    )
    source = F.col("p_source")
    session_kind = F.when(kind == META, F.when(source == "interactive", source).when(source.isin("exec", "headless"), "headless").otherwise("unknown"))
    scope = (
        F.when(kind == USER, content_identity("umsg", F.col("ts_raw"), F.col("message_text"))).when(kind == AGENT, content_identity("amsg", F.col("ts_raw"), F.col("message_text")))
        .when(on_tool, tool).when(is_turn, turn)
    )
    admitted = F.when(is_turn, F.coalesce("begun", F.lit(False))).when(on_tool, True).otherwise(session.isNotNull())
    return base.where(admitted).select(
        "row_id", event.alias("event_type"),
        F.concat_ws("/", F.concat(F.lit("session/"), session), tail).alias("subject"),
        F.col("ts_raw").alias("time"),
        pseudonym("rep", F.col("file_repository")).alias("repository_ref"), pseudonym("wsp", F.col("file_workspace")).alias("workspace_ref"),
        family.alias("tool_family"), outcome.alias("outcome"), took.cast("bigint").alias("duration_ms"), session_kind.alias("session_kind"),
        F.when(kind == USER, F.when(F.col("sub"), "subagent").otherwise("human")).alias("origin"),
        F.when(F.col("inherited"), "copied_at").alias("time_basis"),
        dedupe_key(F.lit("codex"), F.col("device_ref"), F.when(~is_turn, session), event, scope).alias("dedupe_key"),
    )


def line_outcomes(lines: DataFrame) -> DataFrame:
    """``row_id, outcome, detail``: drafts, or the first of unmapped_kind, missing_field, skipped, or parse_error before all."""
    rows = _parsed(lines)
    drafted = rollout_drafts(rows).select(F.col("row_id").alias("d_row")).distinct()
    facts = file_facts(rows)
    r = rows.join(drafted, F.col("row_id") == F.col("d_row"), "left").join(facts, F.col("file_ref") == F.col("f_file"), "left")
    session = F.coalesce(F.col("p_session_id"), F.col("file_session"))
    missing = F.when(F.col("ts_raw").isNull(), "timestamp").when(F.col("payload_json").isNull(), "payload").when(session.isNull(), "session_id")
    outcome = (
        F.when(F.col("payload_json").isNotNull() & F.col("payload_text").isNull(), "parse_error").when(F.col("d_row").isNotNull(), "drafts")
        .when(~F.col("kind").isin(*MAPPED), "unmapped_kind").when(missing.isNotNull(), "missing_field").otherwise("skipped")
    )
    label = F.when(F.col("kind").rlike("^[A-Za-z0-9_:-]{1,64}$"), F.col("kind"))
    detail = F.when(outcome == "unmapped_kind", label).when(outcome == "missing_field", missing)
    return r.select("row_id", outcome.alias("outcome"), detail.alias("detail"))


def rollout_gaps(lines: DataFrame) -> DataFrame:
    """The gap drafts of the lines ``line_outcomes`` calls a parse error, an unmapped kind or short of a field."""
    rows = _parsed(lines)
    outcomes = line_outcomes(rows).withColumnRenamed("row_id", "o_row")
    copied = inherited_lines(rows).withColumnRenamed("row_id", "h_row")
    full = rows.join(outcomes, F.col("row_id") == F.col("o_row")).join(copied, F.col("row_id") == F.col("h_row"), "left")
    return gap_drafts(full, "codex")


def classified_drafts(lines: DataFrame, home: str = HOME) -> DataFrame:
    """The drafts and gap drafts of all lines: each line gives one or the other, or is skipped.

    A line whose payload cannot be read is a gap only. Columns that a kind of draft lacks are null.
    """
    rows = _parsed(lines)
    torn = rows.where(F.col("payload_json").isNotNull() & F.col("payload_text").isNull()).select(F.col("row_id").alias("t_row"))
    drafts = rollout_drafts(rows, home).join(torn, F.col("row_id") == F.col("t_row"), "left_anti")
    return drafts.unionByName(rollout_gaps(rows), allowMissingColumns=True)
