"""Transcript records to observation drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import (
    CLAUDE_TOOLS, HOME, count_bucket, dedupe_key, pseudonym, resolve_cwd, tool_family, variant_integer, variant_string,
)
from tidemark.functions.timecols import duration_ms
from tidemark.schema import PROMPT, RESPONSE, SESSION_STARTED, TOOL_FINISHED, TOOL_STARTED
from tidemark.sources.gaps import gap_drafts, kind_detail

_DRAFTS = "array<struct<event_type:string,tool_id:string,family:string,outcome:string,tokens:string>>"
#: Record types with a case, and the fields a draft needs, by column, in the order they are reported.
MAPPED = ("user", "assistant", "attachment")
REQUIRED = {"session_id": "sessionId", "ts_raw": "timestamp", "rec_uuid": "uuid"}
_ITEMS = "array<struct<type:string,id:string,name:string,tool_use_id:string,is_error:boolean>>"


def content_items(content: Column) -> Column:
    """Content blocks of an array; null for text and for single objects."""
    return F.when(F.ltrim(content).startswith("["), F.from_json(content, _ITEMS))


def session_majority(rows: DataFrame, home: str = HOME) -> DataFrame:
    """``file_ref, session_id, vote_repository, vote_workspace``: the repository most of a session's directories name.

    The workspace is voted within the winning repository. Ties go to the smallest name; directories
    that resolve to nothing do not vote.
    """
    repository, workspace = resolve_cwd(F.col("cwd"), home)
    keys = ["file_ref", "session_id"]
    votes = (
        rows.select(*keys, repository.alias("r"), workspace.alias("w")).where("r is not null and session_id is not null")
        .groupBy(*keys, "r", "w").agg(F.count(F.lit(1)).alias("n"))
    )
    per_repository = votes.groupBy(*keys, "r").agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("n"), "w")).alias("w"))
    best = per_repository.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "r", "w")).alias("b"))
    return best.select(*keys, F.col("b.r").alias("vote_repository"), F.col("b.w.w").alias("vote_workspace"))


def tool_starts(rows: DataFrame) -> DataFrame:
    """``file_ref, tool_use_id, start_family, started_at`` of every tool use; the last of a file wins."""
    used = rows.where(F.col("rec_type") == "assistant").select(
        "file_ref", "row_id", F.col("ts_raw").alias("started_at"), F.posexplode(content_items(F.col("content_json"))).alias("pos", "item")
    )
    named = used.where((F.col("item.type") == "tool_use") & F.col("item.id").isNotNull())
    family = tool_family(F.col("item.name"), CLAUDE_TOOLS)
    return (
        named.groupBy("file_ref", F.col("item.id").alias("tool_use_id"))
        .agg(F.max(F.struct("row_id", "pos", family.alias("f"), "started_at")).alias("s"))
        .select("file_ref", "tool_use_id", F.col("s.f").alias("start_family"), F.col("s.started_at").alias("started_at"))
    )


def _optional(rows: DataFrame, name: str, kind: str = "string") -> Column:
    """A column the table may lack, null then."""
    return F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)


def _holds(json: Column) -> Column:
    """Whether a field's JSON text is there and not null."""
    return F.coalesce(F.trim(json) != "null", F.lit(False))


def _with_drafts(rows: DataFrame, home: str = HOME) -> DataFrame:
    """``rows`` plus their directory, first result and ``drafts``: null where a record gives none."""
    repository, workspace = resolve_cwd(F.col("cwd"), home)
    items = content_items(F.col("content_json"))
    results = F.filter(items, lambda x: x["type"] == "tool_result")
    uses = F.filter(items, lambda x: (x["type"] == "tool_use") & x["id"].isNotNull())
    base = rows.withColumns({"results": results, "uses": uses, "own_repository": repository, "own_workspace": workspace})
    base = base.withColumn("result_id", F.get("results", F.lit(0))["tool_use_id"])
    error = F.get(F.filter("results", lambda x: x["is_error"].isNotNull()), F.lit(0))["is_error"]
    tool_result = _optional(rows, "tool_result_json")
    has_result = F.coalesce(F.size("results") > 0, F.lit(False)) | _holds(tool_result)
    exit_code = variant_integer(F.try_parse_json(tool_result), "$.exit_code")
    api_error = F.coalesce(_optional(rows, "is_api_error", "boolean"), F.lit(False)) | _holds(_optional(rows, "error_json"))
    attachment = F.try_parse_json(_optional(rows, "attachment_json"))
    session_start = (variant_string(attachment, "$.type") == "hook_success") & (variant_string(attachment, "$.hookEvent") == "SessionStart")
    is_user, is_reply = F.col("rec_type") == "user", F.col("rec_type") == "assistant"
    plain = ~F.coalesce("is_sidechain", F.lit(False)) & ~F.coalesce("is_meta", F.lit(False))
    null = F.lit(None).cast("string")

    def draft(event: str, tool: Column, family: Column, outcome: Column, tokens: Column) -> Column:
        return F.struct(F.lit(event).alias("event_type"), tool.alias("tool_id"), family.alias("family"), outcome.alias("outcome"), tokens.alias("tokens"))

    judged = F.when(error, "failed").when(~error, "succeeded").when(exit_code == 0, "succeeded").when(exit_code.isNotNull(), "failed").otherwise("unknown")
    finished = draft(TOOL_FINISHED, F.col("result_id"), null, judged, null)
    prompt = draft(PROMPT, null, null, null, null)
    response = draft(RESPONSE, null, null, F.when(api_error, "failed").otherwise("succeeded"), count_bucket(F.col("output_tokens")))
    started = F.transform("uses", lambda x: draft(TOOL_STARTED, x["id"], tool_family(x["name"], CLAUDE_TOOLS), null, null))
    drafts = (
        F.when(is_user & has_result, F.array(finished)).when(is_user & plain, F.array(prompt))
        .when(is_reply, F.concat(F.array(response), F.coalesce(started, F.array().cast(_DRAFTS))))
        .when((F.col("rec_type") == "attachment") & session_start, F.array(draft(SESSION_STARTED, null, null, null, null)))
    )
    return base.withColumn("drafts", F.when(_missing().isNull(), drafts))


def _missing() -> Column:
    """The first required field a record lacks, else null."""
    return F.coalesce(*[F.when(F.col(c).isNull(), name) for c, name in REQUIRED.items()])


def transcript_drafts(rows: DataFrame, home: str = HOME) -> DataFrame:
    """One row per draft of every transcript record, in ``row_id, draft_no``.

    A user record holding a tool result is a finished tool, also on a sidechain; other sidechain and
    meta records, and records without session, time or identity, give none. An assistant record is a
    response and one started tool per tool use. Records of other types give none. Optional columns hold what
    else a raw record may say: ``is_api_error`` and ``error_json`` (isApiErrorMessage and error: a failed response),
    ``tool_result_json`` (toolUseResult: a finished tool even without a result block, judged by its exit_code where
    no block says is_error) and ``attachment_json`` (attachment: one of a SessionStart hook is a started session; the
    result then has ``session_kind``). What becomes of those
    records is said by ``transcript_outcomes`` and ``transcript_gaps``.
    """
    base = _with_drafts(rows, home)
    out = base.select("*", F.posexplode("drafts").alias("draft_no", "draft")).select("*", "draft.*")
    starts = tool_starts(rows).select(F.col("file_ref").alias("s_file"), F.col("tool_use_id").alias("s_tool"), "start_family", "started_at")
    out = out.join(starts, (F.col("file_ref") == F.col("s_file")) & (F.col("result_id") == F.col("s_tool")), "left")
    votes = session_majority(rows, home).select(F.col("file_ref").alias("v_file"), F.col("session_id").alias("v_session"), "vote_repository", "vote_workspace")
    out = out.join(votes, (F.col("file_ref") == F.col("v_file")) & (F.col("session_id") == F.col("v_session")), "left")
    # A directory that resolves to nothing must not borrow the session's repository; only its absence may.
    lent = lambda own, vote: F.when(F.col("cwd").isNotNull(), F.col(own)).otherwise(F.col(vote))
    session, tool = pseudonym("ses", F.col("session_id")), pseudonym("tol", F.col("tool_id"))
    scope = F.coalesce(tool, F.col("rec_uuid"))
    finished_row = F.col("event_type") == TOOL_FINISHED
    session_kind = [F.when(F.col("event_type") == SESSION_STARTED, "interactive").alias("session_kind")] if "attachment_json" in rows.columns else []
    return out.select(
        "row_id", "draft_no", "event_type",
        F.concat(F.lit("session/"), session, F.coalesce(F.concat(F.lit("/tool/"), tool), F.lit(""))).alias("subject"),
        F.col("ts_raw").alias("time"),
        pseudonym("rep", lent("own_repository", "vote_repository")).alias("repository_ref"),
        pseudonym("wsp", lent("own_workspace", "vote_workspace")).alias("workspace_ref"),
        F.when(finished_row, F.coalesce("start_family", F.lit("other"))).otherwise(F.col("family")).alias("tool_family"),
        "outcome",
        F.when(finished_row, duration_ms(F.col("started_at"), F.col("ts_raw"))).alias("duration_ms"),
        F.col("tokens").alias("response_tokens"),
        *session_kind,
        dedupe_key(F.lit("claude-code"), F.col("device_ref"), session, F.col("event_type"), scope).alias("dedupe_key"),
    )


def _outcome() -> tuple[Column, Column]:
    """(outcome, detail) of a record with its drafts."""
    kind, missing = F.coalesce("rec_type", F.lit("")), _missing()
    outcome = (
        F.when(F.col("drafts").isNotNull(), "drafts").when(~kind.isin(*MAPPED), "unmapped_kind")
        .when(missing.isNotNull(), "missing_field").otherwise("skipped")
    )
    return outcome, F.when(outcome == "unmapped_kind", kind_detail(kind)).when(outcome == "missing_field", missing)


def transcript_outcomes(rows: DataFrame) -> DataFrame:
    """``row_id, outcome, detail`` of every record: drafts, or the first of unmapped_kind, missing_field and skipped."""
    outcome, detail = _outcome()
    return _with_drafts(rows).select("row_id", outcome.alias("outcome"), detail.alias("detail"))


def transcript_gaps(rows: DataFrame) -> DataFrame:
    """The gap drafts of the records that give no draft although they should; of skipped ones none."""
    outcome, detail = _outcome()
    return gap_drafts(_with_drafts(rows).withColumns({"outcome": outcome, "detail": detail}), "claude-code")
