"""Live hook lines and commit records to observation drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import (
    CLAUDE_TOOLS, HOME, count_bucket, dedupe_key, end_reason, plausible_label, pseudonym, resolve_cwd, tool_family, variant_integer, variant_string,
)
from tidemark.functions.steps import step
from tidemark.functions.timecols import epoch_seconds
from tidemark.schema import COMMIT, PROMPT, RESPONSE, TOOL_FINISHED, TOOL_STARTED
from tidemark.sources.gaps import REASONS, gap_drafts

#: The fields a hook line may carry.
HOOK_FIELDS = {
    "v": "bigint", "received_at": "string", "hook_event_name": "string", "session_id": "string", "prompt_id": "string", "tool_use_id": "string",
    "tool_name": "string", "cwd": "string", "agent_id": "string", "agent_type": "string", "reason": "string", "duration_ms": "bigint", "receiver_error": "string",
}
HOOK_SCHEMA = ", ".join(f"{k} {t}" for k, t in HOOK_FIELDS.items())
LOSSES = ("payload_unreadable", "payload_not_an_object", "payload_oversize")


def hook_records(lines: DataFrame, line: str = "value") -> DataFrame:
    """The allowed fields of raw hook lines; an unreadable line has all fields null."""
    return lines.withColumn("h", F.from_json(line, HOOK_SCHEMA)).select("*", "h.*").drop("h")


def hook_drafts(records: DataFrame, device: str, home: str = HOME) -> DataFrame:
    """At most one draft per hook record, all with the time basis received_at.

    Prompts and stops need a prompt id, tools a tool use id; records without session or time, and of other
    names, give none.
    """
    name = F.col("hook_event_name")
    started, done = name == "PreToolUse", name.isin("PostToolUse", "PostToolUseFailure")
    prompt, stop = name == "UserPromptSubmit", name.isin("Stop", "StopFailure")
    event = (
        F.when(name == "SessionStart", "session.started").when(name == "SessionEnd", "session.ended").when(prompt & F.col("prompt_id").isNotNull(), PROMPT)
        .when(stop & F.col("prompt_id").isNotNull(), RESPONSE).when(started & F.col("tool_use_id").isNotNull(), TOOL_STARTED)
        .when(done & F.col("tool_use_id").isNotNull(), TOOL_FINISHED)
    )
    session, turn, tool = pseudonym("ses", F.col("session_id")), pseudonym("trn", F.col("prompt_id")), pseudonym("tol", F.col("tool_use_id"))
    on_tool, on_turn = started | done, prompt | stop
    tail = F.when(on_tool | on_turn, F.concat(F.lit("turn/"), turn)), F.when(on_tool, F.concat(F.lit("tool/"), tool))
    repository, workspace = resolve_cwd(F.col("cwd"), home)
    failed = name.isin("StopFailure", "PostToolUseFailure")
    return records.where(F.col("session_id").isNotNull() & F.col("received_at").isNotNull() & event.isNotNull()).select(
        event.alias("event_type"), F.concat_ws("/", F.concat(F.lit("session/"), session), *tail).alias("subject"), F.col("received_at").alias("time"),
        pseudonym("rep", repository).alias("repository_ref"), pseudonym("wsp", workspace).alias("workspace_ref"),
        F.when(on_tool, tool_family(F.col("tool_name"), CLAUDE_TOOLS)).alias("tool_family"),
        F.when(stop | done, F.when(failed, "failed").otherwise("succeeded")).alias("outcome"),
        F.when(done, F.col("duration_ms")).alias("duration_ms"),
        F.when(name == "SessionStart", "unknown").alias("session_kind"), F.when(name == "SessionEnd", end_reason(F.col("reason"))).alias("reason"),
        F.when(on_tool, pseudonym("agt", F.col("agent_id"))).alias("agent_ref"), F.when(on_tool, plausible_label(F.col("agent_type"))).alias("agent_type"),
        F.lit("received_at").alias("time_basis"),
        dedupe_key(F.lit("claude-code"), F.lit(device), session, event, F.when(on_tool, tool).when(on_turn, turn), F.col("received_at")).alias("dedupe_key"),
    )


def spool_facts(lines: DataFrame, start_line: int = 0, line_no: str = "line_no", line: str = "line") -> DataFrame:
    """One row: ``drained``, the lines behind the cursor, and ``begins_at``, the receipt of the very first line, before which nothing was captured.

    ``begins_at`` is null of an empty spool or an unreadable first line.
    """
    at = F.get_json_object(line, "$.received_at")
    return lines.agg(F.count_if(F.col(line_no) > start_line).alias("drained"), F.min_by(at, line_no).alias("begins_at"))


#: Hook events with a case, and the reference each of them needs.
HOOKS = {"SessionStart": None, "SessionEnd": None, "UserPromptSubmit": "prompt_id", "Stop": "prompt_id", "StopFailure": "prompt_id",
         "PreToolUse": "tool_use_id", "PostToolUse": "tool_use_id", "PostToolUseFailure": "tool_use_id"}


def hook_outcomes(records: DataFrame, line: str = "value") -> DataFrame:
    """``records`` plus ``outcome, detail``: drafts, or the first of parse_error, the receiver's own loss, unmapped_kind, missing_field, skipped.

    A loss the receiver names otherwise is receiver_error_unrecognized. ``line`` is the raw text the record was read from.
    """
    name = F.coalesce("hook_event_name", F.lit(""))
    needs = F.create_map(*[F.lit(x) for k, v in HOOKS.items() if v for x in (k, v)])[name]
    missing = (
        F.when(F.col("session_id").isNull(), "session_id").when(F.col("received_at").isNull(), "received_at")
        .when((needs == "prompt_id") & F.col("prompt_id").isNull(), "prompt_id").when((needs == "tool_use_id") & F.col("tool_use_id").isNull(), "tool_use_id")
    )
    lost = F.col("receiver_error")
    mapped = name.isin(*HOOKS)
    outcome = (
        F.when(F.try_parse_json(F.col(line)).isNull(), "parse_error").when(mapped & missing.isNull(), "drafts")
        .when(lost.isin(*LOSSES), lost).when(lost.isNotNull(), "receiver_error_unrecognized").when(~mapped, "unmapped_kind")
        .when(missing.isNotNull(), "missing_field").otherwise("skipped")
    )
    tagged = records.withColumn("outcome", outcome)
    return tagged.withColumn("detail", F.when(F.col("outcome") == "unmapped_kind", plausible_label(name)).when(F.col("outcome") == "missing_field", missing))


def hook_gaps(records: DataFrame) -> DataFrame:
    """``reason``: what a line without a draft declares it lost, unknown reasons as receiver_error_unrecognized."""
    lost = F.col("receiver_error").isNotNull()
    return records.where(lost).select(F.when(F.col("receiver_error").isin(*LOSSES), F.col("receiver_error")).otherwise("receiver_error_unrecognized").alias("reason"))


def hook_gap_drafts(classified: DataFrame, device: str) -> DataFrame:
    """The gap drafts of hook lines from :func:`hook_outcomes`, dated by the receiver; the table needs ``row_id``, and may have what
    :func:`tidemark.sources.gaps.gap_drafts` reads."""
    rows = classified.withColumns({"ts_raw": F.col("received_at"), "device_ref": F.lit(device)}).drop("received_at")
    return gap_drafts(rows, "claude-code", reasons=(*REASONS, *LOSSES, "receiver_error_unrecognized"), live="received_at")


#: The fields of a payload a receiver may keep, and the longest line it may append.
KEPT_STRINGS = ("session_id", "prompt_id", "tool_use_id", "tool_name", "cwd", "agent_id", "agent_type", "reason", "hook_event_name")
KEPT_INTEGERS = ("duration_ms",)
LONGEST_LINE = 4_096


def receive(payloads: DataFrame, payload: str = "value", at: str = "received_at") -> DataFrame:
    """``line``: what a receiver appends for each payload: version, time, and the allowed fields of the right type, or its own error.

    A null or a text that is no UTF-8 is unreadable, anything that is no JSON object is no object. A line above LONGEST_LINE bytes,
    its newline included, becomes one that names the loss and keeps a short event name. No payload fails.
    """
    text = F.col("__p")
    if dict(payloads.dtypes)[payload] == "binary":
        text = F.when(F.is_valid_utf8(text.cast("string")), text.cast("string"))
    rows = payloads.select(F.col(payload).alias("__p"), F.col(at).cast("string").alias("__at"))
    rows = step(rows, __t=text, __v=F.try_parse_json(text))
    strings = [variant_string(F.col("__v"), f"$.{n}").alias(n) for n in KEPT_STRINGS]
    integers = [variant_integer(F.col("__v"), f"$.{n}").alias(n) for n in KEPT_INTEGERS]
    head = [F.lit(1).alias("v"), F.col("__at").alias("received_at")]
    rows = step(rows, __kept=F.to_json(F.struct(*head, *strings, *integers)), __name=variant_string(F.col("__v"), "$.hook_event_name"))
    failed = lambda why, *kept: F.to_json(F.struct(*head, *kept, F.lit(why).alias("receiver_error")))
    is_object = F.coalesce(F.schema_of_variant(F.col("__v")).startswith("OBJECT"), F.lit(False))
    short = F.when(F.octet_length("__name") <= 64, F.col("__name")).alias("hook_event_name")
    return rows.select(
        F.when(F.col("__t").isNull(), failed("payload_unreadable")).when(~is_object, failed("payload_not_an_object"))
        .when(F.octet_length("__kept") + 1 > LONGEST_LINE, failed("payload_oversize", short)).otherwise(F.col("__kept")).alias("line")
    )


def parse_log(lines: DataFrame, repository: str = "repository", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """``repository, commit, author_time, files_changed, insertions, deletions`` of log output with short statistics.

    A header is ``sha<TAB>author time``; the statistics line that follows belongs to it. A commit without one
    changed nothing; one with an unreadable or a second statistics line has no counts.
    """
    head = r"^([0-9a-f]{40})\t(\S+)$"
    stat = r"^ (\d+) files? changed(?:, (\d+) insertions?\(\+\))?(?:, (\d+) deletions?\(-\))?$"
    text = F.col(line)
    order = Window.partitionBy(repository).orderBy(line_no)
    tagged = lines.where(F.trim(text) != "").withColumn("__h", text.rlike(head)).withColumn("__no", F.sum(F.col("__h").cast("int")).over(order))
    num = lambda i: F.regexp_extract(text, stat, i).try_cast("bigint")
    parts = tagged.where(F.col("__no") > 0).groupBy(repository, "__no").agg(
        F.max(F.when(F.col("__h"), F.regexp_extract(text, head, 1))).alias("commit"), F.max(F.when(F.col("__h"), F.regexp_extract(text, head, 2))).alias("author_time"),
        F.count_if(~F.col("__h")).alias("stats"), F.count_if(text.rlike(stat)).alias("good"),
        F.max(num(1)).alias("f"), F.max(num(2)).alias("i"), F.max(num(3)).alias("d"),
    )
    clear = (F.col("stats") == 0) | ((F.col("stats") == 1) & (F.col("good") == 1))
    count = lambda c: F.when(clear, F.coalesce(c, F.lit(0)))
    return parts.select(repository, "commit", "author_time", count("f").alias("files_changed"), count("i").alias("insertions"), count("d").alias("deletions"))


#: How far back and how many commits of a repository are taken.
SINCE_DAYS, MOST_COMMITS = 90, 2_000


def newest_commits(commits: DataFrame, most: int = MOST_COMMITS) -> DataFrame:
    """The newest commits of each repository and whether more were left out.

    Each of 64 parts of a repository keeps its own newest first, so the order over a repository never sees more than those.
    """
    order = [F.desc("author_time"), F.asc("commit")]
    parts = commits.withColumn("__part", F.pmod(F.xxhash64("commit", "author_time"), F.lit(64)))
    few = parts.withColumn("__r", F.row_number().over(Window.partitionBy("repository", "__part").orderBy(*order))).where(F.col("__r") <= most + 1)
    ranked = few.drop("__part").withColumn("__r", F.row_number().over(Window.partitionBy("repository").orderBy(*order)))
    return ranked.withColumn("truncated", F.max("__r").over(Window.partitionBy("repository")) > most).where(F.col("__r") <= most).drop("__r")


def within_limits(commits: DataFrame, until: Column, emails: DataFrame, days: int = SINCE_DAYS, most: int = MOST_COMMITS) -> DataFrame:
    """Commits a scan may take, of ``commits(repository, commit, author_time, author_email, n_parents, ref)``.

    No merges, only of the addresses ``emails(repository, email)`` of the person, only reached from branches, tags and
    remotes, not older than ``days`` before ``until`` (an epoch second), the newest ``most`` of a repository, each commit once.
    """
    own = emails.select(F.col("repository").alias("__r"), F.lower("email").alias("__e")).distinct()
    reached = F.col("ref").rlike(r"^refs/(heads|tags|remotes)/")
    young = epoch_seconds(F.col("author_time")) >= until - F.lit(days * 86_400)
    mine = commits.where((F.col("n_parents") <= 1) & reached & young).join(own, (F.col("repository") == F.col("__r")) & (F.lower("author_email") == F.col("__e")))
    once = mine.drop("__r", "__e", "ref").dropDuplicates(["repository", "commit"])
    return newest_commits(once, most)


def commit_outcomes(commits: DataFrame) -> DataFrame:
    """``commits`` plus ``outcome, detail``: drafts, or a missing_field with the first field that is missing.

    ``files_changed`` is among them: where the statistics could not be read, 0 would claim that nothing was changed.
    """
    missing = F.coalesce(*[F.when(F.col(c).isNull(), c) for c in ("repository", "commit", "author_time", "files_changed")])
    return commits.withColumns({"outcome": F.when(missing.isNull(), "drafts").otherwise("missing_field"), "detail": missing})


def commit_drafts(commits: DataFrame, device: str) -> DataFrame:
    """One draft per commit with all of repository, commit, author time and number of files; never a workspace, never a message."""
    sha, rep = pseudonym("cmt", F.col("commit")), pseudonym("rep", F.col("repository"))
    whole = F.col("repository").isNotNull() & F.col("commit").isNotNull() & F.col("author_time").isNotNull() & F.col("files_changed").isNotNull()
    return commits.where(whole).select(
        F.lit(COMMIT).alias("event_type"), F.concat(F.lit("artifact/commit/"), sha).alias("subject"), F.col("author_time").alias("time"),
        rep.alias("repository_ref"), F.lit(None).cast("string").alias("workspace_ref"), F.col("files_changed").alias("changed_paths_count"),
        count_bucket(F.col("insertions")).alias("insertions_bucket"), count_bucket(F.col("deletions")).alias("deletions_bucket"),
        dedupe_key(F.lit("git"), F.lit(device), F.lit(COMMIT), sha).alias("dedupe_key"),
    )
