"""Drafts made into canonical observations: device, ids, source address and the whole envelope."""

from __future__ import annotations

import hashlib
import os
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import GAP

#: Per channel its source kind, the contract of its records and the version of its normaliser.
CHANNELS = {
    "transcripts": ("claude-code", "claude-code-transcript/1", "claude-code-history/0.0.0"),
    "rollouts": ("codex", "codex-transcript/1", "codex-history/0.0.0"),
    "hooks": ("claude-code", "claude-code-hook/1", "claude-code@0.0.0"),
    "commits": ("git", "git-log/1", "git@0.0.0"),
}
#: What an event's data always says (null where not known), and what it says only if known, in order.
CONTENT = ("content_ref",)
PAYLOAD = {
    "session.started": (("session_kind",), ()),
    "session.ended": (("reason",), ("turn_count",)),
    "prompt.submitted": (CONTENT, ("prompt_tokens", "origin")),
    "response.completed": (("outcome", *CONTENT), ("response_tokens",)),
    "turn.completed": (("outcome", "duration_ms", "time_to_first_token_ms", *CONTENT), ()),
    "tool.started": (("tool_family", "workspace_ref", *CONTENT), ("agent_ref", "agent_type")),
    "tool.finished": (("tool_family", "outcome", "duration_ms", "workspace_ref", *CONTENT), ("agent_ref", "agent_type")),
    "commit.observed": (("repository_ref", "changed_paths_count", "message_ref"), ("insertions_bucket", "deletions_bucket")),
    GAP: (("reason", "detail"), ()),
}


def _object(always: Sequence[Column], known: Sequence[Column]) -> Column:
    """JSON text of an object: some fields also when null, others only when not."""
    left = F.to_json(F.struct(*always), {"ignoreNullFields": "false"})
    if not known:
        return left
    right = F.to_json(F.struct(*known))
    return F.when(right == "{}", left).otherwise(F.concat(F.regexp_replace(left, r"\}$", ""), F.lit(","), F.substring(right, 2, 1 << 30)))


def payload(drafts: DataFrame) -> Column:
    """The ``data`` of a draft as JSON; null for an event without a rule."""
    have = lambda n: (F.col(n) if n in drafts.columns else F.lit(None).cast("string")).alias(n)
    out = None
    for event, (always, known) in PAYLOAD.items():
        text = _object([have(n) for n in always], [have(n) for n in (*known, "time_basis")])
        out = (F.when if out is None else out.when)(F.col("event_type") == event, text)
    return out


def uuid7(millis: Column, *seed: Column) -> Column:
    """A time-ordered UUID: 48 bits of the time, the rest from a digest of ``seed``.

    The same seed and time give the same id, so a task that runs again after a lost executor mints no second one.
    """
    digest = F.sha2(F.concat_ws("\x1f", *seed), 256)
    when = F.lower(F.lpad(F.hex(millis), 12, "0"))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 4, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws(
        "-", F.substring(when, 1, 8), F.substring(when, 9, 4), F.concat(F.lit("7"), F.substring(digest, 1, 3)),
        F.concat(variant, F.substring(digest, 5, 3)), F.substring(digest, 8, 12),
    )


def new_device() -> str:
    """A fresh device name."""
    seed = f"{time.time_ns()}-{os.getpid()}-{uuid.uuid4().hex}"
    return "dev_" + hashlib.sha256(seed.encode()).hexdigest()[:16]


def device_id(spark: SparkSession, root: str, mint: bool = True) -> str | None:
    """The device named in ``root/device_id``; a missing or blank one is minted once and kept, or None without ``mint``."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/device_id")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path):
        known = spark.read.option("wholetext", "true").text(path.toString()).first()
        if known and known[0].strip():
            return known[0].strip()
    if not mint:
        return None
    made = new_device()
    out = fs.create(path, True)
    out.write(bytearray(made.encode()))
    out.close()
    return made


def finalise(
    drafts: DataFrame, channel: str, device: Column, observed_at: str, namespace: str, record_ref: Column, profile: str = "personal",
) -> DataFrame:
    """``drafts`` as canonical observations, one row each with all envelope fields; own fields are prefixed by ``namespace``.

    ``observed_at`` is when the run received the records; the ids follow from it and the dedupe key. A history has no
    monotonic clock and no boot id. Gap drafts have the integrity state ``gap``, all others ``ok``. A draft whose
    ``dedupe_key`` lacks the device is the caller's fault.
    """
    kind, source_version, adapter_version = CHANNELS[channel]
    none = F.lit(None).cast("string")
    have = lambda n: F.col(n) if n in drafts.columns else none
    own = lambda c, n: c.alias(f"{namespace}{n}")
    millis = F.unix_millis(F.to_timestamp(F.lit(observed_at)))
    return drafts.select(
        F.lit("1.0").alias("specversion"), uuid7(millis, F.col("dedupe_key")).alias("id"),
        F.concat(F.lit(f"{namespace}://device/"), device, F.lit(f"/adapter/{kind}")).alias("source"),
        F.concat(F.lit(f"dev.{namespace}."), F.col("event_type"), F.lit(".v1")).alias("type"), F.col("subject"), F.col("time"),
        F.lit("application/json").alias("datacontenttype"), none.alias("traceparent"), own(F.lit(0), "schemaversion"), own(F.lit(kind), "sourcekind"),
        own(F.lit(source_version), "sourceversion"), own(F.lit(adapter_version), "adapterversion"), own(record_ref.cast("string"), "sourcerecordref"),
        own(F.lit(observed_at), "observedat"), own(F.lit(None).cast("bigint"), "monotonicns"), own(none, "bootid"), own(F.lit("t1_structured"), "privacyclass"),
        own(none, "purposehint"), own(F.col("dedupe_key"), "dedupekey"), own(F.when(F.col("event_type") == GAP, "gap").otherwise("ok"), "integritystate"),
        own(F.lit(profile), "profile"), own(have("workspace_ref"), "workspaceref"), own(have("repository_ref"), "repositoryref"), own(none, "correlationcluster"),
        payload(drafts).alias("data"),
    )


def as_bodies(observations: DataFrame) -> DataFrame:
    """``id, body``: each observation as one JSON text; absent is only the traceparent of one that has none."""
    shown = [c for c in observations.columns if c not in ("data", "traceparent")]
    head = F.regexp_replace(F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}), r"\}$", "")
    trace = F.coalesce(F.concat(F.lit(',"traceparent":"'), F.col("traceparent"), F.lit('"')), F.lit(""))
    return observations.select("id", F.concat(head, trace, F.lit(',"data":'), F.coalesce("data", F.lit("null")), F.lit("}")).alias("body"))


def accounting(drafts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``event_type, drafts, created, already_present``: what a run creates, or with ``known(dedupe_key)`` would create.

    A key counts as created once, unless the ledger holds it; every other draft of it is present already. Gap drafts
    count like others. Nothing is written.
    """
    per_key = drafts.groupBy("event_type", "dedupe_key").agg(F.count(F.lit(1)).alias("n"))
    if known is None:
        fresh = F.lit(1)
    else:
        held = known.select(F.col("dedupe_key").alias("__k")).where("__k is not null").distinct()
        per_key = per_key.join(held, F.col("dedupe_key") == F.col("__k"), "left")
        fresh = F.when(F.col("__k").isNull(), 1).otherwise(0)
    return per_key.groupBy("event_type").agg(
        F.sum("n").alias("drafts"), F.sum(fresh).cast("bigint").alias("created"), (F.sum("n") - F.sum(fresh)).cast("bigint").alias("already_present")
    )


def import_report(drafts: DataFrame, outcomes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``section, item, n`` of a run: created by type, already present, gaps by reason and detail, skipped, unattributed, inherited.

    ``outcomes(outcome, detail)`` is one row per line. Unattributed drafts are those without a repository, gap drafts left out, as a
    gap never had one; inherited ones carry a copy's time.
    """
    have = lambda n: F.col(n) if n in drafts.columns else F.lit(None).cast("string")
    per_type = accounting(drafts, known)
    none = F.lit(None).cast("string")
    parts = [
        per_type.where("created > 0").select(F.lit("created").alias("section"), F.col("event_type").alias("item"), F.col("created").alias("n")),
        per_type.groupBy().agg(F.coalesce(F.sum("already_present"), F.lit(0)).alias("n")).select(F.lit("already_present"), none, "n"),
        outcomes.groupBy("outcome", "detail").agg(F.count(F.lit(1)).alias("n")).where("outcome <> 'drafts'")
        .select("outcome", F.when(F.col("outcome") == "unmapped_kind", F.coalesce("detail", F.lit("(unprintable)"))).otherwise(F.col("detail")), "n"),
        drafts.agg(F.count_if((F.col("event_type") != GAP) & have("repository_ref").isNull()).alias("n")).select(F.lit("unattributed"), none, "n"),
        drafts.agg(F.count_if(have("time_basis") == "copied_at").alias("n")).select(F.lit("inherited"), none, "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
