"""Files, ledger, live sources and normalisers on hand-made records."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalars import CODEX_TOOLS  # noqa: F401
from tidemark.sources import files as S
from tidemark.sources.ledger import Ledger, LedgerError, new_rows_only, register_identities, with_display
from tidemark.sources.live import commit_drafts, hook_drafts, hook_gaps, hook_records, newest_commits, parse_log
from tidemark.sources.rollouts import classified_drafts, inherited_lines, line_outcomes, rollout_drafts, with_fields
from tidemark.sources.transcripts import session_majority, transcript_drafts, transcript_gaps, transcript_outcomes
from tidemark.streaming.live import live_drafts, live_sessions, spool


def test_discover_and_archive(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/x.jsonl").write_bytes(b"1\n2\n")
    (tmp_path / "a/b/y.jsonl").write_bytes(b"1\n2\n")
    (tmp_path / "a/z.txt").write_bytes(b"no")
    found = S.discover(spark, {"k": str(tmp_path / "a"), "gone": str(tmp_path / "none")})
    assert found.count() == 2 and found.where(~S.is_object_id(F.col("object_id"))).count() == 0
    objects = spark.createDataFrame([], "object_id string, content binary")
    snapshots = spark.createDataFrame([], "locator string, object_id string")
    new, fresh, counts = S.archive(found, objects, snapshots)
    assert new.count() == 1 and fresh.count() == 2 and counts.first().n == 2
    again = S.archive(found, new, fresh)
    assert again[0].count() == 0 and again[1].count() == 0 and again[2].first().outcome == "present"
    ids = spark.createDataFrame([("sha256:" + "a" * 64,), ("sha256:" + "A" * 64,), ("md5:x",), (None,)], "t string")
    assert [r[0] for r in ids.select(S.is_object_id(F.col("t"))).collect()] == [True, False, False, False]


def test_lines_and_cursors(spark):
    contents = [("torn", 2, b"a\r\nb\nc"), ("whole", 2, b"a\n\n"), ("empty", 2, b""), ("bad", 2, b"\xff\xfe\nx\n"), ("same", 1, b"q\n")]
    now = spark.createDataFrame(contents, "locator string, snapshot_id bigint, content binary")
    lines = {(r.locator, r.line_no): r.line for r in S.read_lines(now).collect()}
    assert lines[("torn", 1)] == "a" and ("torn", 3) not in lines and lines[("whole", 2)] == "" and "�" in lines[("bad", 1)] and ("empty", 1) not in lines
    assert [r.locator for r in now.where(S.ends_torn(F.col("content"))).collect()] == ["torn"]
    before = spark.createDataFrame([("torn", 1, 1, b"a\n"), ("whole", 1, 1, b"z\n"), ("same", 1, 1, b"q\n"), ("bad", 1, 5, b"\xff\n"), ("empty", 1, 1, None)], "locator string, snapshot_id bigint, cursor int, content binary")
    assert {r.locator: r.start_line for r in S.cursors(now, before).collect()} == {"torn": 1, "whole": 0, "empty": 0, "bad": 0}
    snaps = spark.createDataFrame([("l", 1, "x"), ("l", 3, "y"), ("m", 2, "z")], "locator string, snapshot_id bigint, object_id string")
    assert {(r.locator, r.object_id) for r in S.latest(snaps).collect()} == {("l", "y"), ("m", "z")}
    marks = spark.createDataFrame([("l", 3, 10), ("m", 5, 1)], "locator string, snapshot_id bigint, cursor bigint")
    wrote = spark.createDataFrame([("l", 3, 2), ("m", 4, 9), ("n", 1, 1)], "locator string, snapshot_id bigint, cursor bigint")
    assert {tuple(r) for r in S.advance(marks, wrote).collect()} == {("l", 3, 2), ("m", 5, 1), ("n", 1, 1)}


def test_ledger(spark, tmp_path):
    schema = "obs_id string, dedupe_key string, ingest_seq bigint, instant bigint, occurred_at string"
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.read() is None
    first = spark.createDataFrame([("1", "k", 2, 50, "1970-01-01T00:00:50Z"), ("2", "k", 1, 60, "1970-01-01T00:01:00Z"), ("3", "u", 3, None, "1970-01-01T00:5x"), ("4", "far", 4, 10**9, "2001")], schema)
    assert ledger.append(first) == 3 and ledger.append(first) == 0
    assert {r.obs_id for r in ledger.between(0, 100).collect()} == {"2", "3"}
    with pytest.raises(LedgerError):
        ledger.append(spark.createDataFrame([("2", "new", 9, 70, "1970")], schema))
    assert ledger.read().count() == 3
    (tmp_path / "ledger/_batches/00000009-9-x").write_text("")
    with pytest.raises(LedgerError):
        ledger.batches()


def test_identities(spark):
    known = spark.createDataFrame([("r1", "one", 1)], "ref string, display string, first_seen int")
    seen = spark.createDataFrame([("r1", "other", 0), ("r2", "late", 5), ("r2", "two", 2)], "ref string, display string, first_seen int")
    assert [tuple(r) for r in register_identities(known, seen).collect()] == [("r2", "two", 2)]
    rows = spark.createDataFrame([("r1",), ("rx",), (None,)], "ref string")
    assert [r.name for r in with_display(rows, known, "ref", "name").orderBy("ref").collect()] == [None, "one", "rx"]
    assert new_rows_only(seen, known, ["ref"]).count() == 2


def test_hooks(spark):
    def h(**f):
        return (json.dumps({"v": 1, **f}),)

    s = {"session_id": "s", "received_at": "2026-07-26T00:00:00Z"}
    lines = spark.createDataFrame(
        [h(**s, hook_event_name="SessionStart"), h(**s, hook_event_name="UserPromptSubmit"), h(**s, hook_event_name="UserPromptSubmit", prompt_id="p"),
         h(**s, hook_event_name="StopFailure", prompt_id="p"), h(**s, hook_event_name="PostToolUse", prompt_id="p", tool_use_id="t", tool_name="Read", duration_ms=7, agent_type="a b"),
         h(**s, hook_event_name="SessionEnd", reason="logout"), h(**s, hook_event_name="Odd"), h(hook_event_name="SessionStart"), h(receiver_error="payload_oversize"), h(receiver_error="x"), ("torn{",), (None,)],
        "value string",
    )
    records = hook_records(lines)
    got = {r.event_type: r for r in hook_drafts(records, "dev").collect()}
    assert set(got) == {"session.started", "prompt.submitted", "response.completed", "tool.finished", "session.ended"}
    assert got["response.completed"].outcome == "failed" and got["session.ended"].reason == "unknown" and got["tool.finished"].duration_ms == 7
    assert got["tool.finished"].agent_type is None and got["tool.finished"].tool_family == "read" and got["tool.finished"].subject.count("/") == 5
    assert {r.reason for r in hook_gaps(records).collect()} == {"payload_oversize", "receiver_error_unrecognized"}


def test_commits(spark):
    sha = [c * 40 for c in "abcd"]
    text = [f"{sha[0]}\t2026-07-26T00:00:00Z", "", " 2 files changed, 3 insertions(+), 1 deletion(-)", f"{sha[1]}\t2026-07-25T00:00:00Z", f"{sha[2]}\t2026-07-24T00:00:00Z", " weird",
            f"{sha[3]}\t2026-07-23T00:00:00Z", " 1 file changed, 1 insertion(+)", " 1 file changed, 1 insertion(+)"]
    lines = spark.createDataFrame([("h/o/r", i, t) for i, t in enumerate(text)], "repository string, line_no int, line string")
    got = {r.commit[0]: (r.files_changed, r.insertions, r.deletions) for r in parse_log(lines).collect()}
    assert got == {"a": (2, 3, 1), "b": (0, 0, 0), "c": (None, None, None), "d": (None, None, None)}
    newest = newest_commits(parse_log(lines), 2)
    assert {r.commit[0] for r in newest.collect()} == {"a", "b"} and newest.first().truncated
    d = commit_drafts(parse_log(lines), "dev").where("insertions_bucket = '1-9'").first()
    assert d.deletions_bucket == "1-9" and d.subject.startswith("artifact/commit/cmt_") and d.workspace_ref is None


def transcripts(spark, rows):
    schema = "row_id bigint, file_ref string, session_id string, rec_uuid string, rec_type string, is_sidechain boolean, is_meta boolean, ts_raw string, device_ref string, cwd string, content_json string, output_tokens bigint"
    return spark.createDataFrame(rows, schema)


def test_transcript_drafts(spark):
    t, c = "2026-07-26T00:00:0%dZ", "/home/dev/ghq/h/o/r"
    use = json.dumps([{"type": "text", "text": "x"}, {"type": "tool_use", "id": "u", "name": "Bash"}])
    result = json.dumps([{"type": "tool_result", "tool_use_id": "u", "is_error": True}])
    rows = [
        (1, "f", "s", "a", "user", None, None, t % 0, "d", c, '"hi"', None), (2, "f", "s", "b", "assistant", True, None, t % 1, "d", "/elsewhere", use, 12),
        (3, "f", "s", "c", "user", True, True, t % 3, "d", None, result, None), (4, "f", "s", "e", "user", True, None, t % 4, "d", c, '"side"', None),
        (5, "f", "s", None, "user", None, None, t % 5, "d", c, '"no id"', None), (6, "f", "s", "g", "summary", None, None, t % 6, "d", c, None, None),
        (7, "f", "s", "h", "user", None, None, t % 7, "d", c, '{"type": "tool_result"}', None), (8, "f", None, "i", "user", None, None, t % 7, "d", c, '"x"', None),
    ]
    got = {(r.row_id, r.draft_no): r for r in transcript_drafts(transcripts(spark, rows)).collect()}
    assert {k: r.event_type for k, r in got.items()} == {(1, 0): "prompt.submitted", (2, 0): "response.completed", (2, 1): "tool.started", (3, 0): "tool.finished", (7, 0): "prompt.submitted"}
    assert (got[3, 0].outcome, got[3, 0].duration_ms, got[3, 0].tool_family, got[2, 0].response_tokens) == ("failed", 2000, "shell", "10-99")
    assert got[2, 0].repository_ref is None and got[3, 0].repository_ref == got[1, 0].repository_ref and got[2, 1].subject == got[3, 0].subject
    assert transcript_drafts(transcripts(spark, [])).count() == 0


def test_majority_ties(spark):
    base = "/home/dev/ghq/h/o/"
    rows = [(i, "f", "s", str(i), "user", None, None, "t", "d", base + p, None, None) for i, p in enumerate(["b", "b/.worktrees/y", "a", "a/.worktrees/x", "a/.worktrees/w"])]
    rows += [(9, "f", "t", "9", "user", None, None, "t", "d", base + "b", None, None), (10, "f", "t", "10", "user", None, None, "t", "d", base + "a", None, None)]
    got = {r.session_id: (r.vote_repository, r.vote_workspace) for r in session_majority(transcripts(spark, rows)).collect()}
    assert got == {"s": ("h/o/a", "h/o/a"), "t": ("h/o/a", "h/o/a")}


def rollouts(spark, rows):
    return spark.createDataFrame(
        [(i, f, n, "dev", k.split(":")[0], (k.split(":") + [None])[1], t, p if p is None or isinstance(p, str) else json.dumps(p), o) for i, (f, n, k, t, p, o) in enumerate(rows)],
        "row_id bigint, file_ref string, line_no bigint, device_ref string, rec_type string, payload_type string, ts_raw string, payload_json string, ordinal bigint",
    )


def test_rollout_drafts(spark):
    t = "2026-07-26T00:00:0%dZ"
    meta = {"id": "thread", "session_id": "s", "cwd": "/home/dev/ghq/h/o/r", "source": "exec"}
    rows = [
        ("f", 1, "session_meta", t % 0, meta, None), ("f", 2, "event_msg:user_message", t % 1, {"message": "hi"}, None), ("f", 3, "event_msg:agent_message", t % 2, {"message": 5}, None),
        ("f", 4, "response_item:function_call", t % 2, {"id": "i", "call_id": "c", "name": "shell"}, None), ("f", 5, "response_item:function_call_output", t % 4, {"call_id": "c", "status": "completed"}, None),
        ("f", 6, "event_msg:task_started", t % 4, {"turn_id": "x", "started_at": 1}, None), ("f", 7, "event_msg:task_complete", t % 5, {"turn_id": "x", "error": None, "duration_ms": 9}, None),
        ("f", 8, "event_msg:task_complete", t % 5, {"turn_id": "other"}, None), ("f", 9, "event_msg:mcp_tool_call_end", t % 6, {"call_id": "m", "duration": {"secs": 1, "nanos": 2999999}}, None),
        ("f", 10, "event_msg:odd thing", t % 6, {}, None), ("f", 11, "event_msg:user_message", None, {}, None), ("f", 12, "event_msg:user_message", t % 7, "{torn", None),
        ("g", 1, "event_msg:user_message", t % 1, {"message": "no session"}, None), ("g", 2, "event_msg:sub_agent_activity", t % 1, {"agent_thread_id": "thread"}, None),
    ]
    df = rollouts(spark, rows)
    got = {r.row_id: r for r in rollout_drafts(df).collect()}
    assert {k: r.event_type for k, r in got.items()} == {
        0: "session.started", 1: "prompt.submitted", 2: "response.completed", 3: "tool.started", 4: "tool.finished", 6: "turn.completed", 8: "tool.finished", 11: "prompt.submitted",
    }
    assert got[3].subject == got[4].subject and (got[4].outcome, got[4].duration_ms, got[4].tool_family) == ("succeeded", 2000, "shell")
    assert (got[6].outcome, got[6].duration_ms, got[8].duration_ms, got[0].session_kind, got[1].origin) == ("failed", 9, 1002, "headless", "subagent")
    out = {r.row_id: (r.outcome, r.detail) for r in line_outcomes(df).collect()}
    assert out[9] == ("unmapped_kind", None) and out[10] == ("missing_field", "timestamp") and out[11] == ("parse_error", None)
    assert out[12] == ("missing_field", "session_id") and out[7] == ("skipped", None) and out[0] == ("drafts", None)


@pytest.mark.parametrize(
    ("meta", "second", "expected"),
    [
        ({"id": "me", "forked_from_id": "p"}, {"id": "p"}, [False, True, True, False, False]),
        ({"id": "me", "forked_from_id": "p", "history_base": 1}, {"id": "p"}, [False] * 5),
        ({"id": "me"}, {"id": "p"}, [False] * 5),
        ({"id": "me", "parent_thread_id": "p"}, {"id": "me"}, [False] * 5),
        ({"id": "me", "subagent_history_start_ordinal": 3}, {"id": "p"}, [True, True, False, False, False]),
        ({"forked_from_id": "p"}, {"id": "p"}, [False] * 5),
    ],
)
def test_copied_history(spark, meta, second, expected):
    at = ["2026-07-26T00:00:00Z", "2026-07-26T00:00:00.5Z", "2026-07-26T00:00:01Z", "broken", "2026-07-26T00:00:00Z"]
    payloads = [meta, second, {}, {}, {}]
    kinds = ["session_meta", "session_meta", "event_msg:user_message", "event_msg:user_message", "event_msg:user_message"]
    df = rollouts(spark, [("f", i + 1, k, a, p, i + 1) for i, (k, a, p) in enumerate(zip(kinds, at, payloads))])
    assert [r.inherited for r in inherited_lines(with_fields(df)).orderBy("row_id").collect()] == expected


def test_streaming(spark, tmp_path):
    folder = tmp_path / "spool"
    folder.mkdir()
    line = {"v": 1, "session_id": "s", "cwd": "/home/dev/ghq/h/o/r", "hook_event_name": "UserPromptSubmit"}
    at = ["00:00:00", "00:05:00", "00:10:01", "00:10:01"]
    (folder / "1.txt").write_text("\n".join(json.dumps(line | {"prompt_id": a, "received_at": f"2026-07-26T{a}Z"}) for a in at) + "\nnot json\n")
    sessions = live_sessions(live_drafts(spool(spark, str(folder)), "dev"))
    q = sessions.writeStream.outputMode("complete").format("memory").queryName("live").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("live").collect()) == [1, 2]


def test_transcript_gaps(spark):
    t, c = "2026-07-26T00:00:00Z", "/home/dev/ghq/h/o/r"
    rows = [
        (1, "f", "s", "a", "user", None, None, t, "d", c, '"hi"', None), (2, "f", "s", "b", "user", True, None, t, "d", c, '"side"', None),
        (3, "f", None, None, "user", None, None, None, "d", c, '"x"', None), (4, "f", "s", "e", "assistant", None, None, None, "d", c, "[]", None),
        (5, "f", "s", None, "user", True, None, t, "d", c, '"x"', None), (6, "f", "s", "g", "summary", None, None, t, "d", c, None, None),
        (7, "f", None, None, "odd kind", None, None, None, "d", c, None, None), (8, "f", "s", "h", None, None, None, t, "d", c, None, None),
        (9, "f", "s", "i", "attachment", None, None, t, "d", c, None, None),
    ]
    df = transcripts(spark, rows)
    assert {r.row_id: (r.outcome, r.detail) for r in transcript_outcomes(df).collect()} == {
        1: ("drafts", None), 2: ("skipped", None), 3: ("missing_field", "sessionId"), 4: ("missing_field", "timestamp"), 5: ("missing_field", "uuid"),
        6: ("unmapped_kind", "summary"), 7: ("unmapped_kind", None), 8: ("unmapped_kind", None), 9: ("skipped", None),
    }
    got = {r.row_id: r for r in transcript_gaps(df.withColumn("acquired_at", F.lit("2026-08-01T00:00:00Z"))).collect()}
    assert set(got) == {3, 4, 5, 6, 7, 8} and {r.event_type for r in got.values()} == {"source.gap"}
    assert (got[4].time, got[4].time_basis, got[6].time, got[6].time_basis) == ("2026-08-01T00:00:00Z", "acquired_at", t, "occurred_at")
    assert (got[6].subject, got[6].dedupe_key, got[6].reason) == ("source/gap/line:6", "claude-code|d|source.gap|f|line:6", "unmapped_kind")
    bare = {r.row_id: (r.time, r.time_basis) for r in transcript_gaps(df).collect()}
    received = transcript_gaps(df.withColumn("received_at", F.timestamp_seconds(F.lit(1)))).where("row_id = 4").first()
    assert (received.time, received.time_basis) == ("1970-01-01T00:00:01Z", "acquired_at")
    assert bare[4] == (None, "acquired_at") and transcript_gaps(transcripts(spark, [])).count() == 0


def test_rollout_gaps(spark):
    t = "2026-07-26T00:00:00Z"
    rows = [
        ("f", 1, "session_meta", t, {"id": "me", "session_id": "s", "subagent_history_start_ordinal": 3}, 1), ("f", 2, "event_msg:token_count", t, {}, 2),
        ("f", 3, "event_msg:token_count", t, {}, 3), ("f", 4, "event_msg:user_message", None, {}, 4), ("f", 5, "event_msg:user_message", t, "{torn", 5),
        ("f", 6, "event_msg:task_complete", t, {"turn_id": "x"}, 6), ("f", 7, "event_msg:user_message", t, {"message": "hi"}, 7),
    ]
    got = {r.row_id: r for r in classified_drafts(rollouts(spark, rows)).collect()}
    assert {k: (r.event_type, r.reason, r.detail, r.time_basis) for k, r in got.items()} == {
        0: ("session.started", None, None, "copied_at"), 1: ("source.gap", "unmapped_kind", "event_msg:token_count", "copied_at"),
        2: ("source.gap", "unmapped_kind", "event_msg:token_count", "occurred_at"), 3: ("source.gap", "missing_field", "timestamp", "acquired_at"),
        4: ("source.gap", "parse_error", None, "acquired_at"), 6: ("prompt.submitted", None, None, None),
    }
    assert (got[1].subject, got[1].dedupe_key, got[4].time) == ("source/gap/line:2", "codex|dev|source.gap|f|line:2", None)
    lines = Counter(r.row_id for r in classified_drafts(rollouts(spark, rows)).collect())
    assert set(lines.values()) == {1}


def test_transcript_optional_fields(spark):
    t, c = "2026-07-26T00:00:00Z", "/home/dev/ghq/h/o/r"
    start, other = '{"type": "hook_success", "hookEvent": "SessionStart"}', '{"type": "hook_success", "hookEvent": "Stop"}'
    block = '[{"type": "tool_result", "tool_use_id": "u"%s}]'
    fields = [
        ("attachment", None, None, None, None, start), ("attachment", None, None, None, None, other), ("attachment", None, None, None, None, "{torn"),
        ("assistant", "[]", True, None, None, None), ("assistant", "[]", None, '"rate"', None, None), ("assistant", "[]", False, "null", None, None),
        ("user", block % "", None, None, '{"exit_code": 0}', None), ("user", block % "", None, None, '{"exit_code": 2}', None),
        ("user", block % ', "is_error": false', None, None, '{"exit_code": 2}', None), ("user", '"x"', None, None, '"done"', None), ("user", '"x"', None, None, "null", None),
    ]
    schema = "row_id bigint, file_ref string, session_id string, rec_uuid string, rec_type string, is_sidechain boolean, is_meta boolean, ts_raw string, device_ref string, cwd string, content_json string, output_tokens bigint, is_api_error boolean, error_json string, tool_result_json string, attachment_json string"
    df = spark.createDataFrame([(i, "f", "s", f"u{i}", k, None, None, t, "d", c, x, None, *more) for i, (k, x, *more) in enumerate(fields)], schema)
    got = {r.row_id: r for r in transcript_drafts(df).collect()}
    assert {k: (r.event_type, r.outcome) for k, r in got.items()} == {
        0: ("session.started", None), 3: ("response.completed", "failed"), 4: ("response.completed", "failed"), 5: ("response.completed", "succeeded"),
        6: ("tool.finished", "succeeded"), 7: ("tool.finished", "failed"), 8: ("tool.finished", "succeeded"), 9: ("tool.finished", "unknown"), 10: ("prompt.submitted", None),
    }
    assert (got[0].session_kind, got[3].session_kind, got[9].tool_family) == ("interactive", None, "other")
    assert got[0].dedupe_key.endswith("|session.started|u0") and got[9].dedupe_key.endswith("|tool.finished|u9")
    assert {r.row_id: r.outcome for r in transcript_outcomes(df).collect()}[1] == "skipped"
