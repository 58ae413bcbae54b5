"""Envelopes, gap drafts of every source, the receiver, commit logs and the checks of canonical observations."""

import json
import re
import subprocess

import pytest
from pyspark.sql import functions as F

from tidemark.operators.conformance import envelope_problems, schema_problems, shape_problems
from tidemark.sources import envelope as V
from tidemark.sources import gitlog, live

AT = "2024-05-01T10:00:00.000Z"


def drafts(spark):
    cols = """event_type string, subject string, time string, repository_ref string, workspace_ref string, tool_family string, outcome string, duration_ms bigint,
        response_tokens string, origin string, time_basis string, reason string, detail string, session_kind string, dedupe_key string"""
    none = (None,) * 9
    rows = [
        ("prompt.submitted", "session/ses_1", AT, "rep_1", "wsp_1", *none[:5], None, None, None, None, "claude-code|dev_7|ses_1|prompt.submitted|u1"),
        ("response.completed", "session/ses_1", AT, None, None, None, "succeeded", None, "10-99", None, None, None, None, None, "claude-code|dev_7|ses_1|response.completed|u2"),
        ("tool.finished", "session/ses_1/tool/tol_1", AT, "rep_1", "wsp_1", "shell", "failed", None, None, None, "copied_at", None, None, None, "claude-code|dev_7|ses_1|tool.finished|tol_1"),
        ("source.gap", "source/gap/line:4", AT, None, None, None, None, None, None, None, "acquired_at", "parse_error", None, None, "claude-code|dev_7|source.gap|sha|line:4"),
        ("session.started", "session/ses_1", AT, None, None, None, None, None, None, None, None, None, None, "interactive", "claude-code|dev_7|ses_1|session.started|u9"),
    ]
    return spark.createDataFrame(rows, cols)


def final(spark, df):
    return V.finalise(df, "transcripts", F.lit("dev_7"), AT, "demo", F.lit("line:1"))


def test_finalised_observations(spark):
    got = {r.subject + r.type: r.asDict() for r in final(spark, drafts(spark)).collect()}
    tool = got["session/ses_1/tool/tol_1dev.demo.tool.finished.v1"]
    assert tool["source"] == "demo://device/dev_7/adapter/claude-code" and tool["specversion"] == "1.0" and len(tool) == 25
    assert json.loads(tool["data"]) == {"tool_family": "shell", "outcome": "failed", "duration_ms": None, "workspace_ref": "wsp_1", "content_ref": None, "time_basis": "copied_at"}
    assert tool["demointegritystate"] == "ok" and tool["demoprofile"] == "personal" and tool["demosourceversion"] == "claude-code-transcript/1" and tool["demomonotonicns"] is None
    gap = got["source/gap/line:4dev.demo.source.gap.v1"]
    assert json.loads(gap["data"]) == {"reason": "parse_error", "detail": None, "time_basis": "acquired_at"} and gap["demointegritystate"] == "gap"
    said = got["session/ses_1dev.demo.response.completed.v1"]
    assert json.loads(said["data"]) == {"outcome": "succeeded", "content_ref": None, "response_tokens": "10-99"}
    ids = [r["id"] for r in got.values()]
    assert len(set(ids)) == 5 and all(re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", i) for i in ids)
    assert ids == [r.id for r in final(spark, drafts(spark)).collect()] and int(ids[0].replace("-", "")[:12], 16) == 1714557600000
    assert final(spark, drafts(spark).limit(0)).count() == 0


def test_finalised_observations_hold_the_schema(spark):
    bodies = V.as_bodies(final(spark, drafts(spark)))
    assert schema_problems(bodies, "id", "body", "demo").count() == 0
    whole = json.loads(bodies.first().body)
    broken = {
        "a": {k: v for k, v in whole.items() if k != "time"}, "b": whole | {"extra": 1}, "c": whole | {"specversion": 1.0, "demoprofile": "home"},
        "d": whole | {"time": "2024-13-01T00:00:00Z", "subject": "a b"}, "e": whole | {"demoworkspaceref": "x", "traceparent": "00"},
        "f": whole | {"type": "dev.demo.tool.started.v1", "data": {"tool_family": "odd", "time_basis": "now"}}, "g": whole | {"data": []},
        "h": whole | {"demointegritystate": "quarantined", "demosourcekind": "media", "type": "dev.other.any.thing.v2", "data": {}}, "i": whole | {"demosourcekind": "browser"},
    }
    rows = [(k, json.dumps(v)) for k, v in broken.items()] + [("j", "{torn"), ("k", None), ("l", "[1]")]
    got = {tuple(r) for r in schema_problems(spark.createDataFrame(rows, "k string, body string"), "k", "body", "demo").collect()}
    assert got == {
        ("a", "time is missing"), ("b", "extra is unknown"), ("c", "specversion has another form"), ("c", "demoprofile has another form"), ("d", "time has another form"),
        ("d", "subject has another form"), ("e", "demoworkspaceref has another form"), ("e", "traceparent has another form"), ("f", "data.tool_family has another form"),
        ("f", "data.content_ref is missing"), ("f", "data.time_basis has another form"), ("g", "data has another form"), ("g", "data.content_ref is missing"),
        ("i", "demosourcekind has another form"), ("j", "unreadable"), ("k", "unreadable"), ("l", "unreadable"),
    }


def test_envelope_columns(spark):
    cols = """row_id int, obs_id string, source_uri string, event_type string, subject string, obs_time string, observed_at string, source_kind string, dedupe_key string, integrity_state string,
        profile string, workspace_ref string, repository_ref string, time_basis string, tool_family string"""
    good = ("018598fa-3da9-7daa-b908-53c753789400", "x://device/dev_1/adapter/git", "dev.x.commit.observed.v1", "artifact/commit/cmt_1", AT, AT, "git", "k", "quarantined", "personal", None, "rep_1", None, None)
    bad = (None, "x://device/a b/adapter/git", "odd", "", "1.2.2024", AT, "browser", "", "lost", "home", "w", "h/o/r", "then", "odd")
    got = {tuple(r) for r in envelope_problems(spark.createDataFrame([(1, *good), (2, *bad)], cols)).collect()}
    assert {r[0] for r in got} == {2} and {p for _, p in got} == {
        "obs_id is missing", "source_uri has another form", "event_type has another form", "subject has another form", "obs_time is no date-time", "source_kind is unknown",
        "dedupe_key is empty", "integrity_state is unknown", "profile is unknown", "workspace_ref has another form", "repository_ref has another form", "time_basis is unknown", "tool_family is unknown",
    }


def test_shapes(spark):
    shape = {"vendor": "v", "variant": "a", "description": "d", "records": [{"type": "x"}]}
    rows = [("ok", json.dumps(shape)), ("torn", "{"), ("lacking", json.dumps({"vendor": 1, "records": []})), ("leak", json.dumps({**shape, "description": "me@x.org in /home/bob/x"})), ("fine", json.dumps({**shape, "description": "/home/dev/x"}))]
    got = {tuple(r) for r in shape_problems(spark.createDataFrame(rows, "name string, text string")).collect()}
    assert got == {("torn", "unreadable"), ("lacking", "lacks variant"), ("lacking", "lacks description"), ("lacking", "has no records"),
                   ("leak", "holds an address"), ("leak", "holds a home directory")}


def test_receiver(spark):
    long = json.dumps({"hook_event_name": "PreToolUse", "session_id": "s", "cwd": "x" * 5000})
    given = ['{"session_id": "s", "hook_event_name": "Stop", "prompt_id": 5, "tool_input": "secret", "duration_ms": 1.5}', '{"duration_ms": 7}', "[1]", "", "torn{", None, long, json.dumps({"hook_event_name": "y" * 70, "cwd": "é" * 3000})]
    df = spark.createDataFrame([(x, AT) for x in given], "value string, received_at string")
    lines = [r.line for r in live.receive(df).collect()]
    got = [json.loads(x) for x in lines]
    head = {"v": 1, "received_at": AT}
    assert got == [
        {**head, "session_id": "s", "hook_event_name": "Stop"}, {**head, "duration_ms": 7}, {**head, "receiver_error": "payload_not_an_object"}, {**head, "receiver_error": "payload_not_an_object"},
        {**head, "receiver_error": "payload_not_an_object"}, {**head, "receiver_error": "payload_unreadable"}, {**head, "hook_event_name": "PreToolUse", "receiver_error": "payload_oversize"},
        {**head, "receiver_error": "payload_oversize"},
    ]
    assert max(len(x.encode()) + 1 for x in lines) <= live.LONGEST_LINE
    raw = spark.createDataFrame([(bytearray(b"\xff{}"), AT), (bytearray(b'{"reason": "x"}'), AT)], "value binary, received_at string")
    assert [json.loads(r.line).get("receiver_error") for r in live.receive(raw).collect()] == ["payload_unreadable", None]
    # The receiver's lines are what the hook normaliser reads.
    records = live.hook_outcomes(live.hook_records(spark.createDataFrame([(x,) for x in lines], "value string")))
    assert [r.outcome for r in records.collect()] == ["missing_field", "unmapped_kind", *["payload_not_an_object"] * 3, "payload_unreadable", "payload_oversize", "payload_oversize"]


def test_hook_gaps_and_their_order(spark):
    lines = [
        '{"v": 1, "received_at": "%s", "hook_event_name": "Stop", "session_id": "s", "prompt_id": "p"}' % AT, "torn", '{"hook_event_name": "Notification", "received_at": "%s"}' % AT,
        '{"hook_event_name": "PreToolUse", "session_id": "s", "received_at": "%s"}' % AT, '{"hook_event_name": "SessionEnd", "session_id": "s"}', '{"receiver_error": "disk on fire", "received_at": "%s"}' % AT,
        '{"hook_event_name": "a b"}',
    ]
    df = spark.createDataFrame([(i, x, f"o{i}", "2024-06-01T00:00:00Z") for i, x in enumerate(lines)], "row_id bigint, value string, object_id string, acquired_at string")
    classified = live.hook_outcomes(live.hook_records(df))
    assert [(r.outcome, r.detail) for r in classified.orderBy("row_id").collect()] == [
        ("drafts", None), ("parse_error", None), ("unmapped_kind", "Notification"), ("missing_field", "tool_use_id"), ("missing_field", "received_at"),
        ("receiver_error_unrecognized", None), ("unmapped_kind", None),
    ]
    gaps = {r.row_id: r for r in live.hook_gap_drafts(classified, "dev_7").collect()}
    assert set(gaps) == {1, 2, 3, 4, 5, 6} and gaps[1].time_basis == "acquired_at" and (gaps[2].time, gaps[2].time_basis) == (AT, "received_at")
    assert gaps[4].time == "2024-06-01T00:00:00Z" and gaps[3].dedupe_key == "claude-code|dev_7|source.gap|o3|line:3" and gaps[5].reason == "receiver_error_unrecognized"


def test_spool_facts(spark):
    lines = spark.createDataFrame([(2, '{"received_at": "b"}'), (1, '{"received_at": "a"}'), (3, "torn")], "line_no int, line string")
    assert live.spool_facts(lines, 1).first().asDict() == {"drained": 2, "begins_at": "a"} and live.spool_facts(lines.limit(0)).first().asDict() == {"drained": 0, "begins_at": None}


def test_commit_gaps_and_limits(spark):
    cols = "repository string, commit string, author_time string, files_changed bigint, insertions bigint, deletions bigint"
    df = spark.createDataFrame([("r", "c", AT, 1, 2, None), ("r", "d", AT, None, 1, 1), (None, None, AT, 0, 0, 0), ("r", "e", None, 0, 0, 0)], cols)
    assert [(r.outcome, r.detail) for r in live.commit_outcomes(df).collect()] == [("drafts", None), ("missing_field", "files_changed"), ("missing_field", "repository"), ("missing_field", "author_time")]
    assert [r.subject for r in live.commit_drafts(df, "dev_7").collect()] == [live.commit_drafts(df.limit(1), "dev_7").first().subject]
    rows = [("r", f"c{i}", f"2024-05-0{i + 1}T00:00:00Z", "Me@x.org", 1, "refs/heads/a") for i in range(5)]
    rows += [("r", "c4", "2024-05-05T00:00:00Z", "me@x.org", 1, "refs/tags/t"), ("r", "m", "2024-05-06T00:00:00Z", "me@x.org", 2, "refs/heads/a"), ("r", "other", "2024-05-06T00:00:00Z", "you@x.org", 1, "refs/heads/a"),
             ("r", "stash", "2024-05-06T00:00:00Z", "me@x.org", 1, "refs/stash"), ("r", "old", "2023-05-06T00:00:00Z", "me@x.org", 1, "refs/heads/a")]
    commits = spark.createDataFrame(rows, "repository string, commit string, author_time string, author_email string, n_parents int, ref string")
    mine = spark.createDataFrame([("r", "me@X.org"), ("r", "ME@x.org")], "repository string, email string")
    got = live.within_limits(commits, F.lit(1715000000), mine, most=3).collect()
    assert {r.commit for r in got} == {"c4", "c3", "c2"} and all(r.truncated for r in got)


@pytest.fixture
def repositories(tmp_path):
    def git(where, *args):
        subprocess.run(["git", "-C", str(where), *args], check=True, capture_output=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path), "GIT_CONFIG_NOSYSTEM": "1"})

    made = {}
    for name in ("full", "empty", "nobody"):
        made[name] = tmp_path / name
        made[name].mkdir()
        git(made[name], "init", "-q", "-b", "main")
    git(made["full"], "config", "user.email", "me@x.org")
    git(made["full"], "config", "user.name", "me")
    for i in range(3):
        (made["full"] / "f").write_text("line\n" * (i + 1))
        git(made["full"], "add", "f")
        git(made["full"], "commit", "-q", "-m", f"m{i}")
    git(made["full"], "commit", "-q", "--allow-empty", "-m", "nothing", "--author", "other <o@x.org>")
    (made["nobody"] / "f").write_text("x")
    git(made["nobody"], "add", "f")
    git(made["nobody"], "-c", "user.email=a@x.org", "-c", "user.name=a", "commit", "-q", "-m", "m")
    plain = tmp_path / "plain"
    plain.mkdir()
    return {**{k: str(v) for k, v in made.items()}, "plain": str(plain), "gone": str(tmp_path / "gone"), "unsafe": None}


def test_commit_logs(spark, repositories, monkeypatch, tmp_path):
    monkeypatch.setenv("GIT_CONFIG_GLOBAL", "/dev/null")
    monkeypatch.setenv("GIT_CONFIG_NOSYSTEM", "1")
    found = {n: gitlog.scan(n, p, 90, 2, 20) for n, p in repositories.items()}
    assert {n: f[0] for n, f in found.items()} == {"full": "collected", "empty": "no_commits_yet", "nobody": "no_identity", "plain": "not_a_repository", "gone": "missing", "unsafe": "missing"}
    lines = gitlog.read_logs(spark, {n: p for n, p in repositories.items() if n != "nobody"}, most=2).cache()
    report = {r.repository: (r.outcome, r.commits, r.truncated) for r in gitlog.scan_report(lines, 2).collect()}
    assert report == {"full": ("collected", 2, True), "empty": ("no_commits_yet", 0, False), "plain": ("not_a_repository", 0, False), "gone": ("missing", 0, False), "unsafe": ("missing", 0, False)}
    commits = gitlog.commits_of(lines, 2).collect()
    assert len(commits) == 2 and all((r.files_changed, r.deletions) == (1, 0) and r.insertions == 1 for r in commits)
    slow = tmp_path / "bin" / "git"
    slow.parent.mkdir()
    slow.write_text("#!/bin/sh\nsleep 20\n")
    slow.chmod(0o755)
    monkeypatch.setenv("PATH", f"{slow.parent}:/usr/bin:/bin")
    assert gitlog.scan("full", repositories["full"], 90, 2, 0.3)[0] == "timed_out"


def test_accounting_of_a_dry_run(spark):
    d = drafts(spark).unionByName(drafts(spark).limit(2))
    assert {tuple(r) for r in V.accounting(d).where("event_type like 'prompt%'").collect()} == {("prompt.submitted", 2, 1, 1)}
    known = spark.createDataFrame([("claude-code|dev_7|ses_1|prompt.submitted|u1",), (None,)], "dedupe_key string")
    assert {tuple(r) for r in V.accounting(d, known).where("event_type like 'prompt%'").collect()} == {("prompt.submitted", 2, 0, 2)}
    outcomes = spark.createDataFrame([("drafts", None), ("parse_error", None), ("unmapped_kind", None), ("unmapped_kind", "mode"), ("skipped", None)], "outcome string, detail string")
    got = {(r.section, r.item): r.n for r in V.import_report(d, outcomes, known).collect()}
    assert got == {("created", "response.completed"): 1, ("created", "tool.finished"): 1, ("created", "source.gap"): 1, ("created", "session.started"): 1, ("already_present", None): 3,
                   ("parse_error", None): 1, ("unmapped_kind", "(unprintable)"): 1, ("unmapped_kind", "mode"): 1, ("skipped", None): 1, ("unattributed", None): 3, ("inherited", None): 1}
    assert V.accounting(d.limit(0), known).count() == 0


def test_device(spark, tmp_path):
    root = f"file:{tmp_path}"
    assert V.device_id(spark, root, mint=False) is None
    made = V.device_id(spark, root)
    assert re.fullmatch("dev_[0-9a-f]{16}", made) and V.device_id(spark, root) == made == V.device_id(spark, root, mint=False)
