"""Golden texts of the report, the day log, the import and the archive run."""

import pytest
from pyspark.sql import Row

from tidemark.plans import params as M
from tidemark.plans import report as R
from tidemark.plans import texts as X
from tidemark.plans.rules import parse_rules
from tidemark.sources import files as S
from tidemark.sources.snapshots import find, history, read_objects, with_snapshot
from tidemark.sources.ledger import Ledger, LedgerError, reconcile

DAY = M.day("2024-01-02")
MIDNIGHT = 1_704_153_600 - 9 * 3600
OFFSET = 9 * 3600


def observations(spark):
    cols = "instant bigint, session string, repository string, event_type string, ingest_seq bigint, tool_family string, time_basis string, origin string, source_kind string"
    at = MIDNIGHT + 9 * 3600
    rows = [
        (at, "s", "h/o/api", "prompt.submitted", 1, None, None, None, "claude-code"), (at + 30, "s", "h/o/api", "tool.started", 2, "shell", None, None, "claude-code"),
        (at + 60, "s", "h/o/api", "response.completed", 3, None, None, None, "claude-code"), (at + 100, "s", "h/o/api", "prompt.submitted", 4, None, None, None, "claude-code"),
        (at + 200, "t", None, "response.completed", 5, None, None, None, "codex"), (at + 210, "t", "h/o/web", "tool.started", 6, None, None, None, "codex"),
        (at + 120, None, "h/o/api", "commit.observed", 7, None, None, None, "git"), (at + 9_000, None, "h/o/web", "commit.observed", 8, None, None, None, "git"),
        (at + 7_200, "t", "h/o/web", "prompt.submitted", 9, None, None, None, "codex"), (at, None, None, "source.gap", 10, None, None, None, "codex"),
        (at, "s", "h/o/api", "prompt.submitted", 11, None, "copied_at", None, "codex"), (at + 205, "t", "h/o/web", "prompt.submitted", 12, None, None, "subagent", "codex"),
    ]
    return R.routed(spark.createDataFrame(rows, cols))


RULES = parse_rules('[[rule]]\nmatch = "h/o/a*"\nworkstream = "core"\n')


def test_report_of_a_day(spark):
    assert X.report_of(observations(spark), DAY, OFFSET, RULES, True, [Row(source_kind="codex", earliest="a", latest="b")]) == """\
2024-01-02  UTC+09:00  [1704121200, 1704207600)

window -1m +5m around a person's prompt, clusters up to 5m apart

workstream  attention  prompts   share
core               8m        2   56.1%
  h/o/api          8m        2
unassigned         6m        1   43.9%
  h/o/web          6m        1

attention          14m  union of the day
                   14m  sum of repositories, counts what overlaps twice

agent               3m  union of the day
                    1m  sum of repositories, counts what overlaps twice
                    1m  h/o/api
                    0m  h/o/web

commits              2  moments, on no clock
                     1  h/o/api
                     1  h/o/web

reaction      n 2, fewer than 12: no quartiles
              1 of 3 prompts followed no new answer
interval      n 1, fewer than 12: no quartiles
                   n/a  n     1  h/o/api
                   n/a  n     1  h/o/web

coverage      12 observations, 1 gap markers on no clock
              1 copied from another history with the copy's time, on no clock
              1 without a repository
              1 prompts not sent by a person, on the agent clock only
              3 of 3 prompts have a repository
source        codex a .. b
"""


def test_report_of_a_period_and_of_nothing(spark):
    text = X.report_of(observations(spark), M.between("2024-01-02", "2024-01-03"), OFFSET)
    assert "sum of days, each by itself" in text and "  per active day  14m over 1" in text and "  per day         7m over 2" in text and "unassigned" in text
    empty = X.report_of(observations(spark).limit(0), DAY, OFFSET, within=False)
    assert "no source was observed in this day" in empty and "reaction      n 0, fewer than 12: no quartiles" in empty and "commits              0" in empty
    assert X.distribution({"n": 12, "p25": 5, "median": 61, "p75": 3_661}) == "n 12, quartiles 5s / 1m01s / 1h01m01s"


def test_log_of_a_day(spark):
    text = X.log_of(observations(spark), DAY, OFFSET, RULES)
    assert text == """\
2024-01-02  UTC+09:00  [1704121200, 1704207600)

strip         a cell is 10 min; ▁▂▃▄▅▆▇█ up to 4, the busiest cell of one repository; ^ a person's prompt
        09    10    11
api     █                      2p  claude-code
        ^
web     ▄           ▂          1p  codex
                    ^
(none)  ▂                      0p  codex
all     █           ▂          3p  claude-code+codex

repositories
  api     h/o/api  core
  web     h/o/web  unassigned
  (none)  (none)   n/a

blocks        2; their attention does not add up to the day's

09:00-09:03      4m elapsed      8m attention     2 prompts  claude-code+codex
  more attention than elapsed, as a prompt's window reaches beyond the block
  one stretch over 2 repositories
    api         8m  100.0%     2 prompts       4 observations
    web         0m    0.0%     0 prompts       2 observations
    (none)      0m    0.0%     0 prompts       1 observations
    commits  api 1
    tools  (no family) 1, shell 1

11:00            0m elapsed      6m attention     1 prompts  codex
  more attention than elapsed, as a prompt's window reaches beyond the block
    web         6m  100.0%     1 prompts       1 observations

1 commits outside every block
"""
    full = X.log_of(observations(spark), DAY, OFFSET, RULES, full=True)
    assert "coverage      12 observations" in full and "strip " in full
    assert "nothing in this window reached a cell" in X.log_of(observations(spark).limit(0), DAY, OFFSET)


def test_strip_keeps_every_hour():
    assert X.ruler(0, 11, 600) == "00    01" and X.ruler(0, 7, 1_800) == "00  02" and X.ruler(8, 13, 3_600) == "08 11"
    from tidemark.plans.render import active_cells, strip_width

    assert active_cells(9 * 3600 + 5, 11 * 3600, 600) == (54, 71) and active_cells(0, 86_399, 1_800) == (0, 47)
    assert strip_width(0, 86_399, 40) == 1_800 and strip_width(0, 86_399, 95) == 3_600 and strip_width(0, 3_599, 40) == 600


def test_import_and_archive_texts():
    rows = [Row(section="created", item="tool.started", n=2), Row(section="already_present", item=None, n=3), Row(section="unmapped_kind", item="mode", n=4), Row(section="skipped", item=None, n=1),
            Row(section="payload_oversize", item=None, n=5), Row(section="inherited", item=None, n=0)]
    scans = [Row(outcome="collected", commits=7, truncated=True), Row(outcome="missing", commits=0, truncated=False)]
    assert X.import_text(rows, {"files scanned": 9}, True, scans) == """\
dry run, nothing written
files scanned           9
would be created
  tool.started          2
already present         3
skipped, understood
  -                     1
gap: unmapped_kind
  mode                  4
gap: payload_oversize   5
repositories            2, read 1, commits 7, cut short 1
  missing               1
"""
    assert X.import_text([]) == "created\n  0\nalready present         0\n"
    assert X.archive_text(Row(scanned=3, archived=1, unchanged=1, failed=1, bytes=10), True) == "dry run, nothing written\nscanned     3\narchived    1\nunchanged   1\nfailed      1\nbytes       10\n"


def test_archive_report_and_lines_after(spark):
    found = spark.createDataFrame([("k", "a", bytearray(b"1\n2\n3\n"), "o1"), ("k", "b", bytearray(b"1\n2\n3\n"), "o1"), ("k", "c", bytearray(b"x\n"), "o2")], "kind string, locator string, content binary, object_id string")
    none = spark.createDataFrame([], "locator string, object_id string")
    _, _, outcome = S.archive(found, spark.createDataFrame([], "object_id string, content binary"), none)
    assert S.archive_report(found, outcome, 2).first().asDict() == {"scanned": 5, "archived": 3, "unchanged": 0, "failed": 2, "bytes": 8}
    snaps = found.selectExpr("locator", "cast(1 as bigint) snapshot_id", "content")
    starts = spark.createDataFrame([("a", 2), ("c", 0)], "locator string, start_line int")
    assert {(r.locator, r.line_no, r.line) for r in S.lines_after(snaps, starts).collect()} == {("a", 3, "3"), ("c", 1, "x")}


def test_snapshots(spark):
    snaps = spark.createDataFrame([(1, "k", "a_1", "sha256:x", 5), (2, "k", "ab1", None, 6), (3, "m", "a_1", "o", None)], "snapshot_id bigint, kind string, locator string, object_id string, acquired_at int")
    assert [r.snapshot_id for r in find(snaps, prefix="a_").collect()] == [1, 3] and [r.snapshot_id for r in find(snaps, "k", start=F_lit(5), end=F_lit(6)).collect()] == [1]
    assert [(r.snapshot_id, r.version) for r in history(snaps, "a_1").collect()] == [(1, 1), (3, 2)]
    obs = spark.createDataFrame([(1, "e"), (9, "e"), (None, "e")], "snapshot_id bigint, event_type string")
    assert [(r.snapshot_kind, r.locator) for r in with_snapshot(obs, snaps).collect()] == [("k", "a_1")]
    import hashlib

    good = "sha256:" + hashlib.sha256(b"x").hexdigest()
    objects = spark.createDataFrame([(good, bytearray(b"x")), ("sha256:bad", bytearray(b"y"))], "object_id string, content binary")
    legacy = spark.createDataFrame([(1, good), (2, "sha256:bad"), (3, "gone"), (4, None), (5, good)], "n int, object_id string")
    take, refuse = reconcile(legacy, legacy.where("n = 5"), objects, ["n"])
    assert [r.n for r in take.collect()] == [1] and {(r.n, r.problem) for r in refuse.collect()} == {(2, "object_altered"), (3, "object_missing"), (4, "object_missing")}
    assert {r.object_id: r.intact for r in read_objects(legacy.where("n < 3"), objects).collect()} == {good: True, "sha256:bad": False}


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_ledger_commits_together_and_one_writer(spark, tmp_path):
    schema = "obs_id string, dedupe_key string, ingest_seq bigint, instant bigint"
    ledger = Ledger(spark, f"{tmp_path}/l")
    snaps, marks = spark.createDataFrame([(1, "a")], "snapshot_id bigint, locator string"), spark.createDataFrame([("a", 1, 5)], "locator string, snapshot_id bigint, cursor bigint")
    rows = spark.createDataFrame([("1", "k", 1, 5)], schema)
    assert ledger.append(rows, snaps, marks) == 1 and ledger.append(rows, None, marks) == 0
    assert ledger.read().count() == 1 and ledger.beside("snapshots").count() == 1 and ledger.beside("checkpoints").count() == 2
    twice = spark.createDataFrame([("7", "x", 1, 5), ("7", "y", 2, 5)], schema)
    with pytest.raises(LedgerError):
        ledger.append(twice, snaps, marks)
    assert ledger.beside("snapshots").count() == 1 and ledger.read().count() == 1
    (tmp_path / "l/_writer").write_text("")
    with pytest.raises(LedgerError):
        ledger.append(rows)
    ledger.unlock()
    assert ledger.append(spark.createDataFrame([("8", "z", 1, 5)], schema)) == 1


def test_numbered_lines_of_split_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/big.jsonl").write_bytes(b"".join(b"line %d\r\n" % i for i in range(1, 4001)) + b"torn")
    (tmp_path / "whole.jsonl").write_bytes("é\n\nz\n".encode())
    (tmp_path / "empty.jsonl").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"x\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = S.numbered_lines(spark, f"file:{tmp_path}").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    big = {r.line_no: r.line for r in got if r.locator.endswith("big.jsonl")}
    assert big == {i: f"line {i}" for i in range(1, 4001)}
    assert sorted((r.line_no, r.line) for r in got if r.locator.endswith("whole.jsonl")) == [(1, "é"), (2, ""), (3, "z")] and not any("empty" in r.locator or "other" in r.locator for r in got)


def test_a_prompt_seen_by_both_channels_is_two_observations(spark):
    from tidemark.sources.live import hook_drafts, hook_records
    from tidemark.sources.transcripts import transcript_drafts

    at = "2024-05-01T10:00:00.000Z"
    line = '{"v": 1, "received_at": "%s", "hook_event_name": "UserPromptSubmit", "session_id": "s", "prompt_id": "u1"}' % at
    hook = hook_drafts(hook_records(spark.createDataFrame([(line,)], "value string")), "dev_1").first()
    row = (1, "f", "s", "u1", "user", at, "dev_1", None, None, False, False, '"ask"')
    cols = "row_id bigint, file_ref string, session_id string, rec_uuid string, rec_type string, ts_raw string, device_ref string, cwd string, output_tokens bigint, is_sidechain boolean, is_meta boolean, content_json string"
    transcript = transcript_drafts(spark.createDataFrame([row], cols)).first()
    assert hook.event_type == transcript.event_type == "prompt.submitted" and hook.dedupe_key != transcript.dedupe_key


def test_fingerprints(spark):
    from tidemark.operators.inventory import fingerprints, inventory

    meta = '{"type": "session_meta", "payload": {"b": 1, "a": 2, "cli_version": "1.0"}}'
    rows = [("codex", "f", 1, "{torn"), ("codex", "f", 2, meta), ("codex", "f", 3, meta.replace("1.0", "2.0")), ("codex", "g", 1, '{"type": "x"}'), ("codex", "h", 1, '{"type": "session_meta"}'),
            ("claude-code", "i", 1, '{"version": "2"}'), ("claude-code", "i", 2, '{"version": "1"}'), ("claude-code", "i", 3, "{}"), ("claude-code", "j", 1, '{"version": "2"}'), (None, None, 1, None)]
    df = spark.createDataFrame(rows, "v string, f string, o int, body string")
    assert {tuple(r) for r in fingerprints(df, "v", "f", "body", "o").collect()} == {
        ("codex", "cli=1.0;meta_keys=a,b,cli_version", 1), ("codex", "cli=?;meta_keys=none", 2), ("claude-code", "version=1,2,?", 1), ("claude-code", "version=2", 1)}
    ids = spark.createDataFrame([("k", '{"uuid": "1", "t": "x"}'), ("k", '{"t": "x"}'), ("m", '{"payload": {"t": "p"}}'), ("m", '{"payload": {"t": "q"}, "uuid": "u"}'), ("n", '{"t": 5}')], "k string, body string")
    assert {r.kind: r.stable_id for r in inventory(ids, "k", "body", ("uuid", "t"), "x").collect()} == {"k": None, "m": "t", "n": None}
