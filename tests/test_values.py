"""Driver-side values: parameters, rules, text; and scalar columns."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions import timecols as C
from tidemark.operators.conformance import commit_problems, leak_scan, tier_problems
from tidemark.operators.inventory import inventory
from tidemark.plans import params as M
from tidemark.plans import render as X
from tidemark.plans.rules import RuleError, load_rules, parse_rules, workstream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("bad", ["2026-7-26", "2026-02-30", "x", "2026-07-26T", "20260726"])
def test_bad_days(bad):
    with pytest.raises(M.ParameterError):
        M.parse_day(bad)


def test_periods():
    nine = M.parse_offset("9")
    assert M.day("2026-07-26").utc_window(nine) == (1784991600, 1785078000)
    assert M.week_ending("2026-07-26").days == 7 and M.month("2024-02").days == 29
    assert M.between("2026-07-01", "2026-07-03").label == "2026-07-01 to 2026-07-03"
    narrow = M.between("09:00", "10:30", "2026-07-26")
    assert narrow.utc_window(0)[1] - narrow.utc_window(0)[0] == 5400 and narrow.midnight(0) == M.day("2026-07-26").utc_window(0)[0]
    assert M.averages(100, M.month("2024-02"), 0) == (3, None)
    for bad in (("2026-07-03", "2026-07-01"), ("09:00", "2026-07-01"), ("10:00", "09:00"), (None, "09:00")):
        with pytest.raises(M.ParameterError):
            M.between(*bad, on="2026-07-26")
    for bad in ("24:00", "9:00", "09:60"):
        with pytest.raises(M.ParameterError):
            M.parse_time(bad)


def test_offsets():
    assert [M.parse_offset(x) for x in ("9", "-5", "5:30", "+0530", "-12", "14")] == [32400, -18000, 19800, 19800, -43200, 50400]
    for bad in ("15", "-13", "x", "5:99"):
        with pytest.raises(M.ParameterError):
            M.parse_offset(bad)


def test_rules(spark, tmp_path):
    overrides, rules = parse_rules('[[rule]]\nmatch = "a/*"\nworkstream = "A"\n[[rule]]\nmatch = "a/b"\nworkstream = "B"\n[[override]]\nworkspace = "a/c"\nworkstream = "C"\n')
    df = spark.createDataFrame([("a/b",), ("a/c",), ("b",), (None,)], "r string")
    assert [r[0] for r in df.select(workstream(F.col("r"), overrides, rules)).collect()] == ["A", "C", None, None]
    assert load_rules(str(tmp_path / "none.toml")) == ([], []) and parse_rules("") == ([], [])
    for bad in ('[[rule]]\nmatch = "a*b"\nworkstream = "x"', "[[rule]]\nmatch = 1", "other = 1", "[["):
        with pytest.raises(RuleError):
            parse_rules(bad)


def test_text():
    assert (X.hm(89), X.hm(90), X.hm(3_630), X.hm(0), X.hms(3725), X.hms(65), X.hms(9), X.share(1, 3), X.share(1, 0)) == ("1m", "2m", "1h01m", "0m", "1h02m05s", "1m05s", "9s", "33.3%", "n/a")
    assert X.clock_range(0, 59, 0) == "00:00" and X.clock_range(0, 3600, 32400) == "09:00-10:00"
    assert X.choose_bucket(3600, 10) == 600 and X.choose_bucket(86_400, 40) == 1800 and X.choose_bucket(10**7, 0) == 3600
    assert X.short_labels(["h/a/x", "h/b/x", "h/b/y", None, "y"]) == {None: "(none)", "h/a/x": "a/x", "h/b/x": "b/x", "h/b/y": "b/y", "y": "y"}
    cells = [Row(repository="h/a", cell=0, n=1, level=1), Row(repository=None, cell=1, n=1, level=8), Row(repository="h/a", cell=2, n=1, level=4)]
    assert X.strip_text(cells, 0, 2) == "a       ▁ ▄\n(none)   █ \n"
    rows = [Row(repository="r", attention_seconds=60, agent_seconds=0, prompts=1, commits=0)]
    cover = Row(observations_in_window=1, gap_markers=0, with_inherited_time=0, without_usable_time=0, without_repository=0, prompts_without_repository=0, prompts_not_anchored=0, active_days=1)
    totals = dict.fromkeys(("attention_union_seconds", "attention_naive_sum_seconds", "attention_daily_sum_seconds", "agent_union_seconds", "agent_naive_sum_seconds", "agent_daily_sum_seconds"), 60)
    assert "100.0%" in X.report_text(M.day("2026-07-26"), rows, totals, cover)


@pytest.mark.parametrize(
    ("text", "millis", "normal"),
    [
        ("2026-07-26T00:00:00.1239Z", 1785024000123, "2026-07-26T00:00:00.1239Z"),
        ("2026-07-26t09:00:00+09:00", 1785024000000, "2026-07-26T00:00:00Z"),
        ("2026-07-26T00:00:60Z", 1785024060000, "2026-07-26T00:00:60Z"),
        ("2026-02-31T00:00:00Z", 1772496000000, "2026-03-03T00:00:00Z"),
        ("2026-07-26T00:00:00", None, "2026-07-26T00:00:00"),
        ("2026-07-26", None, "2026-07-26"),
        ("2026-13-01T00:00:00Z", None, "2026-13-01T00:00:00Z"),
        ("1969-12-31T23:59:59.500Z", -500, "1969-12-31T23:59:59.500Z"),
        (None, None, None),
    ],
)
def test_rfc3339(spark, text, millis, normal):
    t = F.lit(text).cast("string")
    r = spark.range(1).select(C.epoch_millis(t).alias("m"), C.epoch_seconds(t).alias("s"), C.normal_utc(t).alias("n")).first()
    assert (r.m, r.n) == (millis, normal) and (millis is None or r.s == millis // 1000)


def test_durations(spark):
    a, b = F.lit("2026-07-26T00:00:00.5Z"), F.lit("2026-07-26T00:00:02Z")
    assert one(spark, C.duration_ms(a, b)) == 1500 and one(spark, C.duration_ms(b, a)) is None and one(spark, C.duration_ms(F.lit("x"), b)) is None


def test_scalars(spark):
    import hashlib

    assert one(spark, S.pseudonym("ses", F.lit("s1"))) == "ses_" + hashlib.sha256(b"s1").hexdigest()[:20]
    got = [one(spark, S.count_bucket(F.lit(n).cast("bigint"))) for n in (None, -1, 0, 1, 9, 10, 999, 1000, 10_000)]
    assert got == [None, None, "0", "1-9", "1-9", "10-99", "100-999", "1000-9999", "10000+"]
    assert [one(spark, S.tool_family(F.lit(n).cast("string"), S.CLAUDE_TOOLS)) for n in ("Bash", "mcp__x", "odd", None)] == ["shell", "mcp", "other", "other"]
    df = spark.createDataFrame([("/home/dev/ghq/h/o/r",), ("/home/dev/ghq/h/o/r/.worktrees/b/x",), ("/home/dev/ghq/h//o/r/sub",), ("/home/dev/ghq/h/o",), ("/home/developer/ghq/h/o/r",), (None,)], "c string")
    assert [tuple(r) for r in df.select(*S.resolve_cwd(F.col("c"))).collect()] == [("h/o/r", "h/o/r"), ("h/o/r", "h/o/r@b"), ("h/o/r", "h/o/r"), (None, None), (None, None), (None, None)]
    assert one(spark, S.repository_path(F.lit("h/o/r"))) == "/home/dev/ghq/h/o/r" and one(spark, S.repository_path(F.lit("h/../r"))) is None
    assert one(spark, S.dedupe_key(F.lit("claude-code"), F.lit("dev_7N2"), F.lit("ses_9D2F"), F.lit("tol_4CJ"), F.lit(None), F.lit("tool.started"))) == "claude-code|dev_7N2|ses_9D2F|tol_4CJ|tool.started"
    assert [one(spark, S.session_ref(F.lit(x))) for x in ("session/a/turn/b", "session/", "x")] == ["a", None, None]
    assert [one(spark, S.plausible_label(F.lit(x))) for x in ("a:b-c_1", "", "a b", "x" * 65)] == ["a:b-c_1", None, None, None]
    assert [one(spark, S.end_reason(F.lit(x).cast("string"))) for x in ("crash", "logout", None)] == ["crash", "unknown", "unknown"]


def test_event_names_of_a_namespace(spark):
    from tidemark.schema import event_name

    full = F.lit(event_name("tool.started", "own"))
    assert [one(spark, S.short_event(full, n)) for n in (None, "own", "other")] == ["tool.started", "tool.started", ""]


def test_leaks(spark):
    df = spark.createDataFrame([(1, "mail a@b.io"), (2, "sha " + "a" * 40), (3, "digest " + "a" * 64), (4, "password: x Bearer abcdefghi"), (5, None), (6, "")], "k bigint, t string")
    assert {tuple(r) for r in leak_scan(df, "k", "t").collect()} == {(1, "email"), (2, "raw_commit_sha"), (4, "password_kv"), (4, "bearer")}


def test_commits_and_tiers(spark):
    good = {"repository_ref": "rep_1", "changed_paths_count": 3, "message_ref": None}
    bad = {"author": "x", "repository_ref": "h/o/r", "message_ref": "m"}
    df = spark.createDataFrame([(1, "artifact/commit/cmt_1", json.dumps(good)), (2, "commit/1", json.dumps(bad)), (3, None, "{}")], "key bigint, subject string, data string")
    assert {tuple(r) for r in commit_problems(df).collect()} == {
        (2, "not allowed: author"), (2, "bad value: repository_ref"), (2, "not null: message_ref"), (2, "bad subject"),
        (3, "absent: message_ref"), (3, "absent: repository_ref"), (3, "bad subject"),
    }
    tiers = spark.createDataFrame([(1, "t1_structured", "c", None), (2, "t2_content", "c", None), (3, None, "c", "m")], "key bigint, privacy_class string, content_ref string, message_ref string")
    assert {tuple(r) for r in tier_problems(tiers).collect()} == {(1, "content_ref")}


def test_inventory(spark):
    df = spark.createDataFrame([("a", '{"uuid": "1", "t": "2"}'), ("a", '{"uuid": "2", "x": null, "t": "1"}'), ("b", '{"t": "9"}'), ("b", "torn"), (None, None)], "k string, body string")
    got = {r.kind: r for r in inventory(df, "k", "body", ("uuid", "t"), "t").collect()}
    assert (got["a"].n, got["a"].fields, got["a"].stable_id, got["a"].first_time) == (2, "t,uuid,x", "uuid", "1") and got["b"].stable_id == "t" and got[None].n == 2


def test_leaks_of_every_string(spark):
    from tidemark.operators.conformance import leak_scan_fields

    schema = "row_id bigint, subject string, data struct<a:string,b:array<struct<c:string>>>, m map<string,string>, n int"
    rows = [(1, "mail x@y.org from /home/me", (None, None), None, 1), (2, None, ("ok", [("/Users/me",), (None,)]), {"x@y.org": None}, 2), (3, "fine", None, {}, 3)]
    got = {tuple(r) for r in leak_scan_fields(spark.createDataFrame(rows, schema), "row_id").collect()}
    assert got == {(1, "subject", "email"), (1, "subject", "abs_home_path"), (2, "data", "abs_home_path"), (2, "m", "email")}
    assert leak_scan_fields(spark.range(2).toDF("row_id"), "row_id").count() == 0
