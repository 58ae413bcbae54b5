"""Interval, sharing and pairing operators against golden vectors and loop models."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import timeline as T
from tidemark.operators.periods import periods_and_gaps
from tidemark.plans import report as R

OBS = "instant bigint, session string, repository string, event_type string, ingest_seq bigint, tool_family string, time_basis string, origin string"


def obs(spark, rows):
    """Rows of (instant, event_type, repository[, session])."""
    return spark.createDataFrame([(r[0], r[3] if len(r) > 3 else None, r[2], r[1], i, None, None, None) for i, r in enumerate(rows)], OBS)


def anchors(spark, pairs):
    return spark.createDataFrame(pairs, "instant bigint, repository string")


def shares(spark, pairs):
    return {r.repository: r.seconds for r in T.nearest_anchor_shares(anchors(spark, pairs), []).collect()}


def totals(spark, rows, offset=0):
    return {r.metric: r.value for r in R.totals(R.routed(obs(spark, rows)), offset).collect()}


def test_merged_spans(spark):
    df = spark.createDataFrame([("a", 0, 100), ("a", 50, 150), ("b", 0, 100), ("b", 100, 200)], "repository string, span_start bigint, span_end bigint")
    assert {tuple(r) for r in periods_and_gaps(df).collect()} == {("a", "period", 0, 150), ("b", "period", 0, 200)}


@pytest.mark.parametrize(("instants", "expected"), [((0, 100, 1000), {(0, 100), (1000, 1000)}), ((0, 300), {(0, 300)}), ((0, 301), {(0, 0), (301, 301)}), ((), set())])
def test_clusters(spark, instants, expected):
    df = spark.createDataFrame([(t,) for t in instants], "instant bigint")
    assert {(r.start, r.end) for r in T.clusters(df, []).collect()} == expected


@pytest.mark.parametrize(
    ("pairs", "expected"),
    [
        ([(0, "a"), (200, "b")], {"a": 200, "b": 360}),
        ([(-20, "v"), (0, "x"), (360, "y")], {"v": 20, "x": 360, "y": 360}),
        ([(0, "a"), (0, "b")], {"a": 360}),
        ([(0, "b"), (0, "a"), (0, None)], {None: 360}),
        ([(3600, "api"), (3720, "web"), (3840, "docs")], {"api": 120, "web": 120, "docs": 360}),
        ([(None, "a")], {}),
    ],
)
def test_shares(spark, pairs, expected):
    assert shares(spark, pairs) == expected


def loop_shares(pairs, before=60, after=300):
    edges = sorted({e for t, _ in pairs for e in (t - before, t + after)})
    out = {}
    for lo, hi in zip(edges, edges[1:]):
        cover = [(abs(lo + hi - 2 * t), x is not None, x or "", x) for t, x in pairs if t - before <= lo and hi <= t + after]
        if cover:
            label = min(cover)[3]
            out[label] = out.get(label, 0) + hi - lo
    return out


def test_shares_sum_to_the_union(spark):
    random.seed(11)
    for spread in (600, 90_000, 400_000):
        pairs = [(random.randrange(-spread, spread), random.choice(["a", "b", None, "c"])) for _ in range(250)]
        got = shares(spark, pairs)
        assert got == loop_shares(pairs)
        union = T.window_union(anchors(spark, pairs), []).agg(F.sum(F.col("end") - F.col("start"))).first()[0]
        assert sum(got.values()) == union


def test_report_totals(spark):
    p = "prompt.submitted"
    t = totals(spark, [(3600, p, "api"), (3720, p, "web"), (3840, p, "docs")])
    assert (t["attention_union_seconds"], t["attention_naive_sum_seconds"]) == (600, 1080)
    a = "tool.started"
    t = totals(spark, [(s, a, "api") for s in (3600, 3700, 4300, 4400)] + [(s, a, "web") for s in (3950, 4050)])
    assert (t["agent_union_seconds"], t["agent_naive_sum_seconds"]) == (800, 300)
    t = totals(spark, [(86280, p, "x"), (86520, p, "x"), (86340, a, "x"), (86460, a, "x")])
    assert (t["attention_union_seconds"], t["attention_daily_sum_seconds"], t["agent_union_seconds"], t["agent_daily_sum_seconds"]) == (600, 720, 120, 0)


def test_routes_and_coverage(spark):
    rows = [
        (5, "source.gap", "copied_at", None, "r"), (None, "source.gap", None, None, None), (5, "prompt.submitted", "copied_at", None, "r"),
        (5, "prompt.submitted", "strange", None, "r"), (None, "prompt.submitted", None, None, "r"), (5, "commit.observed", None, None, None),
        (5, "prompt.submitted", None, None, None), (5, "prompt.submitted", "received_at", "human", "r"), (5, "prompt.submitted", None, "subagent", "r"),
        (5, "prompt.submitted", None, "scheduled", "r"), (90_000, "tool.started", "occurred_at", "subagent", None),
    ]
    df = spark.createDataFrame([(t, None, r, e, i, None, b, o) for i, (t, e, b, o, r) in enumerate(rows)], OBS)
    routed = R.routed(df)
    got = [r.route for r in routed.orderBy("ingest_seq").collect()]
    assert got == ["gap", "gap", "inherited", "inherited", "unusable", "commit", "anchor", "anchor", "agent", "agent", "agent"]
    c = R.coverage(routed).first()
    assert tuple(c) == (11, 2, 2, 1, 2, 1, 2, 2)
    assert tuple(R.coverage(routed.limit(0)).first()) == (0,) * 8


def test_period_keeps_unplaceable_rows_by_text(spark):
    df = spark.createDataFrame([(10, "1970-01-01T00:00:10Z"), (None, "1970-01-01T99"), (None, "1980"), (10**9, "1970-01-01T00:00:20Z")], "instant bigint, occurred_at string")
    assert sorted(r.occurred_at for r in R.within(df, 0, 86_400, "occurred_at").collect()) == ["1970-01-01T00:00:10Z", "1970-01-01T99"]


def pairs_of(spark, rows):
    df = R.routed(obs(spark, rows))
    return R.response_gaps(df)


def test_a_later_completion_supersedes(spark):
    rows = []
    for c in range(12):
        base = c * 100_000
        rows += [(base, "response.completed", "r", "s"), (base + 600, "response.completed", "r", "s"), (base + 700, "prompt.submitted", "r", "s")]
    got = pairs_of(spark, rows).collect()
    assert [r.response_gap for r in got] == [100] * 12
    q = R.quartiles(pairs_of(spark, rows), ["repository"], "response_gap").first()
    assert (q.n, q.p25, q.median, q.p75) == (12, 100, 100, 100)


def test_back_to_back_and_sessions_apart(spark):
    rows = []
    for c in range(12):
        rows += [(c * 1000, "response.completed", "r", "a"), (c * 1000 + 5, "prompt.submitted", "r", "a"), (c * 1000 + 7, "prompt.submitted", "r", "b")]
    got = pairs_of(spark, rows).collect()
    assert sum(r.response_gap is not None for r in got) == 12 and all(r.response_gap is None for r in got if r.session == "b")
    assert sum(r.interval is not None for r in got) == 22
    tie = pairs_of(spark, [(5, "response.completed", "r", "s"), (5, "prompt.submitted", "r", "s"), (5, "prompt.submitted", "r", "s")]).orderBy("ingest_seq").collect()
    assert [r.response_gap for r in tie] == [0, None]


def test_pairs_carry_over_days(spark):
    random.seed(2)
    rows = [(random.randrange(0, 40 * 86_400), random.choice(["response.completed", "prompt.submitted"]), "r", random.choice("xy")) for _ in range(300)]
    expected = {}
    for s in "xy":
        last = None
        for t, i, e in sorted((t, i, e) for i, (t, e, _, x) in enumerate(rows) if x == s):
            if e == "prompt.submitted":
                expected[i] = t - last[0] if last and last[1] == "response.completed" else None
            last = (t, e)
    assert {r.ingest_seq: r.response_gap for r in pairs_of(spark, rows).collect()} == expected


def test_quartiles(spark):
    df = spark.createDataFrame([("a", g) for g in [*range(3, 9), *range(1000, 1006)]] + [("few", 1), ("none", None)], "k string, g bigint")
    got = {r.k: tuple(r)[1:] for r in R.quartiles(df, ["k"], "g").collect()}
    assert got == {"a": (12, 5, 8, 1002), "few": (1, None, None, None), "none": (0, None, None, None)}


def test_blocks_and_commits(spark):
    rows = [(3600, "prompt.submitted", "api"), (3660, "tool.started", "api"), (3720, "tool.started", "api"), (3700, "commit.observed", "api"), (20_000, "commit.observed", "api"), (9000, "tool.started", None)]
    routed = R.routed(obs(spark, rows))
    assert {(r.block, r.repository, r.observations, r.prompts) for r in R.block_parts(routed).collect()} == {(3600, "api", 3, 1), (9000, None, 1, 0)}
    assert {(r.block, r.commits) for r in R.block_commits(routed).collect()} == {(3600, 1), (None, 1)}


def test_labelled_clusters_across_days(spark):
    random.seed(9)
    at = sorted(random.randrange(0, 500_000) for _ in range(2500))
    df = spark.createDataFrame([(t,) for t in at] + [(None,)], "instant bigint")
    got = {r.instant: r.block for r in T.labelled_clusters(df, []).collect()}
    start, last = None, None
    for t in at:
        start = t if last is None or t - last > 300 else start
        last = t
        assert got[t] == start
    assert got[None] is None


def test_density(spark):
    df = spark.createDataFrame([(0, 10), (1, 1000), (10, 10), (5, 10), (3, 0)], "n bigint, peak bigint")
    assert [r[0] for r in df.select(R.density(F.col("n"), F.col("peak"))).collect()] == [0, 1, 8, 4, 0]
