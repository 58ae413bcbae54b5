"""Queries of the report and the day log over the whole events table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import timeline as T
from tidemark.plans import report as R
from tidemark.plans.rules import parse_rules, workstream
from tidemark.sources.events import EVENTS_SQL, events_as_observations

OFFSET = 9 * 3600
RULES = parse_rules("""
[[override]]
workspace = "repo/3"
workstream = "special"
[[rule]]
match = "repo/0"
workstream = "low"
[[rule]]
match = "repo/1"
workstream = "low"
[[rule]]
match = "repo/2"
workstream = "low"
[[rule]]
match = "repo/3*"
workstream = "never, as an override comes first"
[[rule]]
match = "repo/5*"
workstream = "five"
""")


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return R.routed(events_as_observations(spark, d))


def route_counts(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


def coverage_counters(spark: SparkSession, d: str) -> DataFrame:
    return R.coverage(_rows(spark, d), OFFSET)


def attention_spans(spark: SparkSession, d: str) -> DataFrame:
    return T.window_union(R.only(_rows(spark, d), "anchor"), []).withColumnsRenamed({"start": "from_s", "end": "to_s"})


def agent_clusters(spark: SparkSession, d: str) -> DataFrame:
    return T.clusters(R.only(_rows(spark, d), "agent"), []).withColumnsRenamed({"start": "from_s", "end": "to_s"})


def attention_shares(spark: SparkSession, d: str) -> DataFrame:
    return T.nearest_anchor_shares(R.only(_rows(spark, d), "anchor"), [])


def report_repositories(spark: SparkSession, d: str) -> DataFrame:
    return R.repository_rows(_rows(spark, d))


def report_totals(spark: SparkSession, d: str) -> DataFrame:
    return R.totals(_rows(spark, d), OFFSET)


def report_daily(spark: SparkSession, d: str) -> DataFrame:
    return R.daily(_rows(spark, d), OFFSET)


def response_pairs(spark: SparkSession, d: str) -> DataFrame:
    return R.response_gaps(_rows(spark, d))


def response_quartiles(spark: SparkSession, d: str) -> DataFrame:
    return R.quartiles(R.response_gaps(_rows(spark, d)), ["repository"], "response_gap")


def workstream_rollup(spark: SparkSession, d: str) -> DataFrame:
    return R.workstreams(R.repository_rows(_rows(spark, d)), workstream(F.col("repository"), *RULES))


def log_block_parts(spark: SparkSession, d: str) -> DataFrame:
    return R.block_parts(_rows(spark, d))


def log_block_attention(spark: SparkSession, d: str) -> DataFrame:
    return R.block_attention(_rows(spark, d))


def log_block_tools(spark: SparkSession, d: str) -> DataFrame:
    return R.block_tools(_rows(spark, d))


def log_block_commits(spark: SparkSession, d: str) -> DataFrame:
    return R.block_commits(_rows(spark, d))


def log_strip(spark: SparkSession, d: str) -> DataFrame:
    return R.strip(_rows(spark, d), -OFFSET, 3600)


def log_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Every block with its attention, vendors and number of repositories."""
    return R.block_rows(_rows(spark, d))


def log_day_strips(spark: SparkSession, d: str) -> DataFrame:
    """The whole strip of every local day, the row of all repositories too."""
    return R.day_strips(_rows(spark, d), OFFSET, 1800)


def ordered_repositories(spark: SparkSession, d: str) -> DataFrame:
    """Repositories in report order."""
    return R.repository_places(R.repository_rows(_rows(spark, d))).select("place", "repository")


def ordered_reactions(spark: SparkSession, d: str) -> DataFrame:
    """Reaction rows in report order."""
    return R.reaction_places(response_quartiles(spark, d)).select("place", "repository", "n")


def ordered_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of every block in order."""
    return R.part_places(R.block_parts(_rows(spark, d))).select("block", "place", "repository", "observations")


def ordered_tools(spark: SparkSession, d: str) -> DataFrame:
    """Tools of every block in order."""
    return R.tool_places(R.block_tools(_rows(spark, d))).select("block", "place", "tool_family", "n")


def ordered_commits(spark: SparkSession, d: str) -> DataFrame:
    """Commits of every block in order of number and label."""
    return R.commit_places(R.block_commits(_rows(spark, d)), F.coalesce("repository", F.lit("(none)"))).select("block", "place", "repository", "commits")


QUERIES = {
    f.__name__: f
    for f in (
        route_counts, coverage_counters, attention_spans, agent_clusters, attention_shares, report_repositories, report_totals,
        report_daily, response_pairs, response_quartiles, workstream_rollup, log_block_parts, log_block_attention, log_block_tools,
        log_block_commits, log_strip, log_blocks, log_day_strips, ordered_repositories, ordered_reactions, ordered_parts, ordered_tools, ordered_commits,
    )
}


def _islands(name: str, source: str, by: str, gap: int, before: int = 0, after: int = 0) -> str:
    """SQL of merged stretches of instants; ``by`` is a column list or empty."""
    part = f"PARTITION BY {by} " if by else ""
    cols = f"{by}, " if by else ""
    return f""", {name}_1 AS (SELECT *, lag(instant) OVER ({part}ORDER BY instant) AS prev FROM {source}),
{name}_2 AS (SELECT *, sum(CASE WHEN instant - prev > {gap} THEN 1 ELSE 0 END) OVER ({part}ORDER BY instant ROWS UNBOUNDED PRECEDING) AS k FROM {name}_1),
{name} AS (SELECT {cols}min(instant) - {before} AS from_s, max(instant) + {after} AS to_s, count(*) AS n FROM {name}_2 GROUP BY {cols}k)"""


_ANCHORS = EVENTS_SQL + f""", anchors AS (SELECT *, (instant + {OFFSET}) // 86400 AS local_day FROM routed WHERE route = 'anchor'),
agents AS (SELECT *, (instant + {OFFSET}) // 86400 AS local_day FROM routed WHERE route = 'agent'),
live AS (SELECT * FROM routed WHERE route IN ('anchor', 'agent'))"""
_BLOCKS = _ANCHORS + """, b1 AS (SELECT *, lag(instant) OVER (ORDER BY instant) AS prev FROM live),
b2 AS (SELECT *, sum(CASE WHEN instant - prev > 300 THEN 1 ELSE 0 END) OVER (ORDER BY instant ROWS UNBOUNDED PRECEDING) AS k FROM b1),
b3 AS (SELECT *, min(instant) OVER (PARTITION BY k) AS block FROM b2)"""


def _shares(by: str = "") -> str:
    """SQL of nearest-anchor shares of the view ``shared`` (instant, repository and ``by``)."""
    cols = f"{by}, " if by else ""
    also = f"AND p.{by} = a.{by}" if by else ""
    part = f"PARTITION BY {by} " if by else ""
    picked = f"p.{by}, " if by else ""
    return f""", one AS (SELECT DISTINCT {cols}instant, repository FROM shared),
edges AS (SELECT {cols}instant - 60 AS e FROM one UNION SELECT {cols}instant + 300 FROM one),
pieces AS (SELECT *, lead(e) OVER ({part}ORDER BY e) AS hi FROM edges),
cand AS (SELECT {picked}p.e, p.hi, a.repository, row_number() OVER (PARTITION BY {picked}p.e ORDER BY abs(p.e + p.hi - 2 * a.instant), a.repository NULLS FIRST) AS r
         FROM pieces p JOIN one a ON a.instant - 60 <= p.e AND p.hi <= a.instant + 300 {also}),
shares AS (SELECT {cols}repository, CAST(sum(hi - e) AS BIGINT) AS seconds FROM cand WHERE r = 1 GROUP BY {cols}repository)"""


def _total(name: str, metric: str) -> str:
    return f"SELECT '{metric}' AS metric, CAST(coalesce(sum(to_s - from_s), 0) AS BIGINT) AS value FROM {name}"


_REPOSITORY = (
    _ANCHORS + ", shared AS (SELECT instant, repository FROM anchors)" + _shares()
    + _islands("alone", "anchors", "repository", 360, 60, 300) + _islands("ag", "agents", "repository", 300)
    + """, u AS (SELECT repository, seconds AS a, 0 AS b, 0 AS c, 0 AS p, 0 AS m FROM shares
      UNION ALL SELECT repository, 0, to_s - from_s, 0, 0, 0 FROM alone UNION ALL SELECT repository, 0, 0, to_s - from_s, 0, 0 FROM ag
      UNION ALL SELECT repository, 0, 0, 0, 1, 0 FROM anchors UNION ALL SELECT repository, 0, 0, 0, 0, 1 FROM routed WHERE route = 'commit'),
repositories AS (SELECT repository, CAST(sum(a) AS BIGINT) AS attention_seconds, CAST(sum(b) AS BIGINT) AS attention_alone_seconds,
  CAST(sum(c) AS BIGINT) AS agent_seconds, CAST(sum(p) AS BIGINT) AS prompts, CAST(sum(m) AS BIGINT) AS commits FROM u GROUP BY repository)"""
)
_PAIRS = _ANCHORS + """, seq AS (SELECT *, route = 'anchor' AS is_prompt FROM routed
    WHERE route = 'anchor' OR (route = 'agent' AND event_type = 'response.completed')),
w AS (SELECT *, lag(is_prompt) OVER s AS pp, lag(instant) OVER s AS pi FROM seq WINDOW s AS (PARTITION BY session ORDER BY instant, ingest_seq)),
pairs AS (SELECT session, ingest_seq, repository, instant, CASE WHEN NOT pp THEN instant - pi END AS response_gap,
    instant - lag(instant) OVER (PARTITION BY session ORDER BY instant, ingest_seq) AS interval FROM w WHERE is_prompt)"""

SQL = {
    "route_counts": EVENTS_SQL + " SELECT route, count(*) AS n FROM routed GROUP BY route",
    "coverage_counters": EVENTS_SQL + f""" SELECT count(*) AS observations_in_window, count(*) FILTER (route = 'gap') AS gap_markers,
        count(*) FILTER (route = 'inherited') AS with_inherited_time, count(*) FILTER (route = 'unusable') AS without_usable_time,
        count(*) FILTER (route IN ('anchor','agent') AND repository IS NULL) AS without_repository,
        count(*) FILTER (route = 'anchor' AND repository IS NULL) AS prompts_without_repository,
        count(*) FILTER (route = 'agent' AND event_type = 'prompt.submitted') AS prompts_not_anchored,
        count(DISTINCT CASE WHEN route IN ('anchor','agent') THEN (instant + {OFFSET}) // 86400 END) AS active_days FROM routed""",
    "attention_spans": _ANCHORS + _islands("w", "anchors", "", 360, 60, 300) + " SELECT from_s, to_s FROM w",
    "agent_clusters": _ANCHORS + _islands("w", "agents", "", 300) + " SELECT from_s, to_s, n FROM w",
    "attention_shares": _ANCHORS + ", shared AS (SELECT instant, repository FROM anchors)" + _shares() + " SELECT * FROM shares",
    "report_repositories": _REPOSITORY + " SELECT * FROM repositories",
    "report_totals": _ANCHORS + _islands("w1", "anchors", "", 360, 60, 300) + _islands("w2", "anchors", "repository", 360, 60, 300)
    + _islands("w3", "anchors", "local_day", 360, 60, 300) + _islands("c1", "agents", "", 300) + _islands("c2", "agents", "repository", 300)
    + _islands("c3", "agents", "local_day", 300) + " "
    + " UNION ALL ".join(_total(a, b) for a, b in (("w1", "attention_union_seconds"), ("w2", "attention_naive_sum_seconds"),
        ("w3", "attention_daily_sum_seconds"), ("c1", "agent_union_seconds"), ("c2", "agent_naive_sum_seconds"), ("c3", "agent_daily_sum_seconds"))),
    "report_daily": _ANCHORS + _islands("w", "anchors", "local_day", 360, 60, 300) + _islands("c", "agents", "local_day", 300)
    + """, u AS (SELECT local_day, to_s - from_s AS a, 0 AS g FROM w UNION ALL SELECT local_day, 0, to_s - from_s FROM c)
      SELECT local_day, CAST(sum(a) AS BIGINT) AS attention_seconds, CAST(sum(g) AS BIGINT) AS agent_seconds FROM u GROUP BY local_day""",
    "response_pairs": _PAIRS + " SELECT * FROM pairs",
    "response_quartiles": _PAIRS + """ SELECT repository, count(response_gap) AS n,
        CASE WHEN count(response_gap) >= 12 THEN quantile_disc(response_gap, 0.25) END AS p25,
        CASE WHEN count(response_gap) >= 12 THEN quantile_disc(response_gap, 0.5) END AS median,
        CASE WHEN count(response_gap) >= 12 THEN quantile_disc(response_gap, 0.75) END AS p75 FROM pairs GROUP BY repository""",
    "workstream_rollup": _REPOSITORY + """ SELECT CASE WHEN repository = 'repo/3' THEN 'special' WHEN repository IN ('repo/0','repo/1','repo/2') THEN 'low'
        WHEN starts_with(repository, 'repo/5') THEN 'five' END AS workstream, CAST(sum(attention_seconds) AS BIGINT) AS attention_seconds,
        CAST(sum(agent_seconds) AS BIGINT) AS agent_seconds, CAST(sum(prompts) AS BIGINT) AS prompts,
        string_agg(repository, ',' ORDER BY repository) AS repositories FROM repositories WHERE repository IS NOT NULL GROUP BY 1""",
    "log_block_parts": _BLOCKS + """ SELECT block, repository, count(*) AS observations, count(*) FILTER (route = 'anchor') AS prompts
        FROM b3 GROUP BY block, repository""",
    "log_block_attention": _BLOCKS + ", shared AS (SELECT block, instant, repository FROM b3 WHERE route = 'anchor')" + _shares("block")
    + " SELECT * FROM shares",
    "log_block_tools": _BLOCKS + " SELECT block, tool_family, count(*) AS n FROM b3 WHERE event_type = 'tool.started' GROUP BY block, tool_family",
    "log_block_commits": _BLOCKS + """, spans AS (SELECT block, max(instant) AS last FROM b3 GROUP BY block)
        SELECT s.block, c.repository, count(*) AS commits FROM (SELECT * FROM routed WHERE route = 'commit') c
        LEFT JOIN spans s ON c.instant >= s.block AND c.instant <= s.last GROUP BY s.block, c.repository""",
    "log_strip": _ANCHORS + f""", c AS (SELECT repository, (instant + {OFFSET}) // 3600 AS cell, count(*) AS n FROM live GROUP BY 1, 2),
        p AS (SELECT max(n) AS peak FROM c)
        SELECT repository, cell, n, CAST(greatest(1, least(8, (16 * n + peak) // (2 * peak))) AS INTEGER) AS level FROM c, p""",
    "log_blocks": _BLOCKS + ", ab AS (SELECT block, instant FROM b3 WHERE route = 'anchor')" + _islands("aw", "ab", "block", 360, 60, 300)
    + """, att AS (SELECT block, CAST(sum(to_s - from_s) AS BIGINT) AS s FROM aw GROUP BY block)
        SELECT b3.block, max(instant) AS last, count(*) AS observations, count(*) FILTER (route = 'anchor') AS prompts, coalesce(any_value(att.s), 0) AS attention_seconds,
        count(DISTINCT repository) AS named_repositories, array_to_string(list_sort(list_distinct(list(source_kind))), '+') AS vendors FROM b3 LEFT JOIN att USING (block) GROUP BY b3.block""",
    "log_day_strips": _ANCHORS + f""", c AS (SELECT (instant + {OFFSET}) // 86400 AS local_day, repository, ((instant + {OFFSET}) % 86400) // 1800 AS cell, count(*) AS n,
          count(*) FILTER (route = 'anchor') AS prompts FROM live GROUP BY ALL),
        d AS (SELECT local_day, repository, min(cell) AS a, max(cell) AS b FROM c GROUP BY local_day, repository),
        s AS (SELECT local_day, repository, min(a) OVER w AS a, max(b) OVER w AS b FROM d WINDOW w AS (PARTITION BY local_day)),
        g AS (SELECT local_day, repository, unnest(range(a - a % 2, least(b + 1 - b % 2, 47) + 1)) AS cell FROM s),
        e AS (SELECT local_day, repository, cell, CAST(sum(n) AS BIGINT) AS n, CAST(sum(prompts) AS BIGINT) AS prompts
          FROM (SELECT local_day, repository, cell, n, prompts FROM c UNION ALL SELECT local_day, repository, cell, 0, 0 FROM g) GROUP BY local_day, repository, cell),
        f AS (SELECT *, max(n) OVER (PARTITION BY local_day) AS peak FROM e),
        u AS (SELECT local_day, 'repository' AS row_kind, repository, cell, n, prompts, peak FROM f
          UNION ALL SELECT local_day, 'all', NULL, cell, CAST(sum(n) AS BIGINT), CAST(sum(prompts) AS BIGINT), any_value(peak) FROM f GROUP BY local_day, cell)
        SELECT local_day, row_kind, repository, cell, n, prompts, CASE WHEN n = 0 THEN 0 ELSE CAST(greatest(1, least(8, (16 * n + peak) // (2 * peak))) AS INTEGER) END AS level FROM u""",
    "ordered_repositories": _REPOSITORY + """ SELECT CAST(row_number() OVER (ORDER BY attention_seconds DESC, agent_seconds DESC, repository) AS INTEGER) AS place, repository
        FROM repositories WHERE repository IS NOT NULL""",
    "ordered_reactions": _PAIRS + """, r AS (SELECT repository, count(response_gap) AS n FROM pairs GROUP BY repository)
        SELECT CAST(row_number() OVER (ORDER BY repository IS NULL, n DESC, repository) AS INTEGER) AS place, repository, n FROM r""",
    "ordered_parts": _BLOCKS + """, p AS (SELECT block, repository, count(*) AS observations FROM b3 GROUP BY block, repository)
        SELECT block, CAST(row_number() OVER (PARTITION BY block ORDER BY observations DESC, repository IS NULL, repository) AS INTEGER) AS place, repository, observations FROM p""",
    "ordered_tools": _BLOCKS + """, p AS (SELECT block, tool_family, count(*) AS n FROM b3 WHERE event_type = 'tool.started' GROUP BY block, tool_family)
        SELECT block, CAST(row_number() OVER (PARTITION BY block ORDER BY n DESC, tool_family NULLS FIRST) AS INTEGER) AS place, tool_family, n FROM p""",
    "ordered_commits": _BLOCKS + """, spans AS (SELECT block, max(instant) AS last FROM b3 GROUP BY block),
        p AS (SELECT s.block, c.repository, count(*) AS commits FROM (SELECT * FROM routed WHERE route = 'commit') c
        LEFT JOIN spans s ON c.instant >= s.block AND c.instant <= s.last GROUP BY s.block, c.repository)
        SELECT block, CAST(row_number() OVER (PARTITION BY block ORDER BY commits DESC, coalesce(repository, '(none)')) AS INTEGER) AS place, repository, commits FROM p""",
}
