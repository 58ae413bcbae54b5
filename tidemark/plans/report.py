"""Routing of observations and the frames of a period report and a day log."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import timeline as T
from tidemark.scratch import Scratch
from tidemark.schema import AFTER, BEFORE, COMMIT, DAY, DENIED_ORIGINS, GAP, LEAST_MEASURED, LIVE_BASES, PROMPT, RESPONSE, TOOL_STARTED


def within(obs: DataFrame, start: int, end: int, text: str | None = None) -> DataFrame:
    """Rows of the half-open period by instant; with ``text``, also rows without an instant whose text sorts into it.

    The text bounds are widened by a day, since text order is not time order; the instant decides.
    """
    exact = (F.col("instant") >= start) & (F.col("instant") < end)
    if text is None:
        return obs.where(exact)
    bound = lambda s: F.date_format(F.timestamp_seconds(F.lit(s)), "yyyy-MM-dd'T'HH:mm:ss")
    rough = (F.col(text) >= bound(start - DAY)) & (F.col(text) < bound(end + DAY))
    return obs.where(rough & (exact | F.col("instant").isNull()))


def routed(obs: DataFrame) -> DataFrame:
    """``obs`` plus ``route``, the first that applies: gap, inherited, unusable, commit, anchor, agent.

    A null time basis or origin is admitted, and an unknown time basis is not.
    """
    live = F.col("time_basis").isNull() | F.col("time_basis").isin(*LIVE_BASES)
    denied = F.coalesce(F.col("origin").isin(*DENIED_ORIGINS), F.lit(False))
    route = (
        F.when(F.col("event_type") == GAP, "gap").when(~live, "inherited").when(F.col("instant").isNull(), "unusable")
        .when(F.col("event_type") == COMMIT, "commit").when((F.col("event_type") == PROMPT) & ~denied, "anchor").otherwise("agent")
    )
    return obs.withColumn("route", route)


def only(rows: DataFrame, *routes: str) -> DataFrame:
    """Rows of the named routes."""
    return rows.where(F.col("route").isin(*routes))


def local_day(offset: int, t: str = "instant") -> Column:
    """Day number at a fixed offset in seconds."""
    return F.floor((F.col(t) + offset) / F.lit(DAY)).cast("bigint")


def coverage(rows: DataFrame, offset: int = 0) -> DataFrame:
    """One row of the report's counters."""
    on_clock = F.col("route").isin("anchor", "agent")
    no_repository = F.col("repository").isNull()
    return rows.agg(
        F.count(F.lit(1)).alias("observations_in_window"),
        F.count_if(F.col("route") == "gap").alias("gap_markers"),
        F.count_if(F.col("route") == "inherited").alias("with_inherited_time"),
        F.count_if(F.col("route") == "unusable").alias("without_usable_time"),
        F.count_if(on_clock & no_repository).alias("without_repository"),
        F.count_if((F.col("route") == "anchor") & no_repository).alias("prompts_without_repository"),
        F.count_if((F.col("route") == "agent") & (F.col("event_type") == PROMPT)).alias("prompts_not_anchored"),
        F.count_distinct(F.when(on_clock, local_day(offset))).alias("active_days"),
    )


def routed_seconds(rows: DataFrame) -> DataFrame:
    """``route, repository, instant, n`` of anchors, agents and commits, written once.

    What the clocks and counts of a report need, combined before the shuffle: at most one row per second,
    repository and route, however many observations fall into it. All metrics then read this table.
    """
    live = only(rows, "anchor", "agent", "commit").groupBy("route", "repository", "instant").agg(F.count(F.lit(1)).alias("n"))
    return Scratch(rows.sparkSession).cut(live, "seconds")


def repository_rows(rows: DataFrame) -> DataFrame:
    """Per repository (null: unattributed): attention share, attention and agent time alone, prompts, commits."""
    live = routed_seconds(rows)
    anchors, agents, commits = (only(live, r) for r in ("anchor", "agent", "commit"))
    by = ["repository"]
    parts = [
        (T.nearest_anchor_shares(anchors, []).withColumnRenamed("seconds", "attention_seconds"), "attention_seconds"),
        (T.seconds(T.window_union(anchors, by), by, "attention_alone_seconds"), "attention_alone_seconds"),
        (T.seconds(T.clusters(agents, by), by, "agent_seconds"), "agent_seconds"),
        (anchors.groupBy(*by).agg(F.sum("n").alias("prompts")), "prompts"),
        (commits.groupBy(*by).agg(F.sum("n").alias("commits")), "commits"),
    ]
    names = [n for _, n in parts]
    zero = lambda df, name: df.select("repository", *[(F.col(n) if n == name else F.lit(0).cast("bigint")).alias(n) for n in names])
    return reduce(DataFrame.unionByName, [zero(df, n) for df, n in parts]).groupBy(*by).agg(*[F.sum(n).alias(n) for n in names])


def in_report_order(repositories: DataFrame) -> DataFrame:
    """Named repositories by attention, then agent time, then name."""
    return repositories.where(F.col("repository").isNotNull()).orderBy(F.desc("attention_seconds"), F.desc("agent_seconds"), "repository")


def placed(rows: DataFrame, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """``rows`` plus ``place``, from 1, in an order within ``by``. For the few rows a reader is shown."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def _last(col: str) -> Column:
    """False before true: rows without a value come last among equals."""
    return F.col(col).isNull().asc()


def repository_places(repositories: DataFrame) -> DataFrame:
    """Named repositories with their place: attention and agent time falling, then name."""
    return placed(repositories.where(F.col("repository").isNotNull()), [F.desc("attention_seconds"), F.desc("agent_seconds"), F.asc("repository")])


def reaction_places(reactions: DataFrame) -> DataFrame:
    """Reaction rows: no repository last of all, then most measured first, then name."""
    return placed(reactions, [_last("repository"), F.desc("n"), F.asc("repository")])


def part_places(parts: DataFrame) -> DataFrame:
    """Parts of each block: most observations first, no repository last among equals, then name."""
    return placed(parts, [F.desc("observations"), _last("repository"), F.asc("repository")], ["block"])


def tool_places(tools: DataFrame) -> DataFrame:
    """Tools of each block: most started first, then family, none before all."""
    return placed(tools, [F.desc("n"), F.asc_nulls_first("tool_family")], ["block"])


def commit_places(commits: DataFrame, label: Column) -> DataFrame:
    """Commits of each block: most first, then by label."""
    return placed(commits, [F.desc("commits"), label.asc()], ["block"])


def totals(rows: DataFrame, offset: int = 0) -> DataFrame:
    """``metric, value``: unions, naive sums and daily sums of the attention and agent clocks."""
    live = routed_seconds(rows)
    anchors, agents = only(live, "anchor"), only(live, "agent")
    day = ["local_day"]
    dated = lambda df: df.withColumn("local_day", local_day(offset))
    total = lambda spans, name: spans.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0).cast("bigint")).alias(name))
    parts = [
        total(T.window_union(anchors, []), "attention_union_seconds"),
        total(T.window_union(anchors, ["repository"]), "attention_naive_sum_seconds"),
        total(T.window_union(dated(anchors), day), "attention_daily_sum_seconds"),
        total(T.clusters(agents, []), "agent_union_seconds"),
        total(T.clusters(agents, ["repository"]), "agent_naive_sum_seconds"),
        total(T.clusters(dated(agents), day), "agent_daily_sum_seconds"),
    ]
    long = reduce(
        DataFrame.unionByName, [p.select(F.lit(p.columns[0]).alias("metric"), F.col(p.columns[0]).alias("value")) for p in parts]
    )
    return long


def daily(rows: DataFrame, offset: int = 0) -> DataFrame:
    """Per local day: attention and agent seconds of that day's own observations, windows not cut at midnight."""
    dated = routed_seconds(rows).withColumn("local_day", local_day(offset))
    day = ["local_day"]
    attention = T.seconds(T.window_union(only(dated, "anchor"), day), day, "attention_seconds")
    agent = T.seconds(T.clusters(only(dated, "agent"), day), day, "agent_seconds")
    both = attention.join(agent, "local_day", "full")
    return both.select("local_day", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("attention_seconds", "agent_seconds")])


def turns(rows: DataFrame) -> DataFrame:
    """Prompts and completions that sit in a session."""
    is_prompt = F.col("route") == "anchor"
    done = (F.col("route") == "agent") & (F.col("event_type") == RESPONSE)
    return rows.where((is_prompt | done) & F.col("session").isNotNull()).withColumn("is_prompt", is_prompt)


def response_gaps(rows: DataFrame) -> DataFrame:
    """Per anchored prompt of a session: ``response_gap`` since the completion right before it, and ``interval`` since the prompt before.

    Order within a session is instant, then arrival. Without a completion right before, response_gap is null.
    """
    order = ["instant", "ingest_seq"]
    seq = turns(rows).select("session", "repository", "instant", "ingest_seq", "is_prompt")
    paired = T.previous_row(seq, ["session"], order, "instant", ["is_prompt", "instant"], "prev_")
    prompts = paired.where("is_prompt")
    spaced = T.previous_row(prompts, ["session"], order, "instant", ["instant"], "last_prompt_")
    return spaced.select(
        "session", "ingest_seq", "repository", "instant",
        F.when(~F.col("prev_is_prompt"), F.col("instant") - F.col("prev_instant")).alias("response_gap"),
        (F.col("instant") - F.col("last_prompt_instant")).alias("interval"),
    )


def quartiles(measured: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by, n, p25, median, p75`` by nearest rank, quartiles null below LEAST_MEASURED values; null values do not count."""
    n = F.count(value)
    rank = lambda p: F.when(n >= LEAST_MEASURED, F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").cast("bigint"))
    return measured.groupBy(*by).agg(n.alias("n"), rank(0.25).alias("p25"), rank(0.5).alias("median"), rank(0.75).alias("p75"))


def workstreams(repositories: DataFrame, workstream: Column) -> DataFrame:
    """Per workstream (null: unassigned, last): summed attention, agent time, prompts and the repositories' names."""
    named = repositories.where(F.col("repository").isNotNull()).withColumn("workstream", workstream)
    sums = [F.sum(c).alias(c) for c in ("attention_seconds", "agent_seconds", "prompts")]
    return named.groupBy("workstream").agg(*sums, F.array_join(F.array_sort(F.collect_set("repository")), ",").alias("repositories"))


def blocks(rows: DataFrame) -> DataFrame:
    """Admitted non-commit observations plus ``block``, the first instant of their block."""
    return T.labelled_clusters(only(rows, "anchor", "agent"), [])


def block_parts(rows: DataFrame) -> DataFrame:
    """``block, repository, observations, prompts``."""
    return blocks(rows).groupBy("block", "repository").agg(F.count(F.lit(1)).alias("observations"), F.count_if(F.col("route") == "anchor").alias("prompts"))


def block_spans(rows: DataFrame) -> DataFrame:
    """``start, end, n`` of every block."""
    return T.clusters(only(rows, "anchor", "agent"), [])


def block_attention(rows: DataFrame) -> DataFrame:
    """``block, repository, seconds``: the attention of each block divided among its repositories."""
    return T.nearest_anchor_shares(only(blocks(rows), "anchor"), ["block"])


def block_tools(rows: DataFrame) -> DataFrame:
    """``block, tool_family, n`` of tools started."""
    return blocks(rows).where(F.col("event_type") == TOOL_STARTED).groupBy("block", "tool_family").agg(F.count(F.lit(1)).alias("n"))


def block_commits(rows: DataFrame) -> DataFrame:
    """``block, repository, commits``; block null for commits outside every block."""
    placed_in = T.containing_span(only(rows, "commit"), block_spans(rows), "instant", "start", "end", "block")
    return placed_in.groupBy("block", "repository").agg(F.count(F.lit(1)).alias("commits"))


def block_rows(rows: DataFrame) -> DataFrame:
    """``block, last, observations, prompts, attention_seconds, named_repositories, vendors`` of every block.

    The attention is the union of the block's own windows, never cut at its edges; vendors are sorted and joined by a plus.
    """
    labelled = blocks(rows)
    attention = T.seconds(T.window_union(only(labelled, "anchor"), ["block"]), ["block"], "attention_seconds")
    # One row per block, repository and vendor before anything is gathered.
    per = labelled.groupBy("block", "repository", "source_kind").agg(
        F.max("instant").alias("last"), F.count(F.lit(1)).alias("observations"), F.count_if(F.col("route") == "anchor").alias("prompts")
    )
    whole = per.groupBy("block").agg(
        F.max("last").alias("last"), F.sum("observations").alias("observations"), F.sum("prompts").alias("prompts"),
        F.count_distinct("repository").alias("named_repositories"), F.array_join(F.array_sort(F.collect_set("source_kind")), "+").alias("vendors"),
    )
    named = attention.select(F.col("block").alias("__b"), "attention_seconds")
    return whole.join(named, F.col("block") == F.col("__b"), "left").drop("__b").withColumn("attention_seconds", F.coalesce("attention_seconds", F.lit(0)))


def strip(rows: DataFrame, midnight: int, width: int) -> DataFrame:
    """``repository, cell, n, level``: admitted events per cell since local midnight, with a density level of 1 to 8."""
    cell = F.floor((F.col("instant") - midnight) / F.lit(width)).cast("bigint")
    counted = only(rows, "anchor", "agent").groupBy("repository", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    peak = counted.agg(F.max("n")).scalar()
    return counted.select("repository", "cell", "n", density(F.col("n"), peak).alias("level"))


def day_strips(rows: DataFrame, offset: int, width: int) -> DataFrame:
    """``local_day, row_kind, repository, cell, n, prompts, level``: every cell of every local day's strip, empty ones too.

    A day has a row per repository (null: none) and one ``all`` row of every repository at once. Cells count from local midnight and
    run over the day's active hours. Levels are measured by the busiest cell of any one repository, so the ``all`` row saturates.
    """
    live = only(rows, "anchor", "agent")
    second = F.pmod(F.col("instant") + offset, F.lit(DAY))
    counted = live.groupBy(local_day(offset).alias("local_day"), "repository", F.floor(second / F.lit(width)).cast("bigint").alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("route") == "anchor").alias("prompts")
    )
    counted = Scratch(rows.sparkSession).cut(counted, "strip")
    per_hour, per_day = 3_600 // width, DAY // width
    days = counted.groupBy("local_day").agg(F.min("cell").alias("lo"), F.max("cell").alias("hi"), F.max("n").alias("peak"))
    lo, hi = F.col("lo") - F.col("lo") % per_hour, F.least(F.col("hi") - F.col("hi") % per_hour + per_hour, F.lit(per_day)) - 1
    days = days.select(F.col("local_day").alias("d"), "peak", lo.alias("lo"), hi.alias("hi"))
    shown = counted.select("local_day", "repository").distinct().join(days, F.col("local_day") == F.col("d"))
    grid = shown.select(F.col("local_day").alias("gd"), F.col("repository").alias("gr"), "peak", F.explode(F.sequence("lo", "hi")).alias("gc"))
    met = (F.col("gd") == F.col("local_day")) & F.col("gr").eqNullSafe(F.col("repository")) & (F.col("gc") == F.col("cell"))
    cells = grid.join(counted, met, "left").select(
        F.col("gd").alias("local_day"), F.col("gr").alias("repository"), F.col("gc").alias("cell"), "peak",
        F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("prompts", F.lit(0)).alias("prompts"),
    )
    union = cells.groupBy("local_day", "cell", "peak").agg(F.sum("n").alias("n"), F.sum("prompts").alias("prompts")).withColumn("repository", F.lit(None).cast("string"))
    both = cells.withColumn("row_kind", F.lit("repository")).unionByName(union.withColumn("row_kind", F.lit("all")))
    return both.select("local_day", "row_kind", "repository", "cell", "n", "prompts", density(F.col("n"), F.col("peak")).alias("level"))


def density(n: Column, peak: Column) -> Column:
    """0 for nothing, else 1 to 8 in proportion to the peak."""
    level = F.floor((16 * n + peak) / (2 * peak)).cast("int")
    return F.when((n == 0) | (peak == 0), 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(8), level)))


def observed_ranges(obs: DataFrame) -> DataFrame:
    """``source_kind, earliest, latest``: least and greatest time text per source, gap markers left out."""
    return obs.where(F.col("event_type") != GAP).groupBy("source_kind").agg(F.min("occurred_at").alias("earliest"), F.max("occurred_at").alias("latest"))
