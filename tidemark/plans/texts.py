"""Whole texts: the report of a period, the log of a day, what an import and an archive run did.

Frames are reduced to what a reader is shown before anything reaches the driver: repositories, blocks of a day, cells of a strip.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidemark.plans import report as R
from tidemark.plans.params import Period, averages
from tidemark.plans.render import MARKS, active_cells, clock_range, hm, hms, share, short_labels, strip_width
from tidemark.plans.rules import workstream
from tidemark.scratch import Scratch
from tidemark.schema import AFTER, BEFORE, CLUSTER_GAP, LEAST_MEASURED

Rules = tuple[list[tuple[str, str]], list[tuple[str, str]]]
NONE, UNASSIGNED, ALL = "(none)", "unassigned", "all"


def offset_text(seconds: int) -> str:
    """``UTC+09:00`` of an offset in seconds."""
    sign, minutes = "-" if seconds < 0 else "+", abs(seconds) // 60
    return f"UTC{sign}{minutes // 60:02d}:{minutes % 60:02d}"


def heading(period: Period, offset: int) -> str:
    """The period, its hours where it is narrowed, and the offset it is cut with."""
    clock = "" if (period.from_s, period.to_s) == (0, 86_400) else f" {period.from_s // 3600:02d}:{period.from_s // 60 % 60:02d}-{period.to_s // 3600:02d}:{period.to_s // 60 % 60:02d}"
    start, end = period.utc_window(offset)
    return f"{period.label}{clock}  {offset_text(offset)}  [{start}, {end})"


def disclosure(coverage: Row, prompts: int, within: bool, span: str) -> list[str]:
    """What the figures leave out; lines about nothing are left out too."""
    lines = [f"coverage      {coverage.observations_in_window} observations, {coverage.gap_markers} gap markers on no clock"]
    if not within:
        lines.append(f"              no source was observed in this {span}: nothing was collected, which is not the same as no work")
    for n, what in (
        (coverage.with_inherited_time, "copied from another history with the copy's time, on no clock"),
        (coverage.without_usable_time, "without a readable time, on no clock"),
        (coverage.without_repository, "without a repository"),
        (coverage.prompts_not_anchored, "prompts not sent by a person, on the agent clock only"),
    ):
        if n:
            lines.append(f"              {n} {what}")
    lines.append(f"              {prompts - coverage.prompts_without_repository} of {prompts} prompts have a repository")
    return lines


def distribution(row: Row | Mapping) -> str:
    """Number and quartiles, or that there are too few for them."""
    n, p25, median, p75 = (row[k] for k in ("n", "p25", "median", "p75"))
    if median is None:
        return f"n {n}, fewer than {LEAST_MEASURED}: no quartiles"
    return f"n {n}, quartiles {hms(p25)} / {hms(median)} / {hms(p75)}"


def _mean_lines(total: int, period: Period, active: int) -> list[str]:
    if not active:
        return ["  per day         n/a, as no day holds any activity"]
    day, busy = averages(total, period, active)
    return [f"  per day         {hm(day)} over {period.days}", f"  per active day  {hm(busy)} over {active}"]


def report_of(rows: DataFrame, period: Period, offset: int, rules: Rules = ((), ()), within: bool = True, ranges: Sequence[Row] = ()) -> str:
    """The text of a period from its routed observations: workstreams, both clocks, commits, distributions, coverage."""
    per = Scratch(rows.sparkSession).cut(R.repository_rows(rows), "repositories")
    repositories = R.repository_places(per).orderBy("place").withColumn("workstream", workstream(F.col("repository"), *rules)).collect()
    spare = per.where("repository is null").collect()
    totals = {r.metric: r.value for r in R.totals(rows, offset).collect()}
    coverage = R.coverage(rows, offset).first()
    gaps = R.response_gaps(rows)
    every = R.quartiles(gaps.withColumn("all", F.lit(1)), ["all"], "response_gap").collect()
    interval = R.quartiles(gaps.withColumn("all", F.lit(1)), ["all"], "interval").collect()
    per_repository = R.reaction_places(R.quartiles(gaps, ["repository"], "response_gap")).orderBy("place").collect()
    paired = gaps.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("response_gap").isNull()).alias("bare")).first()
    return report_lines(period, offset, repositories, spare[0] if spare else None, totals, coverage, every, interval, per_repository, paired, within, ranges)


def report_lines(
    period: Period, offset: int, repositories: Sequence[Row], spare: Row | None, totals: Mapping[str, int], coverage: Row, every: Sequence[Row], interval: Sequence[Row],
    per_repository: Sequence[Row], paired: Row, within: bool = True, ranges: Sequence[Row] = (),
) -> str:
    """The text of a report from its small frames."""
    span = "day" if period.days == 1 else "period"
    union, agent = totals["attention_union_seconds"], totals["agent_union_seconds"]
    prompts = sum(r.prompts for r in repositories) + (spare.prompts if spare else 0)
    commits = sum(r.commits for r in repositories) + (spare.commits if spare else 0)
    lines = [heading(period, offset), "", f"window -{BEFORE // 60}m +{AFTER // 60}m around a person's prompt, clusters up to {CLUSTER_GAP // 60}m apart", ""]
    groups: dict[str | None, list[Row]] = {}
    for r in repositories:
        groups.setdefault(r.workstream, []).append(r)
    width = max([len("workstream"), *[len(r.repository) + 2 for r in repositories], *[len(w or UNASSIGNED) for w in groups]])
    lines.append(f"{'workstream':<{width}}  {'attention':>9}  {'prompts':>7}  {'share':>6}")
    for w in sorted(groups, key=lambda w: (w is None, w or "")):
        seconds, n = sum(r.attention_seconds for r in groups[w]), sum(r.prompts for r in groups[w])
        lines.append(f"{w or UNASSIGNED:<{width}}  {hm(seconds):>9}  {n:>7}  {share(seconds, union):>6}")
        lines += [f"{'  ' + r.repository:<{width}}  {hm(r.attention_seconds):>9}  {r.prompts:>7}" for r in sorted(groups[w], key=lambda r: r.place)]
    if not groups:
        lines.append(f"{'-':<{width}}  {'-':>9}  {'-':>7}  {'-':>6}")
    for name, key, total in (("attention", "attention", union), ("agent", "agent", agent)):
        lines += ["", f"{name:<14}{hm(total):>8}  union of the {span}", f"{'':<14}{hm(totals[key + '_naive_sum_seconds']):>8}  sum of repositories, counts what overlaps twice"]
        if span == "period":
            lines += [f"{'':<14}{hm(totals[key + '_daily_sum_seconds']):>8}  sum of days, each by itself", *_mean_lines(total, period, coverage.active_days)]
        if name == "agent":
            lines += [f"{'':<14}{hm(r.agent_seconds):>8}  {r.repository}" for r in repositories]
    lines += ["", f"commits       {commits:>8}  moments, on no clock"]
    lines += [f"              {r.commits:>8}  {r.repository}" for r in repositories if r.commits]
    if spare and spare.commits:
        lines.append(f"              {spare.commits:>8}  {NONE}")
    none = {"n": 0, "p25": None, "median": None, "p75": None}
    lines += ["", f"reaction      {distribution(every[0] if every else none)}", f"              {paired.bare} of {paired.n} prompts followed no new answer"]
    if prompts > paired.n:
        lines.append(f"              {prompts - paired.n} prompts name no session")
    lines.append(f"interval      {distribution(interval[0] if interval else none)}")
    lines += [f"              {hms(r.median) if r.median is not None else 'n/a':>8}  n {r.n:>5}  {r.repository or NONE}" for r in per_repository]
    lines += ["", *disclosure(coverage, prompts, within, span)]
    if spare and (spare.attention_seconds or spare.agent_seconds):
        lines.append(f"              {hm(spare.attention_seconds)} attention and {hm(spare.agent_seconds)} agent time have no repository at all")
    lines += [f"source        {r.source_kind} {r.earliest} .. {r.latest}" for r in ranges]
    return "\n".join(lines) + "\n"


def ruler(first: int, last: int, width: int) -> str:
    """Hour marks over the cells they begin at; a mark that would touch the one before is left out."""
    out, free = "", 0
    for cell in range(first, last + 1):
        column = cell - first
        if cell * width % 3_600 == 0 and column >= free:
            out = out.ljust(column) + f"{cell * width // 3_600:02d}"
            free = column + 3
    return out


def _tail(prompts: int, vendors: str) -> str:
    return f"  {prompts:>4}p  {vendors}"


def strip_lines(events: Sequence[Row], rules: Mapping[str, str | None]) -> list[str]:
    """The strip and its legend from ``repository, second, prompts, n, vendors`` rows: counts of one local day by second since midnight.

    Repositories by number of events, none last among equals, then by label; at last the row of all. Marks are measured by the
    busiest cell of one repository.
    """
    if not events:
        return ["nothing in this window reached a cell"]
    per: dict[str | None, list[Row]] = {}
    for e in events:
        per.setdefault(e.repository, []).append(e)
    labels = short_labels(list(per))
    order = sorted(per, key=lambda r: (-sum(e.n for e in per[r]), r is None, labels[r]))
    vendors = {r: "+".join(sorted({e.vendor for e in per[r]})) for r in order}
    every = "+".join(sorted({e.vendor for e in events}))
    side = max(len(labels[r]) for r in [*order]) if order else 0
    side = max(side, len(ALL))
    tails = [_tail(sum(e.prompts for e in per[r]), vendors[r]) for r in order] + [_tail(sum(e.prompts for e in events), every)]
    lo, hi = min(e.second for e in events), max(e.second for e in events)
    width = strip_width(lo, hi, side + max(map(len, tails)))
    first, last = active_cells(lo, hi, width)

    def row(members: Sequence[Row], field: str) -> list[int]:
        cells = [0] * (last - first + 1)
        for e in members:
            cells[e.second // width - first] += e[field]
        return cells

    peak = max(max(row(per[r], "n")) for r in order)
    level = lambda n: MARKS[max(1, min(8, (16 * n + peak) // (2 * peak)))] if n else MARKS[0]
    lines = [f"strip         a cell is {width // 60} min; {MARKS[1:]} up to {peak}, the busiest cell of one repository; ^ a person's prompt", f"{'':<{side}}  {ruler(first, last, width)}"]
    for r, tail in zip(order, tails, strict=False):
        lines.append(f"{labels[r]:<{side}}  {''.join(map(level, row(per[r], 'n')))}{tail}")
        marks = "".join("^" if n else " " for n in row(per[r], "prompts")).rstrip()
        if marks:
            lines.append(f"{'':<{side}}  {marks}")
    lines += [f"{ALL:<{side}}  {''.join(map(level, row(events, 'n')))}{tails[-1]}", "", "repositories"]
    wide = max(len(r or NONE) for r in order)
    lines += [f"  {labels[r]:<{side}}  {r or NONE:<{wide}}  {(rules.get(r) or UNASSIGNED) if r else 'n/a'}" for r in order]
    return lines


def block_lines(blocks: Sequence[Row], parts: Sequence[Row], tools: Sequence[Row], commits: Sequence[Row], labels: Mapping[str | None, str], offset: int) -> list[str]:
    """The blocks of a day with their parts, commits and tools, each in its order."""
    lines = [f"blocks        {len(blocks)}; their attention does not add up to the day's"]
    name = lambda r: labels.get(r, r or NONE)
    pick = lambda rows, b: sorted((x for x in rows if x.block == b), key=lambda x: x.place)
    wide = max([len(name(p.repository)) for p in parts], default=0)
    for b in sorted(blocks, key=lambda b: b.block):
        elapsed = b.last - b.block
        lines += ["", f"{clock_range(b.block, b.last, offset):<11}  {hm(elapsed):>6} elapsed  {hm(b.attention_seconds):>6} attention  {b.prompts:>4} prompts  {b.vendors}"]
        if b.attention_seconds > elapsed:
            lines.append("  more attention than elapsed, as a prompt's window reaches beyond the block")
        if b.named_repositories > 1:
            lines.append(f"  one stretch over {b.named_repositories} repositories")
        for p in pick(parts, b.block):
            lines.append(f"    {name(p.repository):<{wide}}  {hm(p.seconds):>6}  {share(p.seconds, b.attention_seconds):>6}  {p.prompts:>4} prompts  {p.observations:>6} observations")
        for what, rows, key in (("commits", commits, lambda x: name(x.repository)), ("tools", tools, lambda x: x.tool_family or "(no family)")):
            if found := pick(rows, b.block):
                lines.append(f"    {what}  " + ", ".join(f"{key(x)} {x.commits if what == 'commits' else x.n}" for x in found))
    outside = sum(c.commits for c in commits if c.block is None)
    if outside:
        lines += ["", f"{outside} commits outside every block"]
    return lines


def log_of(rows: DataFrame, period: Period, offset: int, rules: Rules = ((), ()), within: bool = True, full: bool = False) -> str:
    """The text of one day from its routed observations: heading, strip with legend, blocks; ``full`` adds the coverage."""
    live = R.only(rows, "anchor", "agent")
    second = F.pmod(F.col("instant") + offset, F.lit(86_400))
    # A minute is finer than any cell, so a day is at most 1,440 rows per repository and vendor.
    events = live.groupBy("repository", (F.floor(second / 60) * 60).cast("int").alias("second"), F.col("source_kind").alias("vendor")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("route") == "anchor").alias("prompts")
    )
    named = live.select("repository").where("repository is not null").distinct().select("repository", workstream(F.col("repository"), *rules).alias("w"))
    shares = R.block_attention(rows).select(F.col("block").alias("__b"), F.col("repository").alias("__r"), "seconds")
    parts = R.part_places(R.block_parts(rows)).join(shares, (F.col("block") == F.col("__b")) & F.col("repository").eqNullSafe(F.col("__r")), "left")
    parts = parts.withColumn("seconds", F.coalesce("seconds", F.lit(0))).collect()
    cells = events.collect()
    labels = short_labels(list({e.repository for e in cells}))
    lines = [heading(period, offset), ""]
    if full or not within:
        coverage = R.coverage(rows, offset).first()
        prompts = sum(e.prompts for e in cells)
        lines += [*(disclosure(coverage, prompts, within, "day") if full else disclosure(coverage, prompts, within, "day")[1:2]), ""]
    lines += strip_lines(cells, {r.repository: r.w for r in named.collect()})
    if cells:
        commits = R.commit_places(R.block_commits(rows), F.coalesce("repository", F.lit(NONE))).collect()
        lines += ["", *block_lines(R.block_rows(rows).collect(), parts, R.tool_places(R.block_tools(rows)).collect(), commits, labels, offset)]
    return "\n".join(lines) + "\n"


def import_text(report: Sequence[Row], cursors: Mapping[str, int] | None = None, dry: bool = False, scans: Sequence[Row] = ()) -> str:
    """What an import did, from the rows of :func:`tidemark.sources.envelope.import_report`; counters of nothing are left out."""
    by: dict[str, list[Row]] = {}
    for r in report:
        by.setdefault(r.section, []).append(r)
    lines = ["dry run, nothing written"] if dry else []
    lines += [f"{k:<24}{v}" for k, v in (cursors or {}).items()]
    lines.append("would be created" if dry else "created")
    lines += [f"  {r.item:<22}{r.n}" for r in sorted(by.get("created", []), key=lambda r: r.item)] or ["  0"]
    for section in ("already_present", "unattributed", "inherited"):
        n = sum(r.n for r in by.get(section, []))
        if n or section == "already_present":
            lines.append(f"{section.replace('_', ' '):<24}{n}")
    for section, title in (("skipped", "skipped, understood"), ("parse_error", "gap: parse_error"), ("unmapped_kind", "gap: unmapped_kind"), ("missing_field", "gap: missing_field")):
        found = by.get(section, [])
        if found:
            lines.append(title)
            lines += [f"  {r.item or '-':<22}{r.n}" for r in sorted(found, key=lambda r: r.item or "")]
    known = {"created", "already_present", "unattributed", "inherited", "skipped", "parse_error", "unmapped_kind", "missing_field"}
    lines += [f"gap: {s:<19}{sum(r.n for r in by[s])}" for s in sorted(set(by) - known)]
    if scans:
        read = [s for s in scans if s.outcome == "collected"]
        lines.append(f"repositories            {len(scans)}, read {len(read)}, commits {sum(s.commits for s in read)}, cut short {sum(bool(s.truncated) for s in read)}")
        why: dict[str, int] = {}
        for s in scans:
            if s.outcome != "collected":
                why[s.outcome] = why.get(s.outcome, 0) + 1
        lines += [f"  {k:<22}{v}" for k, v in sorted(why.items())]
    return "\n".join(lines) + "\n"


def archive_text(run: Row, dry: bool = False) -> str:
    """What an archive run did, from the row of :func:`tidemark.sources.files.archive_report`."""
    lines = ["dry run, nothing written"] if dry else []
    lines += [f"{k:<12}{run[k]}" for k in ("scanned", "archived", "unchanged")]
    if run.failed:
        lines.append(f"{'failed':<12}{run.failed}")
    if dry:
        lines.append(f"{'bytes':<12}{run.bytes}")
    return "\n".join(lines) + "\n"
