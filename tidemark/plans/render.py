"""Text of reports and day logs, from small collected frames."""

from __future__ import annotations

from collections.abc import Sequence

from tidemark.plans.params import Period, averages
from tidemark.schema import LADDER, LINE

MARKS = " ▁▂▃▄▅▆▇█"


def hm(seconds: int) -> str:
    """Hours and minutes, to the nearest minute."""
    h, m = divmod((seconds + 30) // 60, 60)
    return f"{h}h{m:02d}m" if h else f"{m}m"


def hms(seconds: int) -> str:
    """Hours, minutes and seconds, without leading zeros."""
    h, m, s = seconds // 3600, seconds // 60 % 60, seconds % 60
    return f"{h}h{m:02d}m{s:02d}s" if h else f"{m}m{s:02d}s" if m else f"{s}s"


def share(part: int, whole: int) -> str:
    """Percentage with one digit; n/a of nothing."""
    return f"{100 * part / whole:.1f}%" if whole else "n/a"


def clock_range(start: int, end: int, offset: int) -> str:
    """``hh:mm-hh:mm`` local, one time where both ends share a minute."""
    at = lambda t: "{:02d}:{:02d}".format(*divmod((t + offset) % 86_400 // 60, 60))
    return at(start) if at(start) == at(end) else f"{at(start)}-{at(end)}"


def active_cells(first_s: int, last_s: int, width: int) -> tuple[int, int]:
    """First and last cell, in cells since midnight, that hold ``[first_s, last_s]``, widened to whole hours within the day."""
    per_hour, per_day = 3_600 // width, 86_400 // width
    first, last = first_s // width, last_s // width
    return first - first % per_hour, min(last - last % per_hour + per_hour, per_day) - 1


def choose_bucket(active_seconds: int, fixed: int) -> int:
    """The narrowest bucket whose cells fit a line beside ``fixed`` columns, else the widest."""
    for width in LADDER:
        if fixed + 2 + -(-active_seconds // width) <= LINE:
            return width
    return LADDER[-1]


def strip_width(first_s: int, last_s: int, fixed: int) -> int:
    """The narrowest bucket whose active cells fit a line beside ``fixed`` columns, else the widest: hours are never cut off."""
    for width in LADDER:
        first, last = active_cells(first_s, last_s, width)
        if fixed + 2 + last - first + 1 <= LINE:
            return width
    return LADDER[-1]


def short_labels(repositories: Sequence[str | None]) -> dict[str | None, str]:
    """Shortest path suffix no other repository shares; a whole path where none is, ``(none)`` for null."""
    named = sorted({r for r in repositories if r is not None})
    out: dict[str | None, str] = {None: "(none)"}
    for r in named:
        parts = r.split("/")
        suffixes = ["/".join(parts[-n:]) for n in range(1, len(parts) + 1)]
        alone = [s for s in suffixes if sum(o == s or o.endswith("/" + s) for o in named) == 1]
        out[r] = alone[0] if alone else r
    return out


def report_text(period: Period, repositories: Sequence, totals: dict[str, int], coverage, workstreams: Sequence = ()) -> str:
    """The report: totals, averages, one line per repository, workstreams, coverage."""
    union = totals["attention_union_seconds"]
    per_day, per_active = averages(union, period, coverage.active_days)
    lines = [
        f"{period.label}",
        f"attention {hm(union)} (sum {hm(totals['attention_naive_sum_seconds'])}, by day {hm(totals['attention_daily_sum_seconds'])})",
        f"agent     {hm(totals['agent_union_seconds'])} (sum {hm(totals['agent_naive_sum_seconds'])}, by day {hm(totals['agent_daily_sum_seconds'])})",
        f"per day {hm(per_day)}, per active day {hm(per_active) if per_active is not None else 'n/a'}",
        "",
    ]
    for r in repositories:
        name = r.repository if r.repository is not None else "(unattributed)"
        lines.append(f"{name:<48} {hm(r.attention_seconds):>8} {share(r.attention_seconds, union):>6} agent {hm(r.agent_seconds):>8} prompts {r.prompts} commits {r.commits}")
    for w in workstreams:
        lines.append(f"{w.workstream if w.workstream is not None else '(unassigned)':<48} {hm(w.attention_seconds):>8} agent {hm(w.agent_seconds):>8} {w.repositories}")
    lines += [
        "",
        f"observations {coverage.observations_in_window}, gap markers {coverage.gap_markers}, inherited {coverage.with_inherited_time}, "
        f"unusable {coverage.without_usable_time}, without repository {coverage.without_repository}, not anchored {coverage.prompts_not_anchored}",
    ]
    return "\n".join(lines) + "\n"


def strip_text(cells: Sequence, first: int, last: int) -> str:
    """One line of density marks per repository, most active first, nulls last within ties."""
    rows: dict[str | None, dict[int, int]] = {}
    n: dict[str | None, int] = {}
    for c in cells:
        rows.setdefault(c.repository, {})[c.cell] = c.level
        n[c.repository] = n.get(c.repository, 0) + c.n
    labels = short_labels(list(rows))
    width = max((len(labels[r]) for r in rows), default=0)
    order = sorted(rows, key=lambda r: (-n[r], r is None, labels[r]))
    return "\n".join(f"{labels[r]:<{width}}  " + "".join(MARKS[rows[r].get(i, 0)] for i in range(first, last + 1)) for r in order) + "\n"
