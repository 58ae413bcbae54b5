"""Calendar parameters of a report: days, periods, times of day, offsets. Plain driver-side values."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

DAY = 86_400
_EPOCH = dt.date(1970, 1, 1)


class ParameterError(ValueError):
    """A parameter that names no period, with the reason."""


def parse_day(text: str) -> dt.date:
    """A strict ``YYYY-MM-DD`` that exists."""
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        raise ParameterError(f"not a day: {text}")
    try:
        return dt.date.fromisoformat(text)
    except ValueError as e:
        raise ParameterError(f"no such day: {text}") from e


def parse_time(text: str) -> int:
    """Seconds since midnight of a strict ``HH:MM`` from 00:00 to 23:59."""
    m = re.fullmatch(r"(\d{2}):(\d{2})", text)
    if not m or int(m[1]) > 23 or int(m[2]) > 59:
        raise ParameterError(f"not a time of day: {text}")
    return int(m[1]) * 3600 + int(m[2]) * 60


def parse_offset(text: str) -> int:
    """Seconds east of UTC of ``9``, ``-5``, ``5:30`` or ``+0530``; only offsets real zones use."""
    m = re.fullmatch(r"([+-]?)(\d{1,2})(?::?(\d{2}))?", text)
    if not m or int(m[3] or 0) > 59:
        raise ParameterError(f"not an offset: {text}")
    minutes = (int(m[2]) * 60 + int(m[3] or 0)) * (-1 if m[1] == "-" else 1)
    if not -720 <= minutes <= 840:
        raise ParameterError(f"no zone has the offset {text}")
    return minutes * 60


@dataclass(frozen=True)
class Period:
    """Local days from ``first`` to ``last``, both included, narrowed to ``[from_s, to_s)`` of the day."""

    first: dt.date
    last: dt.date
    from_s: int = 0
    to_s: int = DAY

    def __post_init__(self):
        if self.last < self.first:
            raise ParameterError("a range must not end before it starts")
        if not self.from_s < self.to_s:
            raise ParameterError("a window must not end before it starts")
        if (self.from_s, self.to_s) != (0, DAY) and self.first != self.last:
            raise ParameterError("only a single day can be narrowed by time")

    @property
    def days(self) -> int:
        return (self.last - self.first).days + 1

    def utc_window(self, offset: int) -> tuple[int, int]:
        """Half-open epoch seconds; every local day is 86,400 s long, as the offset is fixed."""
        at = lambda d: (d - _EPOCH).days * DAY - offset
        return at(self.first) + self.from_s, at(self.last) + self.to_s

    def midnight(self, offset: int) -> int:
        """Epoch second of the first day's local midnight, where strip cells begin also when narrowed."""
        return (self.first - _EPOCH).days * DAY - offset

    @property
    def label(self) -> str:
        return str(self.first) if self.first == self.last else f"{self.first} to {self.last}"


def day(text: str) -> Period:
    return Period(parse_day(text), parse_day(text))


def week_ending(text: str) -> Period:
    """The seven days that end with a day."""
    last = parse_day(text)
    return Period(last - dt.timedelta(days=6), last)


def month(text: str) -> Period:
    """A whole month ``YYYY-MM``."""
    if not re.fullmatch(r"\d{4}-\d{2}", text):
        raise ParameterError(f"not a month: {text}")
    first = parse_day(text + "-01")
    nxt = (first.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
    return Period(first, nxt - dt.timedelta(days=1))


def between(start: str | None, end: str | None, on: str | None = None) -> Period:
    """A range of days, or of times on one day; the two bounds must be of one kind and both given."""
    if start is None or end is None:
        raise ParameterError("both bounds must be given")
    if (":" in start) != (":" in end):
        raise ParameterError("bounds must both be days or both be times")
    if ":" not in start:
        return Period(parse_day(start), parse_day(end))
    if on is None:
        raise ParameterError("times need a day")
    d = parse_day(on)
    return Period(d, d, parse_time(start), parse_time(end))


def averages(total: int, period: Period, active_days: int) -> tuple[int, int | None]:
    """Whole seconds per calendar day and per active day; none without an active day."""
    return total // period.days, total // active_days if active_days else None
