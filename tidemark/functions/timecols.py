"""RFC 3339 texts as columns: instants, durations, normal form, local clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.operators.instants import days_from_civil

#: Fixed value: date-time with a zone; second and day ranges are checked apart.
RFC3339 = r"^(\d+)-(\d{1,2})-(\d{1,2})[Tt](\d{1,2}):(\d{1,2}):(\d{1,2})(\.\d*)?(?:[Zz]|([+-])(\d+)(?::(\d+))?)$"


def _part(text: Column, i: int) -> Column:
    return F.regexp_extract(text, RFC3339, i)


def _int(text: Column, i: int) -> Column:
    return F.coalesce(_part(text, i).try_cast("bigint"), F.lit(0).cast("bigint"))


def _minutes(text: Column) -> Column:
    """Zone offset in minutes; 0 for Z."""
    return (_int(text, 9) * 60 + _int(text, 10)) * F.when(_part(text, 8) == "-", -1).otherwise(1)


def _valid(text: Column, last_second: int) -> Column:
    return (
        text.rlike(RFC3339) & _int(text, 2).between(1, 12) & _int(text, 3).between(1, 31)
        & (_int(text, 4) < 24) & (_int(text, 5) < 60) & (_int(text, 6) <= last_second)
    )


def epoch_millis(text: Column) -> Column:
    """Milliseconds since 1970 of an RFC 3339 text with a zone, else null; finer digits are cut off.

    A leap second is read; a day is only checked to be 1 to 31 and runs on into the next month.
    """
    days = days_from_civil(_int(text, 1), _int(text, 2), _int(text, 3))
    secs = days * 86_400 + _int(text, 4) * 3_600 + _int(text, 5) * 60 + _int(text, 6) - _minutes(text) * 60
    fraction = F.rpad(F.substring(F.concat(_part(text, 7), F.lit(".000")), 2, 3), 3, "0")
    millis = F.coalesce(F.regexp_replace(fraction, r"\D", "0").try_cast("bigint"), F.lit(0))
    return F.when(_valid(text, 60), secs * 1_000 + millis)


def epoch_seconds(text: Column) -> Column:
    """Whole seconds, floored also before 1970."""
    return F.floor(epoch_millis(text) / F.lit(1_000)).cast("bigint")


def duration_ms(start: Column, end: Column) -> Column:
    """Elapsed milliseconds; null when either text is unreadable or time runs backwards."""
    took = epoch_millis(end) - epoch_millis(start)
    return F.when(took >= 0, took)


def normal_utc(text: Column) -> Column:
    """The text in UTC with ``Z`` and its own fraction digits; an unreadable text (or a leap second) stays as it is."""
    days = days_from_civil(_int(text, 1), _int(text, 2), _int(text, 3))
    total = _int(text, 4) * 60 + _int(text, 5) - _minutes(text)
    utc = F.concat(utc_text((days * 1_440 + total) * 60 + _int(text, 6)), _part(text, 7), F.lit("Z"))
    return F.when(_valid(text, 59), utc).otherwise(text)


def utc_text(seconds: Column) -> Column:
    """``yyyy-mm-ddThh:mm:ss`` of epoch seconds, independent of the session's zone."""
    day = F.floor(seconds / F.lit(86_400)).cast("int")
    rest = F.pmod(seconds, F.lit(86_400))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day), "yyyy-MM-dd")
    clock = F.concat_ws(":", two(F.floor(rest / 3_600)), two(F.pmod(F.floor(rest / 60), F.lit(60))), two(F.pmod(rest, F.lit(60))))
    return F.concat(date, F.lit("T"), clock)


def local_hhmm(seconds: Column, offset: int) -> Column:
    """``hh:mm`` at a fixed offset in seconds."""
    rest = F.pmod(seconds + offset, F.lit(86_400))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat_ws(":", two(F.floor(rest / 3_600)), two(F.pmod(F.floor(rest / 60), F.lit(60))))
