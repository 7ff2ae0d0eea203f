"""Dates in listings, month numbers and the labels made from dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_SPACE = r"[\s ]"


def _part(s: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract(s, pattern, k)


def _date(year: Column, month: Column, day: Column) -> Column:
    """A date that exists, else null. Parts are strings of digits."""
    return F.concat(F.lpad(year, 4, "0"), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0")).try_cast("date")


def _full_year(digits: Column) -> Column:
    y = digits.try_cast("int")
    return F.when(y < 100, y + 2000).otherwise(y).cast("string")


def stripped(s: Column) -> Column:
    return F.regexp_replace(s, rf"^{_SPACE}+|{_SPACE}+$", "")


def parse_mdy(raw: Column) -> Column:
    """``M/D/YY`` or ``M/D/YYYY``; two- and three-digit years below 100 are of this century. Else null."""
    s, p = stripped(raw), r"^(\d{1,2})/(\d{1,2})/(\d{2,4})$"
    return F.when(s.rlike(p), _date(_full_year(_part(s, p, 3)), _part(s, p, 1), _part(s, p, 2)))


def _month_number(word: Column) -> Column:
    """The month of a word by its first three letters, as text; null if it is none."""
    at = F.array_position(F.array(*(F.lit(m.lower()) for m in MONTH_NAMES)), F.lower(F.substring(word, 1, 3)))
    return F.when(at > 0, at.cast("string"))


def _coming(month: Column, day: Column, now: Column) -> Column:
    """The day in this year, or in the next if it is past."""
    this, after = (_date((F.year(now) + k).cast("string"), month, day) for k in (0, 1))
    # 29 February of a common year is 1 March when compared with today
    compared = F.coalesce(this, F.when((month.cast("int") == 2) & (day.cast("int") == 29), F.make_date(F.year(now), F.lit(3), F.lit(1))))
    return F.when(compared < now, after).otherwise(this)


def parse_end_date(raw: Column, now: Column, *, day_first: Column | None = None) -> Column:
    """An end date as listings write it: ``July 25, 2026``, ``7/25/26``, ``25/07``, ``until Jul 25``.

    A stop after a short month name is taken. ``day_first``: rows whose dates with a year
    are ``D/M/Y``. Dates without a year are the next such day, ``now`` included. Else null.
    """
    s = F.regexp_replace(stripped(raw), rf"(?i)^until{_SPACE}+", "")
    long, numeric = rf"^([A-Za-z]+)\.?{_SPACE}+(\d{{1,2}}),?{_SPACE}*(\d{{4}})$", r"^(\d{1,2})/(\d{1,2})/(\d{2,4})$"
    short, worded = r"^(\d{1,2})/(\d{1,2})$", rf"^([A-Za-z]{{3,}})\.?{_SPACE}+(\d{{1,2}})$"
    us = _date(_full_year(_part(s, numeric, 3)), _part(s, numeric, 1), _part(s, numeric, 2))
    if day_first is not None:
        us = F.when(day_first, _date(_full_year(_part(s, numeric, 3)), _part(s, numeric, 2), _part(s, numeric, 1))).otherwise(us)
    day, month = _part(s, short, 1), _part(s, short, 2)
    valid_month = month.try_cast("int").between(1, 12)
    return (
        F.when(s.rlike(long), _date(_part(s, long, 3), _month_number(_part(s, long, 1)), _part(s, long, 2)))
        .when(s.rlike(numeric), us)
        .when(s.rlike(short), F.when(valid_month, _coming(month, day, now)))
        .when(s.rlike(worded), _coming(_month_number(_part(s, worded, 1)), _part(s, worded, 2), now))
    )


def month_index(day: Column) -> Column:
    """Months since year 0."""
    return F.year(day) * 12 + F.month(day) - 1


def month_name(month: Column) -> Column:
    """Jan to Dec for a month index or a month from 0."""
    return F.element_at(F.array(*map(F.lit, MONTH_NAMES)), (F.pmod(month, F.lit(12)) + 1).cast("int"))


def month_label(month: Column) -> Column:
    """``Mar 2027`` for a month index."""
    return F.concat_ws(" ", month_name(month), F.floor(month / 12).cast("string"))


def window_label(start: Column) -> Column:
    """``JUN 2026``."""
    return F.upper(month_label(month_index(start)))


def length_label(start: Column, end: Column) -> Column:
    """``35 days``, both ends counted; ``1 day``."""
    days = F.datediff(end, start) + 1
    return F.concat(days.cast("string"), F.when(days == 1, " day").otherwise(" days"))


def deadline_day(iso: Column) -> Column:
    """``DD/MM`` of an ISO deadline, three hours west of UTC; plain dates stay; else the empty string."""
    only = r"^\d{4}-(\d{2})-(\d{2})$"
    moment = F.date_format(F.try_to_timestamp(iso) - F.expr("INTERVAL 3 HOURS"), "dd/MM")
    return F.when(iso.rlike(only), F.concat(_part(iso, only, 2), F.lit("/"), _part(iso, only, 1))).otherwise(F.coalesce(moment, F.lit("")))
