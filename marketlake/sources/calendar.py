"""The trading calendar as an input table, and a rule-made one for tests and demos.

A calendar has one row per trading day (``close_minute`` = minute of the New York day at which
the regular session ends) and may have named holidays (``close_minute`` null). Its size is
bounded by the number of days it spans, not by the data, and that bound is checked here.
"""

from __future__ import annotations

import datetime as dt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.schemas import CALENDAR

MAX_CALENDAR_DAYS = 40_000  # about 110 years

# Closings no rule gives, and clock minutes of regular and early closes.
SPECIAL_CLOSINGS = {
    "1994-04-27": "Day of mourning",
    "2001-09-11": "Emergency closing",
    "2001-09-12": "Emergency closing",
    "2001-09-13": "Emergency closing",
    "2001-09-14": "Emergency closing",
    "2004-06-11": "Day of mourning",
    "2007-01-02": "Day of mourning",
    "2012-10-29": "Storm closing",
    "2012-10-30": "Storm closing",
    "2018-12-05": "Day of mourning",
}
REGULAR_CLOSE = 960
EARLY_CLOSE = 780


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Reads a calendar table (Parquet) and checks that it is small enough to broadcast."""
    calendar = spark.read.schema(CALENDAR).parquet(path)
    first, last = calendar.agg(F.min("date"), F.max("date")).first()
    if first is not None and (last - first).days > MAX_CALENDAR_DAYS:
        raise ValueError(f"calendar spans {first} to {last}, more than {MAX_CALENDAR_DAYS} days")
    return calendar


def rule_calendar(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """Weekdays of the years, without the exchange's holidays, with 13:00 early closes."""
    if (last_year - first_year + 1) * 366 > MAX_CALENDAR_DAYS:
        raise ValueError(f"a calendar may span at most {MAX_CALENDAR_DAYS} days")
    closed: dict[dt.date, str] = {}
    early: set[dt.date] = set()
    for year in range(first_year, last_year + 1):
        closed.update(_holidays(year))
        early |= _early_closes(year)
    first = dt.date(first_year, 1, 1)
    rows = []
    for offset in range((dt.date(last_year, 12, 31) - first).days + 1):
        day = first + dt.timedelta(days=offset)
        if day.weekday() > 4:
            continue
        if day in closed:
            rows.append((day, None, closed[day]))
        else:
            rows.append((day, EARLY_CLOSE if day in early else REGULAR_CLOSE, None))
    dates, closes, names = zip(*rows, strict=True)
    table = pa.table(
        {
            "date": pa.array(dates, pa.date32()),
            "close_minute": pa.array(closes, pa.int32()),
            "holiday_name": pa.array(names, pa.string()),
        }
    )
    return spark.createDataFrame(table, CALENDAR)


def _nth(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th given weekday of a month; n = -1 is the last."""
    if n > 0:
        first = dt.date(year, month, 1)
        return first + dt.timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)
    return last - dt.timedelta(days=(last.weekday() - weekday) % 7)


def _easter(year: int) -> dt.date:
    """Gregorian Easter Sunday (the anonymous computus)."""
    golden, century, in_century = year % 19, year // 100, year % 100
    correction = (century + 8) // 25
    epact = (19 * golden + century - century // 4 - (century - correction + 1) // 3 + 15) % 30
    weekday = (32 + 2 * (century % 4) + 2 * (in_century // 4) - epact - in_century % 4) % 7
    late = (golden + 11 * epact + 22 * weekday) // 451
    month, day = divmod(epact + weekday - 7 * late + 114, 31)
    return dt.date(year, month, day + 1)


def _observed(day: dt.date) -> dt.date:
    """Saturday holidays are kept on Friday, Sunday holidays on Monday."""
    return day + dt.timedelta(days={5: -1, 6: 1}.get(day.weekday(), 0))


def _holidays(year: int) -> dict[dt.date, str]:
    days = {
        _nth(year, 2, 0, 3): "Presidents Day",
        _easter(year) - dt.timedelta(days=2): "Good Friday",
        _nth(year, 5, 0, -1): "Memorial Day",
        _observed(dt.date(year, 7, 4)): "Independence Day",
        _nth(year, 9, 0, 1): "Labor Day",
        _nth(year, 11, 3, 4): "Thanksgiving",
        _observed(dt.date(year, 12, 25)): "Christmas",
    }
    new_year = dt.date(year, 1, 1)
    if new_year.weekday() != 5:  # a Saturday New Year is not made up for
        days[_observed(new_year)] = "New Year"
    if year >= 1998:
        days[_nth(year, 1, 0, 3)] = "Martin Luther King Day"
    if year >= 2022:
        days[_observed(dt.date(year, 6, 19))] = "Juneteenth"
    for text, name in SPECIAL_CLOSINGS.items():
        day = dt.date.fromisoformat(text)
        if day.year == year:
            days[day] = name
    return days


def _early_closes(year: int) -> set[dt.date]:
    days = {_nth(year, 11, 3, 4) + dt.timedelta(days=1)}
    eve = dt.date(year, 12, 24)
    if eve.weekday() < 4:
        days.add(eve)
    third = dt.date(year, 7, 3)
    if year >= 1995 and third.weekday() in ((0, 1, 3) if year < 2013 else (0, 1, 2, 3)):
        days.add(third)
    if 1996 <= year <= 2012 and third.weekday() == 2:
        days.add(dt.date(year, 7, 5))
    return days
