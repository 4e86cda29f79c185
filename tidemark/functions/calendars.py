"""Exchange sessions by rule: a dimension table of session number, date, open and close in UTC."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th such weekday of a month; n = -1 is the last."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(1)
    return last - timedelta((last.weekday() - weekday) % 7)


def _easter(y: int) -> date:
    a, b, c = y % 19, y // 100, y % 100
    d = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    e = (32 + 2 * (b % 4) + 2 * (c // 4) - d - c % 4) % 7
    f = d + e - 7 * ((a + 11 * d + 22 * e) // 451) + 114
    return date(y, f // 31, f % 31 + 1)


def _observed(d: date) -> date:
    return d - timedelta(1) if d.weekday() == 5 else d + timedelta(1) if d.weekday() == 6 else d


def new_york(year: int) -> tuple[set[date], set[date]]:
    """(closed weekdays, early closes at 13:00) of the New York exchanges by present rules."""
    thanks, july = _nth(year, 11, 3, 4), date(year, 7, 4)
    closed = {_nth(year, 1, 0, 3), _nth(year, 2, 0, 3), _easter(year) - timedelta(2), _nth(year, 5, 0, -1), _observed(july), _nth(year, 9, 0, 1), thanks, _observed(date(year, 12, 25))}
    if date(year, 1, 1).weekday() != 5:  # not observed on the last day of a year
        closed.add(_observed(date(year, 1, 1)))
    if year >= 2022:
        closed.add(_observed(date(year, 6, 19)))
    early = {thanks + timedelta(1)} | {d for d in (date(year, 7, 3), date(year, 12, 24)) if d.weekday() < 5}
    return closed, early - closed


def tokyo(year: int) -> tuple[set[date], set[date]]:
    """(closed weekdays, none) of the Tokyo exchange: national holidays with substitutes, and the turn of the year."""
    spring = date(year, 3, int(20.8431 + 0.242194 * (year - 1980)) - (year - 1980) // 4)
    autumn = date(year, 9, int(23.2488 + 0.242194 * (year - 1980)) - (year - 1980) // 4)
    days = {date(year, *d) for d in ((1, 1), (2, 11), (4, 29), (5, 3), (5, 4), (5, 5), (11, 3), (11, 23))} | {spring, autumn}
    days |= {_nth(year, 1, 0, 2), _nth(year, 7, 0, 3), _nth(year, 9, 0, 3), _nth(year, 10, 0, 2)}
    days |= {date(year, 2, 23)} if year >= 2020 else set()
    days |= {date(year, 8, 11)} if year >= 2016 else set()
    if (autumn - _nth(year, 9, 0, 3)).days == 2:
        days.add(autumn - timedelta(1))
    for d in sorted(days):
        if d.weekday() == 6:
            s = d + timedelta(1)
            while s in days:
                s += timedelta(1)
            days.add(s)
    return days | {date(year, 1, 2), date(year, 1, 3), date(year, 12, 31)}, set()


EXCHANGES = {"XNYS": (new_york, "America/New_York", time(9, 30), time(16), time(13)), "XNAS": (new_york, "America/New_York", time(9, 30), time(16), time(13)),
             "XJPX": (tokyo, "Asia/Tokyo", time(9), time(15, 30), time(15))}


def sessions(spark: SparkSession, exchange: str, start: date, end: date) -> DataFrame:
    """session_seq, session_date, open_utc, close_utc, early_close: one row per session (a small dimension)."""
    rules, zone, opens, closes, early_close = EXCHANGES[exchange]
    tz, rows, d = ZoneInfo(zone), [], start
    by_year = {y: rules(y) for y in range(start.year, end.year + 1)}
    while d <= end:
        closed, early = by_year[d.year]
        if d.weekday() < 5 and d not in closed:
            close = early_close if d in early else closes
            if exchange == "XJPX" and d < date(2024, 11, 5):
                close = time(15)
            utc = [datetime.combine(d, t, tz).astimezone(ZoneInfo("UTC")).strftime("%Y-%m-%d %H:%M:%S") for t in (opens, close)]
            rows.append((len(rows), d, *utc, d in early))
        d += timedelta(1)
    return spark.createDataFrame(rows, "session_seq long, session_date date, open_utc string, close_utc string, early_close boolean").withColumns(
        {c: F.to_timestamp(F.concat(F.col(c), F.lit("+00:00"))) for c in ("open_utc", "close_utc")})


def neighbours(calendar: DataFrame) -> DataFrame:
    """The calendar with previous_session and next_session."""
    w = Window.orderBy("session_seq")  # a calendar has some thousand rows
    return calendar.withColumn("previous_session", F.lag("session_date").over(w)).withColumn("next_session", F.lead("session_date").over(w))


def is_active(day: Column, start: Column, end: Column) -> Column:
    """Inclusive on both ends; a null end is open."""
    return (start.isNull() | (day >= start)) & (end.isNull() | (day <= end))
