"""Periods, recurrences and calendars."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .scoring import seconds

MAX_OCCURRENCES = 366
#: Days of a recurring window's cadence (a month counts as 30).
CADENCE_DAYS = {"DAILY": 1, "WEEKLY": 7, "MONTHLY": 30}


def period_start(moment: Column, period: str) -> Column:
    """Start of the hour, day, week (Monday), month or year."""
    return F.date_trunc(period, moment)


def period_window(moment: Column, period: str) -> tuple[Column, Column]:
    """[start, end) of the day, week, month or year."""
    start = period_start(moment, period)
    step = {"hour": F.expr("INTERVAL 1 HOUR"), "day": F.expr("INTERVAL 1 DAY"), "week": F.expr("INTERVAL 7 DAYS"), "month": F.expr("INTERVAL 1 MONTH"), "year": F.expr("INTERVAL 1 YEAR")}[period]
    return start, start + step


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def is_expired(expires_at: Column, now: Column) -> Column:
    return now >= expires_at


def occurrences(df: DataFrame, starts_at: str, ends_at: str, recurrence: str, until: str, window_start: Column, window_end: Column) -> DataFrame:
    """One row for each occurrence that overlaps [window_start, window_end), half open; at most MAX_OCCURRENCES of an entry."""
    n = F.when(F.col(recurrence) == "none", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(MAX_OCCURRENCES - 1)))
    moved = df.withColumn("occurrence", F.explode(n))
    start = (
        F.when(F.col(recurrence) == "daily", F.col(starts_at) + F.make_dt_interval(F.col("occurrence")))
        .when(F.col(recurrence) == "weekly", F.col(starts_at) + F.make_dt_interval(F.col("occurrence") * 7))
        .when(F.col(recurrence) == "monthly", F.col(starts_at) + F.make_ym_interval(F.lit(0), F.col("occurrence")))
        .otherwise(F.col(starts_at))
    )
    length = F.col(ends_at) - F.col(starts_at)
    stop = F.least(F.coalesce(F.col(until), window_end), window_end)
    return moved.withColumn("occurs_at", start).withColumn("occurs_until", start + length).where((F.col("occurs_at") < stop) & (F.col("occurs_at") < window_end) & (F.col("occurs_until") > window_start))


def window_active(moment: Column, starts_at: Column, ends_at: Column, cadence: Column, enabled: Column) -> Column:
    """A one-shot window includes its end; a recurring one is open while (t - start) mod period < length."""
    from .scoring import lookup

    period, length, since = lookup(CADENCE_DAYS, cadence) * 86400.0, seconds(ends_at) - seconds(starts_at), seconds(moment) - seconds(starts_at)
    recurring = (length > 0) & ((length >= period) | (F.pmod(since, period) < length))
    return F.coalesce(enabled & (since >= 0) & F.when(period.isNull(), moment <= ends_at).otherwise(recurring), F.lit(False))


def add_open_minutes(start: datetime, minutes: int, open_hour: int, close_hour: int, days: frozenset[int]) -> datetime:
    """``minutes`` of open hours after ``start``; closed hours and days are passed over."""
    if not days or close_hour <= open_hour:
        raise ValueError("the calendar has no open hour")
    left, day = timedelta(minutes=minutes), start.replace(hour=0, minute=0, second=0, microsecond=0)
    at = start
    while True:
        opens, closes = day + timedelta(hours=open_hour), day + timedelta(hours=close_hour)
        if day.weekday() in days and at < closes:
            at = max(at, opens)
            if left <= closes - at:
                return at + left
            left -= closes - at
        day += timedelta(days=1)
        at = max(at, day)


def business_due(start: Column, minutes: Column, open_hour: int = 9, close_hour: int = 17, days: tuple[int, ...] = (0, 1, 2, 3, 4)) -> Column:
    """A due time in open hours, Monday being 0; an order-dependent walk, so in Arrow batches."""

    @F.pandas_udf("timestamp_ntz")
    def due(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for starts, amounts in batches:
            yield pd.Series([None if pd.isna(s) or pd.isna(m) else add_open_minutes(s.to_pydatetime(), int(m), open_hour, close_hour, frozenset(days)) for s, m in zip(starts, amounts)], dtype="datetime64[us]")

    return due(start.cast("timestamp_ntz"), minutes)


def cron_fields(expression: str) -> list[frozenset[int]]:
    """The five fields of a cron expression as sets; steps, ranges and lists are understood, names are not."""
    parts = expression.split()
    if len(parts) != 5:
        raise ValueError(f"a cron expression has five fields: {expression}")
    out = []
    for part, (low, high) in zip(parts, ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))):
        found: set[int] = set()
        for item in part.split(","):
            span, _, step = item.partition("/")
            a, _, b = span.partition("-")
            first, last = (low, high) if a == "*" else (int(a), int(b) if b else high if step else int(a))
            if not (low <= first <= last <= high) or step and int(step) < 1:
                raise ValueError(f"cron field out of range: {part}")
            found.update(range(first, last + 1, int(step or 1)))
        out.append(frozenset(x % 7 for x in found) if high == 7 else frozenset(found))
    return out


def next_cron(expression: str, after: datetime) -> datetime:
    """The next minute strictly after ``after`` at which the expression fires."""
    minutes, hours, days, months, weekdays = cron_fields(expression)
    any_day, any_week = expression.split()[2] == "*", expression.split()[4] == "*"
    at = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
    for _ in range(366 * 5):
        in_month, in_week = at.day in days, (at.weekday() + 1) % 7 in weekdays
        fits = in_month and in_week if any_day or any_week else in_month or in_week
        if at.month in months and fits:
            for h in sorted(x for x in hours if x >= at.hour):
                for m in sorted(x for x in minutes if h > at.hour or x >= at.minute):
                    return at.replace(hour=h, minute=m)
        at = (at + timedelta(days=1)).replace(hour=0, minute=0)
    raise ValueError(f"{expression} doesn't fire within five years")


def next_run(after: Column, expression: str, zone: str = "UTC") -> Column:
    """The next run of a cron expression in a time zone, in UTC."""
    from zoneinfo import ZoneInfo

    cron_fields(expression)

    @F.pandas_udf("timestamp_ntz")
    def run(moments: pd.Series) -> pd.Series:
        local, utc = ZoneInfo(zone), ZoneInfo("UTC")
        return pd.Series([None if pd.isna(t) else next_cron(expression, t.to_pydatetime().replace(tzinfo=utc).astimezone(local).replace(tzinfo=None)).replace(tzinfo=local).astimezone(utc).replace(tzinfo=None) for t in moments], dtype="datetime64[us]")

    return run(after.cast("timestamp_ntz"))
