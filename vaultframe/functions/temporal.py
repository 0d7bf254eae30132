"""Date and time functions. The clock is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
# Expressions of a time span, in order of precedence.
TODAY, YESTERDAY = r"\btoday\b", r"\byesterday\b"
THIS_WEEK, LAST_WEEK, THIS_MONTH, LAST_MONTH = r"\bthis week\b", r"\blast week\b", r"\bthis month\b", r"\blast month\b"
DAYS_AGO, WEEKS_AGO, MONTHS_AGO = r"\b(\d+)\s*days?\s*ago\b", r"\b(\d+)\s*weeks?\s*ago\b", r"\b(\d+)\s*months?\s*ago\b"
SINCE_MONTH, IN_MONTH = rf"\bsince\s+({_MONTHS})\s*(\d{{4}})?\b", rf"\bin\s+({_MONTHS})\s*(\d{{4}})?\b"
LAST_DAYS = r"\blast\s+(\d+)\s*days?\b"
ALL_SPANS = [TODAY, YESTERDAY, THIS_WEEK, LAST_WEEK, THIS_MONTH, LAST_MONTH, DAYS_AGO, WEEKS_AGO, MONTHS_AGO, SINCE_MONTH, IN_MONTH, LAST_DAYS]
_MONTH_NAMES = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def has_constraint(q: Column) -> Column:
    return q.rlike("(?i)" + "|".join(f"(?:{p})" for p in ALL_SPANS))


def temporal_constraint(c, now: Column) -> Column:
    """struct(start_day, end_day), both inclusive, or null; the first expression that matches decides."""
    q = F.lower(F.col(c) if isinstance(c, str) else c)
    today = now.cast("date")
    number = lambda p: F.regexp_extract(q, p, 1).try_cast("int")

    def month_start(p: str) -> Column:
        name = F.substring(F.regexp_extract(q, p, 1), 1, 3)
        month = F.array_position(F.array(*map(F.lit, _MONTH_NAMES)), name).cast("int")
        year = F.coalesce(F.regexp_extract(q, p, 2).try_cast("int"), F.year(today))
        return F.make_date(year, F.greatest(month, F.lit(1)), F.lit(1))

    def span(start: Column, end: Column) -> Column:
        return F.struct(start.alias("start_day"), end.alias("end_day"))

    return (
        F.when(q.rlike(TODAY), span(today, today))
        .when(q.rlike(YESTERDAY), span(F.date_sub(today, 1), F.date_sub(today, 1)))
        .when(q.rlike(THIS_WEEK), span(F.date_sub(today, F.dayofweek(today) - 1), today))
        .when(q.rlike(LAST_WEEK), span(F.date_sub(today, 7), today))
        .when(q.rlike(THIS_MONTH), span(F.trunc(today, "month"), today))
        .when(q.rlike(LAST_MONTH), span(F.add_months(today, -1), today))
        .when(q.rlike(DAYS_AGO), span(F.date_sub(today, F.coalesce(number(DAYS_AGO), F.lit(0))), today))
        .when(q.rlike(WEEKS_AGO), span(F.date_sub(today, F.coalesce(number(WEEKS_AGO), F.lit(0)) * 7), today))
        .when(q.rlike(MONTHS_AGO), span(F.add_months(today, -F.coalesce(number(MONTHS_AGO), F.lit(0))), today))
        .when(q.rlike(SINCE_MONTH), span(month_start(SINCE_MONTH), today))
        .when(q.rlike(IN_MONTH), span(month_start(IN_MONTH), F.last_day(month_start(IN_MONTH))))
        .when(q.rlike(LAST_DAYS), span(F.date_sub(today, F.coalesce(number(LAST_DAYS), F.lit(7))), today))
    )


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days between two TIMESTAMP_NTZ columns."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86400e6)


def proximity(at: Column, start: Column, end: Column) -> Column:
    """1 at the centre of a span, 0 one span's width away from it; a span is a day at least."""
    width = F.greatest(days_between(end, start), F.lit(1.0))
    centre = days_between(at, start) - days_between(end, start) / 2
    return 1 - F.least(F.lit(1.0), F.abs(centre) / width)


def quiet_hours(at: Column, start: int, end: int) -> Column:
    """Is the hour in [start, end)? The window may pass midnight; equal bounds are an empty window."""
    hour = F.hour(at)
    if start == end:
        return F.lit(False)
    return (hour >= start) & (hour < end) if start < end else (hour >= start) | (hour < end)


def trend(age_days: Column, idle_days: Column, proofs: Column) -> Column:
    return F.when(age_days < 7, "NEW").when(idle_days > 60, "STALE").when(idle_days > 30, "WEAKENING").when((proofs >= 4) & (idle_days < 14), "STRENGTHENING").otherwise("STABLE")


def strict_timestamp(c) -> Column:
    """RFC 3339 text as a UTC time, or null if it is no valid calendar time."""
    t = F.col(c) if isinstance(c, str) else c
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(t))
