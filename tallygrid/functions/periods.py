"""Periods: request arguments turned into the first and last instant of a report or vector."""

from __future__ import annotations

import calendar
from datetime import date, datetime, time, timedelta, timezone

from .axis import add_months

LAST_SECOND = time(23, 59, 59)
# The default span of a day grid, in days from now, and the default steps.
GRID_FIRST_DAY, GRID_LAST_DAY = -7, -1
FORECAST_DAYS_AHEAD = 14
INTRADAY_STEP = "03:00"
VECTOR_STEP = "1 day"


def instant(value) -> datetime:
    """A zone-less instant from a datetime, a date or ISO text; zoned values are taken at UTC."""
    if isinstance(value, datetime):
        found = value
    elif isinstance(value, date):
        found = datetime.combine(value, time())
    else:
        try:
            found = datetime.fromisoformat(str(value).strip())
        except ValueError as error:
            raise ValueError(f"not a date: {value!r}") from error
    return found.astimezone(timezone.utc).replace(tzinfo=None) if found.tzinfo else found


def midnight(value) -> datetime:
    return datetime.combine(instant(value).date(), time())


def end_of_day(value) -> datetime:
    return datetime.combine(instant(value).date(), LAST_SECOND)


def year_bounds(year: int) -> tuple[datetime, datetime]:
    year = int(year)
    return datetime(year, 1, 1), datetime(year, 12, 31, 23, 59, 59)


def month_bounds(month) -> tuple[datetime, datetime]:
    """First day at 00:00 and last day at 23:59:59 of ``YYYY-MM``."""
    try:
        first = datetime.strptime(str(month), "%Y-%m")
    except ValueError as error:
        raise ValueError(f"not a month: {month!r}") from error
    last = calendar.monthrange(first.year, first.month)[1]
    return first, first.replace(day=last, hour=23, minute=59, second=59)


def day_bounds(day) -> tuple[datetime, datetime]:
    return midnight(day), end_of_day(day)


def default_period(kind: str, now: datetime) -> tuple[datetime, datetime]:
    """Bounds used when a request names none; kind is ``grid``, ``day``, ``year``, ``vector`` or ``forecast``."""
    if kind == "grid":
        first, last = now + timedelta(days=GRID_FIRST_DAY), now + timedelta(days=GRID_LAST_DAY)
        return midnight(first), end_of_day(last)
    if kind == "day":
        return day_bounds(now)
    if kind == "year":
        return year_bounds(now.year)
    month_back = add_months(midnight(now), -1)
    if kind == "vector":
        return month_back, now
    if kind == "forecast":
        return month_back, now + timedelta(days=FORECAST_DAYS_AHEAD)
    raise ValueError(f"unknown period kind: {kind!r}")


def vector_bounds(start, end, kind: str = "vector", now: datetime | None = None) -> tuple[datetime, datetime]:
    """Given bounds, each replaced by its default when absent."""
    if start and end:
        return instant(start), instant(end)
    default_start, default_end = default_period(kind, now or datetime.now())
    return (instant(start) if start else default_start), (instant(end) if end else default_end)
