"""Typed filters: a dict of request values and a dict of column specs become conditions.

Conditions are kept per table, so that each can be applied to its own table before any join and reach the scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .axis import add_months, ntz
from .geometry import near, shape_of
from .periods import instant
from .steps import SECONDS, MONTHS, parse_interval

# Fixed values.
UNSAFE = re.compile("[';]")
TRUTHY = re.compile("[yYtTvVsS1]")
TRUNC_FIELDS = (
    "microseconds", "milliseconds", "second", "minute", "hour", "day", "week", "month", "quarter", "year",
    "decade", "century", "millennium",
)
NEAR_DEGREES = 0.001
MONTH_SECONDS = 30 * 86400
RANGE_KEYS = ("timestart", "timeend", "dt")

_INTEGER = re.compile(r"\s*([+-]?\d+)")
_YEAR_MONTH = r"^interval '(-?)(\d+)-(\d+)' year to month$"
_DAY_TIME = r"^interval '(-?)(\d+) (\d+):(\d+):(\d+(?:\.\d+)?)' day to second$"
_CLOCK = r"([+-]?)(\d{1,2}):(\d{2})(?::(\d{2}))?$"
_FLOAT = re.compile(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")


class NotNull:
    """As a filter value of any type: the column is not null."""


NOT_NULL = NotNull()


@dataclass(frozen=True)
class Spec:
    type: str | None = None
    table: str | None = None
    column: str | None = None
    required: bool = False
    trunc: str | None = None
    case_insensitive: bool = False


def integer(value) -> int | None:
    """The leading integer of a value, as ``12`` of ``12abc``; None without one."""
    found = None if isinstance(value, bool) else _INTEGER.match(str(value))
    return int(found.group(1)) if found else None


def number(value) -> float | None:
    found = None if isinstance(value, bool) else _FLOAT.match(str(value))
    return float(found.group(1)) if found else None


def truthy(value) -> bool:
    return bool(TRUTHY.match(str(value)))


def clean_filter(query: dict[str, Any], keep_range: bool = False) -> dict[str, Any]:
    """A request's filter: without absent and empty values and, unless kept, without the range."""
    dropped = ("dt",) if keep_range else RANGE_KEYS
    return {k: v for k, v in query.items() if k not in dropped and v is not None and v != ""}


def require_any(specs: dict[str, Spec], values: dict[str, Any]) -> None:
    """At least one known filter with a truthy value; 0 does not count as one."""
    if not any(values.get(key) for key in specs):
        raise ValueError("give one of these filters: " + ", ".join(specs))


def trunc_span(field: str, value: datetime) -> tuple[datetime, datetime]:
    """``[first, after)`` of the unit of time around value."""
    if field not in TRUNC_FIELDS:
        raise ValueError(f"no unit of time to cut to: {field!r}")
    if field in ("microseconds", "milliseconds"):
        size = 1 if field == "microseconds" else 1000
        first = value.replace(microsecond=value.microsecond // size * size)
        return first, first + timedelta(microseconds=size)
    first = value.replace(microsecond=0)
    if field == "second":
        return first, first + timedelta(seconds=1)
    first = first.replace(second=0)
    if field == "minute":
        return first, first + timedelta(minutes=1)
    first = first.replace(minute=0)
    if field == "hour":
        return first, first + timedelta(hours=1)
    first = first.replace(hour=0)
    if field == "day":
        return first, first + timedelta(days=1)
    if field == "week":
        first -= timedelta(days=first.weekday())
        return first, first + timedelta(days=7)
    months = {"month": 1, "quarter": 3}.get(field)
    if months:
        first = first.replace(day=1, month=(first.month - 1) // months * months + 1)
        return first, add_months(first, months)
    # Decades start at years ending in 0, centuries and millennia at years ending in 1.
    years, offset = {"year": (1, 0), "decade": (10, 0), "century": (100, 1), "millennium": (1000, 1)}[field]
    first = first.replace(day=1, month=1, year=max(1, (first.year - offset) // years * years + offset))
    return first, first.replace(year=(first.year - offset) // years * years + offset + years)


def interval_seconds(column: Column) -> Column:
    """Length in seconds of an interval column or of text such as ``1 day``, ``-2 months`` or ``1 day 03:00:00``, a month
    being 30 days; null where the text cannot be read. Signs count."""
    text = F.lower(F.trim(column.cast("string")))

    def group(pattern: str, i: int) -> Column:
        found = F.regexp_extract(text, pattern, i)
        return F.when(found != "", found.cast("decimal(38,6)")).otherwise(F.lit(0))

    def signed(pattern: str, size: Column) -> Column:
        return F.when(text.rlike(pattern), F.when(F.regexp_extract(text, pattern, 1) == "-", -size).otherwise(size))

    # As Spark writes its two interval types.
    years = signed(_YEAR_MONTH, (group(_YEAR_MONTH, 2) * 12 + group(_YEAR_MONTH, 3)) * MONTH_SECONDS)
    days = signed(_DAY_TIME, sum(
        (group(_DAY_TIME, i) * size for i, size in ((3, 3600), (4, 60), (5, 1))), group(_DAY_TIME, 2) * 86400))
    units = {**SECONDS, **{unit: months * MONTH_SECONDS for unit, months in MONTHS.items()}}
    plain = sum((group(rf"([+-]?\d+)\s*{unit}s?(?![a-z])", 1) * size for unit, size in units.items()), F.lit(0))
    clock = group(_CLOCK, 2) * 3600 + group(_CLOCK, 3) * 60 + group(_CLOCK, 4)
    plain = plain + F.when(F.regexp_extract(text, _CLOCK, 1) == "-", -clock).otherwise(clock)
    names = "|".join(sorted(units, key=len, reverse=True))
    readable = text.rlike(rf"^(?=.)(?:[+-]?\d+\s*(?:{names})s?(?![a-z])\s*)*(?:[+-]?\d{{1,2}}:\d{{2}}(?::\d{{2}})?)?$")
    return F.coalesce(years, days, F.when(readable, plain))


def _items(value) -> list:
    return list(value) if isinstance(value, (list, tuple, set)) else [value]


def _is_list(value) -> bool:
    return isinstance(value, (list, tuple, set))


def _one_or_many(column: Column, value, values: list, what: str) -> Column:
    values = [v for v in values if v is not None]
    if not values:
        raise ValueError(f"not of type {what}: {value!r}")
    return column.isin(values) if _is_list(value) else column == F.lit(values[0])


def _string(column: Column, value, spec: Spec) -> Column:
    fold = F.lower if spec.case_insensitive else (lambda c: c)
    if not _is_list(value):
        return fold(column) == fold(F.lit(str(value)))
    values = [str(v) for v in value if v is not None and str(v) != ""]
    if not values:
        raise ValueError("a list of texts without any text")
    return fold(column).isin([v.lower() for v in values] if spec.case_insensitive else values)


def _range(column: Column, value) -> Column:
    if not _is_list(value):
        return column == _needed_number(value)
    ends = list(value)
    if len(ends) < 2:
        raise ValueError("a range of numbers has two ends")
    return (column >= _needed_number(ends[0])) & (column <= _needed_number(ends[1]))


def _needed_number(value) -> Column:
    found = number(value)
    if found is None:
        raise ValueError(f"not a number: {value!r}")
    return F.lit(found)


def _date(column: Column, value, spec: Spec) -> Column:
    moment = instant(value)
    if spec.trunc is None:
        return column == ntz(moment)
    first, after = trunc_span(spec.trunc, moment)
    return (column >= ntz(first)) & (column < ntz(after))


def _interval(column: Column, value) -> Column:
    months, seconds = parse_interval(value)
    return interval_seconds(column) == months * MONTH_SECONDS + seconds


def _condition(column: Column, spec: Spec, value) -> Column | None:
    kind = spec.type
    if kind == "regex_string":
        return column.rlike("(?i)" + str(value))
    if kind == "string":
        return _string(column, value, spec)
    if kind == "boolean":
        return column == F.lit(truthy(value))
    if kind == "boolean_only_true":
        return column == F.lit(True) if truthy(value) else None
    if kind == "boolean_only_false":
        return None if truthy(value) else column == F.lit(False)
    if kind == "geometry":
        return near(column, shape_of(value), NEAR_DEGREES)
    if kind in ("date", "timestamp"):
        return _date(column, value, spec)
    if kind in ("timestart", "greater_or_equal_date"):
        return column >= ntz(instant(value))
    if kind in ("timeend", "smaller_or_equal_date"):
        return column <= ntz(instant(value))
    if kind == "numeric_interval":
        return _range(column, value)
    if kind == "numeric_min":
        return column >= _needed_number(value)
    if kind == "numeric_max":
        return column <= _needed_number(value)
    if kind == "integer":
        return _one_or_many(column, value, [integer(v) for v in _items(value)], "integer")
    if kind in ("number", "float"):
        return _one_or_many(column, value, [number(v) for v in _items(value)], "float")
    if kind == "interval":
        return _interval(column, value)
    if kind is None:
        return _one_or_many(column, value, _items(value), "value")
    raise ValueError(f"unknown filter type: {kind}")


def _unsafe(value) -> bool:
    if isinstance(value, (datetime, date, dict)):
        return False
    return any(UNSAFE.search(str(v)) for v in _items(value))


def per_table(specs: dict[str, Spec], values: dict[str, Any], default_table: str = "",
              qualify: bool = False) -> dict[str, Column]:
    """One condition for each table that has any; every error found is reported in a single ``ValueError``."""
    found: dict[str, list[Column]] = {}
    errors: list[str] = []
    for key, spec in specs.items():
        value = values.get(key)
        table = spec.table or default_table
        name = spec.column or key
        column = F.col(f"{table}.{name}" if qualify and table else name)
        if isinstance(value, NotNull):
            found.setdefault(table, []).append(column.isNotNull())
            continue
        if value is None:
            if spec.required:
                errors.append(f"{key} must be given")
            continue
        if _unsafe(value):
            errors.append(f"characters that are not allowed in {key}")
            continue
        try:
            condition = _condition(column, spec, value)
        except ValueError as error:
            errors.append(str(error))
            continue
        if condition is not None:
            found.setdefault(table, []).append(condition)
    if errors:
        raise ValueError("the filter cannot be used:\n" + "\n".join(errors))
    return {table: reduce(lambda a, b: a & b, conditions) for table, conditions in found.items()}


def build(specs: dict[str, Spec], values: dict[str, Any], default_table: str = "") -> Column:
    """All conditions joined by AND over qualified columns, for frames that carry table aliases."""
    conditions = per_table(specs, values, default_table, qualify=True)
    return reduce(lambda a, b: a & b, conditions.values(), F.lit(True))
