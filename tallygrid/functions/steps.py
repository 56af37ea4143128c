"""Time steps: the text of an interval turned into months or seconds."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Seconds or months in one unit.
SECONDS = {"second": 1, "sec": 1, "minute": 60, "min": 60, "hour": 3600, "day": 86400, "week": 604800}
MONTHS = {"month": 1, "mon": 1, "year": 12, "yr": 12}

# The steps offered for vectors and for one day.
VECTOR_STEPS = (
    "1 day", "2 days", "3 days", "7 days", "14 days", "1 month", "2 months", "3 months", "6 months", "1 year",
)
INTRADAY_STEPS = tuple(f"{minutes // 60:02d}:{minutes % 60:02d}" for minutes in range(15, 721, 15))

_PART = re.compile(r"(\d+)\s*([a-z]+)")
_CLOCK = re.compile(r"(\d{1,2}):(\d{2})(?::(\d{2}))?")


@dataclass(frozen=True)
class Step:
    """A positive step of either whole months or whole seconds, never both."""

    months: int = 0
    seconds: int = 0


def parse_interval(text: str) -> tuple[int, int]:
    """(months, seconds) of texts such as ``1 day``, ``3 months``, ``03:00`` or ``1 day 03:00:00``."""
    rest = str(text).strip().lower()
    months = seconds = 0
    if not rest:
        raise ValueError("empty interval")
    clock = _CLOCK.search(rest)
    if clock:
        hours, minutes, secs = (int(g or 0) for g in clock.groups())
        seconds += hours * 3600 + minutes * 60 + secs
        rest = rest.replace(clock.group(), " ", 1)
    for amount, unit in _PART.findall(rest):
        name = unit if unit in SECONDS or unit in MONTHS else unit.removesuffix("s")
        if name in SECONDS:
            seconds += int(amount) * SECONDS[name]
        elif name in MONTHS:
            months += int(amount) * MONTHS[name]
        else:
            raise ValueError(f"unknown unit in interval {text!r}")
    if _PART.sub("", rest).strip():
        raise ValueError(f"cannot read interval {text!r}")
    return months, seconds


def parse_step(text: str | Step) -> Step:
    """A step usable for an axis; zero, negative and mixed steps are refused."""
    if isinstance(text, Step):
        return text
    if not text:
        raise ValueError("a step is needed")
    months, seconds = parse_interval(text)
    if (months > 0) == (seconds > 0):
        raise ValueError(f"step must be whole months or a fixed span above zero: {text!r}")
    return Step(months, seconds)
