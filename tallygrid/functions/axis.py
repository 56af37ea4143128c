"""Time axes: bucket instants, the bucket of a row, and the length of a vector.

A bucket number is arithmetic on the row itself, so no fact row is ever joined to the axis. Everything here works on
``timestamp_ntz`` and does not depend on the session time zone.
"""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .steps import Step, parse_step

# Rows of an axis that one task writes.
ROWS_PER_TASK = 100_000


def ntz(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def elapsed_seconds(ts: Column, origin: datetime) -> Column:
    """Whole seconds from origin to ts, for ts at or after origin."""
    return (ts - ntz(origin)).cast("interval second").cast("bigint")


def add_months(value: datetime, months: int) -> datetime:
    year, month0 = divmod(value.year * 12 + value.month - 1 + months, 12)
    day = min(value.day, calendar.monthrange(year, month0 + 1)[1])
    return value.replace(year=year, month=month0 + 1, day=day)


@dataclass(frozen=True)
class Axis:
    """Instants ``start, start+step, …`` up to and including ``end``.

    ``cycle`` (seconds, fixed steps only) restarts the steps at every multiple of it, as a multi-day run of one-day
    axes does when the step does not divide the day.
    """

    start: datetime
    end: datetime
    step: Step
    cycle: int | None = None

    @classmethod
    def of(cls, start: datetime, end: datetime, step: str | Step) -> "Axis":
        return cls(start, end, parse_step(step))

    @cached_property
    def _month_instants(self) -> list[datetime]:
        """Month steps: every instant plus the one after the last. Each is the previous plus one step, so buckets
        meet without gaps also from the 29th, 30th and 31st."""
        instants = [self.start]
        while instants[-1] <= self.end:
            instants.append(add_months(instants[-1], self.step.months))
        return instants

    @property
    def _per_cycle(self) -> int:
        return -(-self.cycle // self.step.seconds)

    @cached_property
    def size(self) -> int:
        if self.end < self.start:
            return 0
        if self.step.months:
            return len(self._month_instants) - 1
        span = int((self.end - self.start) / timedelta(seconds=1))
        if self.cycle:
            whole, rest = divmod(span, self.cycle)
            return whole * self._per_cycle + rest // self.step.seconds + 1
        return span // self.step.seconds + 1

    def instant(self, position: int) -> datetime:
        """The instant at a 0-based position."""
        if self.step.months:
            return self._month_instants[position]
        if self.cycle:
            whole, rest = divmod(position, self._per_cycle)
            return self.start + timedelta(seconds=whole * self.cycle + rest * self.step.seconds)
        return self.start + timedelta(seconds=position * self.step.seconds)

    @property
    def stop(self) -> datetime:
        """First instant after the last bucket."""
        return self.instant(self.size) if self.size else self.start

    def at(self, x: Column) -> Column:
        """The instant of a 1-based position."""
        if self.step.months:
            return F.element_at(F.array(*[ntz(t) for t in self._month_instants]), x.cast("int"))
        if self.cycle:
            seconds = _div(x - 1, self._per_cycle) * self.cycle + (x - 1) % self._per_cycle * self.step.seconds
        else:
            seconds = (x - 1) * self.step.seconds
        return ntz(self.start) + seconds * F.expr("interval '1' second")

    def bucket(self, ts: Column) -> Column:
        """1-based bucket of an instant that lies in ``[start, stop)``.

        It is never null, so that no join on it makes the scan compute it a second time to drop nulls.
        """
        return F.coalesce(self._bucket(ts), F.lit(0))

    def _bucket(self, ts: Column) -> Column:
        if self.step.months:
            gap = (F.year(ts) - self.start.year) * 12 + F.month(ts) - self.start.month
            guess = _div(gap, self.step.months).cast("int")
            floor = F.element_at(F.array(*[ntz(t) for t in self._month_instants]), guess + 1)
            return (guess + F.when(ts < floor, 0).otherwise(1)).cast("bigint")
        seconds = elapsed_seconds(ts, self.start)
        if self.cycle:
            inside = _div(seconds % self.cycle, self.step.seconds)
            return _div(seconds, self.cycle) * self._per_cycle + inside + 1
        return _div(seconds, self.step.seconds) + 1

    def frame(self, spark: SparkSession) -> DataFrame:
        """(x, t) with x from 1."""
        tasks = 1 + self.size // ROWS_PER_TASK
        x = F.col("id") + 1
        return spark.range(0, self.size, 1, tasks).select(x.alias("x"), self.at(x).alias("t"))


def _div(value: Column, by: int) -> Column:
    return F.call_function("div", value, F.lit(by))
