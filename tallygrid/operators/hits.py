"""Observations by bucket, from stored tallies of whole days where a model has them, and from the observations otherwise."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.axis import Axis, ntz
from ..sources.model import Model
from .tally import where

DAY, TICK = timedelta(days=1), timedelta(microseconds=1)
# Ranges of observations beside the stored days, above which a request reads the observations of its whole range.
MOST_RANGES = 64
# The name under which the stations of each day are stored.
STATIONS = "estaciones"

Span = tuple[date, date]


def split(axis: Axis, low: datetime, high: datetime, closed: bool, stored: list[Span]) -> tuple[list[Span], list[tuple]] | None:
    """The stored days that a request can take, and the ranges ``(low, high, closed)`` left to the observations; None where
    these are all, or too many."""
    if not axis.size or axis.cycle or high <= low or (axis.step.seconds and axis.step.seconds < DAY.total_seconds()):
        return None
    edges = {axis.instant(i).date() for i in range(axis.size + 1) if axis.instant(i).time() != time()}
    end, spans, ranges, at = high + TICK if closed else high, [], [], low
    for first, after in sorted(stored):
        day = max(first, low.date())
        while day < after and datetime.combine(day + DAY, time()) <= end:
            start = datetime.combine(day, time())
            if start >= low and day not in edges:
                if spans and spans[-1][1] == day:
                    spans[-1] = (spans[-1][0], day + DAY)
                else:
                    spans.append((day, day + DAY))
                    if at < start:
                        ranges.append((at, start, False))
                at = start + DAY
            day += DAY
    if at < end:
        ranges.append((at, high, closed))
    return (spans, ranges) if spans and len(ranges) <= MOST_RANGES else None


def hits(model: Model, table: str, axis: Axis, low: datetime, high: datetime, closed: bool = False) -> DataFrame:
    """(series_id, x[, n]): observations by bucket; with ``n`` where stored days take their part."""
    x = axis.bucket(F.col("timestart")).alias("x")
    facts = model.between(table, low, high, closed)
    parted = split(axis, low, high, closed, model.tallies.spans(table)) if model.tallies else None
    if not parted:
        return facts.select("series_id", x)
    spans, ranges = parted
    stored = model.tallies.counts(table, spans).select(
        "series_id", axis.bucket(F.col("day").cast("timestamp_ntz")).alias("x"), "n")
    if not ranges:
        return stored
    rest = facts.where(_within(ranges)).select("series_id", x, F.lit(1).cast("bigint").alias("n"))
    return stored.unionByName(rest)


def _within(ranges: list[tuple]) -> Column:
    moment = F.col("timestart")
    return reduce(lambda a, b: a | b, [
        (moment >= ntz(low)) & ((moment <= ntz(high)) if closed else (moment < ntz(high))) for low, high, closed in ranges])


def stations_seen(rows: DataFrame, *also: str) -> DataFrame:
    """(also…, tabla_id, var_id, proc_id, unit_id, slot, seen): bitmaps of the stations of rows with ``estacion_id``."""
    slot = F.bitmap_bucket_number("estacion_id").alias("slot")
    return rows.groupBy(*also, "tabla_id", "var_id", "proc_id", "unit_id", slot).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("estacion_id")).alias("seen"))


def point_members(series: DataFrame, model: Model, conditions: dict) -> DataFrame:
    """Series with a known station in a known network, as ``(series_id, …, tabla_id, red_id)``."""
    stations = model.table("estaciones").select(F.col("unid").alias("estacion_id"), F.col("tabla").alias("tabla_id"))
    networks = where(model.table("redes"), conditions.get("redes")).select("tabla_id", F.col("id").alias("red_id"))
    return series.withColumnRenamed("id", "series_id").join(stations, "estacion_id").join(networks, "tabla_id")


def station_hits(model: Model, axis: Axis, high: datetime, conditions: dict, keys: list[str]) -> DataFrame | None:
    """(keys…, x, n): distinct stations from the stored bitmaps of whole days and those of the observations of other times; None
    where no stored day can be taken."""
    parted = split(axis, axis.start, high, False, model.tallies.spans(STATIONS)) if model.tallies else None
    if not parted:
        return None
    spans, ranges = parted
    chosen = [conditions[table] for table in ("series", "redes") if table in conditions]
    bits = model.tallies.stations(spans)
    for condition in chosen:
        bits = bits.where(condition)
    bits = bits.select(*keys, axis.bucket(F.col("day").cast("timestamp_ntz")).alias("x"), "slot", "seen")
    if ranges:
        members = point_members(where(model.table("series"), conditions.get("series")), model, conditions)
        facts = model.between("observaciones", axis.start, high).where(_within(ranges))
        facts = facts.select("series_id", axis.bucket(F.col("timestart")).alias("x")).distinct()
        rest = stations_seen(facts.join(members, "series_id"), "x").select(*keys, "x", "slot", "seen")
        bits = bits.unionByName(rest)
    joined = bits.groupBy(*keys, "x", "slot").agg(F.bitmap_or_agg("seen").alias("seen"))
    return joined.groupBy(*keys, "x").agg(F.sum(F.bitmap_count("seen")).alias("n"))
