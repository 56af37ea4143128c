"""Calibration matrices from one pass over the forecasts.

A matrix of calibrations needs the forecasts for three things: which calibrations and series there are, how many series a
run covers, which is what each of its values counts, and the values of each bucket. One aggregation gives all three: the
forecasts of a run and series with their number in each bucket, and their first and last instant, also of those outside
the axis.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.axis import Axis, ntz
from ..functions.predicates import per_table
from ..functions.sizing import broadcast_if, fits
from ..sources.model import Model
from ..sources.schema import Kind
from . import catalog
from .forecasts import LAST_COVERAGE, RUN_FILTERS, VALUE_FILTERS, newest_runs, series_specs, spans
from .tally import zero_filled
from .vectors import members


def _flag(condition: Column | None) -> Column:
    return F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))


def _position(axis: Axis, time: str, also: Column | None = None) -> Column:
    """The bucket, or 0 outside the axis and where the condition does not hold."""
    inside = (F.col(time) >= ntz(axis.start)) & (F.col(time) < ntz(axis.stop))
    inside = F.coalesce(inside & _flag(also), F.lit(False))
    return F.when(inside, axis.bucket(F.when(inside, F.col(time)).otherwise(ntz(axis.start)))).otherwise(
        F.lit(0).cast("bigint"))


def _series(model: Model, kind: Kind, counted: dict, shown: dict) -> DataFrame:
    """(series_id, shown, times): whether a known series may be a row of the matrix, and how often its values count."""
    known = model.table(kind.series).withColumnRenamed("id", "series_id")
    known = known.select("series_id", _flag(shown.get("series")).alias("shown"))
    chosen, _ = members(model, kind, counted)
    times = chosen.groupBy("series_id").agg(F.count(F.lit(1)).alias("times"))
    found = known.join(times, "series_id", "left").select(
        "series_id", "shown", F.coalesce("times", F.lit(0).cast("bigint")).alias("times"))
    return broadcast_if(found, model.table(kind.series))


def _counts(hits: Column, size: int) -> Column:
    """The counts along the axis from ``(x, n)`` in any order, which may be none."""
    return zero_filled(F.when(F.size(hits) > 0, F.array_sort(hits)), size).alias("values")


def _by_calibration(opened: DataFrame, axis: Axis, weight: str = "1") -> DataFrame:
    """(cal_id, nombre, values) from ``(cal_id, nombre, x, n, shown)``; the weight may be over ``outside``, the sum of n at
    position 0."""
    by_bucket = opened.groupBy("cal_id", "nombre", "x").agg(F.sum("n").alias("n"), F.max("shown").alias("shown"))
    # A row for each bucket of a calibration.
    inside = F.when((F.col("x") > 0) & (F.col("n") > 0), F.struct("x", "n"))
    whole = by_bucket.groupBy("cal_id", "nombre").agg(
        F.max("shown").alias("shown"), F.max(F.when(F.col("x") == 0, F.col("n"))).alias("outside"),
        F.collect_list(inside).alias("hits"))
    weighed = F.transform("hits", lambda hit: F.struct(hit["x"].alias("x"), (hit["n"] * F.expr(weight)).cast("bigint").alias("n")))
    return whole.where("shown").select("cal_id", "nombre", _counts(weighed, axis.size))


def value_rows(model: Model, kind: Kind, axis: Axis, values: dict, ranged: dict, by_series: bool) -> DataFrame:
    """(cal_id, nombre, [series_id, cor_id,] values) of the newest runs of active calibrations; ``ranged`` is the filter of
    the rows, ``values`` that of what is counted."""
    counted = per_table(series_specs(kind, VALUE_FILTERS), values, kind.series)
    _, shown = catalog.calibration_conditions(ranged)
    runs = newest_runs(model).withColumn("counting", _flag(counted.get(LAST_COVERAGE)))
    runs = runs.join(catalog.active_calibrations(model, shown), "cal_id").select("cor_id", "cal_id", "nombre", "counting")
    runs = broadcast_if(runs, model.table("calibrados"))
    facts = model.table(kind.forecasts).join(runs.select("cor_id"), "cor_id", "left_semi")
    by_bucket = facts.groupBy("cor_id", "series_id", _position(axis, "timestart").alias("x")).agg(
        F.count(F.lit(1)).alias("n"), F.min("timestart").alias("begin_date"), F.max("timestart").alias("end_date"))
    # At most one element for each bucket.
    pairs = by_bucket.groupBy("cor_id", "series_id").agg(
        F.min("begin_date").alias("begin_date"), F.max("end_date").alias("end_date"),
        F.collect_list(F.when(F.col("x") > 0, F.struct("x", "n"))).alias("hits"))
    times = F.when(F.col("counting"), F.coalesce("times", F.lit(0))).otherwise(F.lit(0)).cast("bigint")
    # Null-safe, so that no condition on the series gets below the aggregation, whose runs' weights are of all series.
    series = _series(model, kind, counted, shown).where("series_id is not null").withColumnRenamed("series_id", "known_id")
    rows = pairs.join(runs, "cor_id").join(series, F.col("series_id").eqNullSafe(F.col("known_id")), "left").withColumns({
        "times": times, "shown": F.coalesce("shown", F.lit(False)) & _flag(shown.get("covered"))})
    if by_series:
        # Never true, but over all columns: so both uses of the pairs have one exchange, and the facts are read once.
        never = (F.col("begin_date") > F.col("end_date")) | (F.size("hits") < 0)
        one = F.when(never, 0).otherwise(1).cast("bigint")
        covered = pairs.groupBy("cor_id").agg(F.sum(one).alias("covered"))
        rows = rows.where("shown").join(broadcast_if(covered, model.table("calibrados")), "cor_id")
        weight = F.col("times") * F.col("covered")
        weighed = F.transform("hits", lambda hit: F.struct(hit["x"].alias("x"), (hit["n"] * weight).alias("n")))
        return rows.select("cal_id", "nombre", "series_id", "cor_id", _counts(weighed, axis.size))
    # Position 0 has a one for each series of the run, whose sum is what each of its values counts.
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    own = F.array(F.struct(zero.alias("x"), one.alias("n")))
    opened = rows.select("cal_id", "nombre", "shown", "times", F.explode(F.concat(own, F.col("hits"))).alias("hit")).select(
        "cal_id", "nombre", "hit.x", (F.col("hit.n") * F.when(F.col("hit.x") == 0, one).otherwise(F.col("times"))).alias("n"),
        "shown")
    return _by_calibration(opened, axis, "outside")


def run_rows(model: Model, kind: Kind, axis: Axis, values: dict, ranged: dict, by_series: bool) -> DataFrame:
    """(cal_id, nombre, [series_id, cor_id,] values) of all runs of active calibrations; a run counts once for each of its
    series."""
    counted = per_table(series_specs(kind, RUN_FILTERS), values, kind.series)
    _, shown = catalog.calibration_conditions(ranged)
    calibrations = model.table("calibrados")
    groups = calibrations.select(F.col("id").alias("cal_id"), _flag(counted.get("calibrados")).alias("grouped"))
    owners = broadcast_if(catalog.active_calibrations(model, shown).join(groups, "cal_id"), calibrations)
    runs = model.table("corridas").withColumn("x", _position(axis, "date", counted.get("corridas")))
    runs = runs.select(F.col("id").alias("cor_id"), "cal_id", "x").join(owners, "cal_id").withColumn(
        "x", F.when(F.col("grouped"), F.col("x")).otherwise(F.lit(0).cast("bigint")))
    small = fits(model.table("corridas"))
    runs = F.broadcast(runs) if small else runs
    # Too many runs to broadcast meet the forecasts after these have shrunk to their pairs.
    pairs = spans(model, kind, runs if small else None)
    rows = pairs.join(runs, "cor_id").join(_series(model, kind, counted, shown), "series_id").withColumn(
        "shown", F.col("shown") & _flag(shown.get("covered")))
    if by_series:
        hit = F.array(F.when((F.col("x") > 0) & (F.col("times") > 0), F.struct("x", F.col("times").alias("n"))))
        hits = F.filter(hit, lambda h: h.isNotNull())
        return rows.where("shown").select("cal_id", "nombre", "series_id", "cor_id", _counts(hits, axis.size))
    return _by_calibration(rows.select("cal_id", "nombre", "x", F.col("times").alias("n"), "shown"), axis)
