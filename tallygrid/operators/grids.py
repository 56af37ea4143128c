"""Labelled availability grids: entity × day, month, intraday step or run day."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.axis import Axis
from ..functions.periods import INTRADAY_STEP, day_bounds, default_period, end_of_day, midnight, month_bounds, year_bounds
from ..functions.steps import Step
from ..sources.model import Model
from .hits import hits
from .tally import cells, count_members, fill_rows, numbered

DAY, MONTH = Step(seconds=86400), Step(months=1)
# The variable whose default procedure is not 1, and that procedure.
ESTIMATED_VARIABLE, ESTIMATED_PROCEDURE, MEASURED_PROCEDURE = 4, 2, 1


@dataclass(frozen=True)
class Grid:
    """``rows`` are ``(y, entity, label, values)``, values being the counts along the axis; ``bound`` limits them."""

    rows: DataFrame
    axis: Axis
    names: str
    bound: DataFrame
    timed: bool = False

    def cells(self) -> DataFrame:
        """(x, y, t, entity, label, n) of every entity and bucket."""
        return cells(self.rows, self.axis, "entity", "label")

    def dates(self) -> list[str]:
        form = "%Y-%m-%dT%H:%M:%S" if self.timed else "%Y-%m-%d"
        return [self.axis.instant(i).strftime(form) for i in range(self.axis.size)]


def default_procedure(var_id: int, proc_id: int | None) -> int:
    if proc_id is not None:
        return proc_id
    return ESTIMATED_PROCEDURE if var_id == ESTIMATED_VARIABLE else MEASURED_PROCEDURE


def eligible(has_obs: bool) -> Column:
    """Enabled stations known to have observations; without ``has_obs``, those of which it is known whether."""
    return F.col("habilitar") & (F.col("has_obs") if has_obs else F.col("has_obs").isNotNull())


def optional_equal(column: str, value) -> Column:
    """Equality when a value is given; otherwise any value but null."""
    return F.col(column).isNotNull() if value is None else F.col(column) == value


def grid_stations(model: Model, tabla: str, var_id: int, proc_id: int | None, has_obs: bool):
    """(station columns…, series_id), one row for each matching series of an eligible station, and its bound."""
    series = model.table("series").where(
        (F.col("var_id") == var_id) & (F.col("proc_id") == default_procedure(var_id, proc_id)))
    stations = model.table("estaciones").where((F.col("tabla") == tabla) & eligible(has_obs))
    picked = series.select(F.col("id").alias("series_id"), F.col("estacion_id").alias("unid"))
    return picked.join(stations, "unid"), series


def station_rows(model: Model, axis: Axis, facts: DataFrame, tabla, var_id, proc_id, use_id, has_obs,
                 **texts: Column) -> DataFrame:
    """Rows ``(y, entity, texts…, values)`` of a station grid over the facts ``(series_id, x[, n])``, in the order of
    ``use_id``. Counts are per station."""
    stations, bound = grid_stations(model, tabla, var_id, proc_id, has_obs)
    order = [labels.station_key(use_id), F.col("unid"), F.col("series_id")]
    placed = numbered(stations, order, bound).select(
        "y", F.col("unid").alias("entity"), *[text.alias(name) for name, text in texts.items()])
    counts = count_members(facts, stations.select("series_id", F.col("unid").alias("entity")), ["entity"], bound)
    return fill_rows(placed, counts, ["entity"], axis)


def _station_grid(model, axis, last: datetime, tabla, var_id, proc_id, use_id, has_obs, timed=False) -> Grid:
    if not tabla or not var_id:
        raise ValueError("tabla and var_id are needed")
    facts = hits(model, "observaciones", axis, axis.start, last, closed=True)
    rows = station_rows(model, axis, facts, tabla, int(var_id), proc_id, use_id, has_obs,
                        label=labels.station_label(use_id))
    return Grid(rows, axis, "estaciones", model.table("series"), timed)


def _days(start, end, now) -> tuple[Axis, datetime]:
    if not start or not end:
        default_start, default_end = default_period("grid", now or datetime.now())
        start, end = start or default_start, end or default_end
    first, last = midnight(start), midnight(end)
    return Axis(first, last, DAY), end_of_day(last)


def day_grid(model: Model, tabla: str, var_id: int, start=None, end=None, month: str | None = None,
             proc_id: int | None = None, use_id: str | None = None, has_obs: bool = True, now=None) -> Grid:
    """Station × day of a network and variable, over a range or a month ``YYYY-MM``."""
    if month:
        start, end = month_bounds(month)
    axis, last = _days(start, end, now)
    return _station_grid(model, axis, last, tabla, var_id, proc_id, use_id, has_obs)


def year_grid(model: Model, tabla: str, var_id: int, year: int | None = None, proc_id: int | None = None,
              use_id: str | None = None, has_obs: bool = True, now=None) -> Grid:
    """Station × month of a year."""
    first, last = year_bounds(year) if year else default_period("year", now or datetime.now())
    return _station_grid(model, Axis(first, last, MONTH), last, tabla, var_id, proc_id, use_id, has_obs)


def intraday_grid(model: Model, tabla: str, var_id: int, day=None, dt=INTRADAY_STEP, proc_id: int | None = None,
                  use_id: str | None = None, has_obs: bool = True, now=None) -> Grid:
    """Station × step of one day."""
    first, last = day_bounds(day) if day else default_period("day", now or datetime.now())
    return _station_grid(model, Axis.of(first, last, dt), last, tabla, var_id, proc_id, use_id, has_obs, timed=True)


def area_grid(model: Model, source_id: int, start=None, end=None, var_id: int | None = None,
              proc_id: int | None = None, now=None) -> Grid:
    """Area × day of a source; variable and procedure are optional."""
    axis, last = _days(start, end, now)
    series = model.table("series_areal").where(
        optional_equal("var_id", var_id) & optional_equal("proc_id", proc_id) & (F.col("fuentes_id") == source_id))
    areas = model.table("areas_pluvio").where("activar and mostrar").select(F.col("unid").alias("entity"), "nombre")
    chosen = series.select(F.col("id").alias("series_id"), F.col("area_id").alias("entity")).join(areas, "entity")
    placed = numbered(chosen.withColumn("label", labels.name_and_id("entity")), [F.col("entity"), F.col("series_id")],
                      series)
    facts = hits(model, "observaciones_areal", axis, axis.start, last, closed=True)
    counts = count_members(facts, chosen.select("series_id", "entity"), ["entity"], series)
    return Grid(fill_rows(placed.select("y", "entity", "label"), counts, ["entity"], axis), axis, "areas", series)


def run_grid(model: Model, start=None, end=None, model_id: int | None = None, use_id: bool = True,
             match: str = "exact", now=None) -> Grid:
    """Calibration × day of model runs. Runs count at exactly midnight, or all day with ``match="day"``."""
    if match not in ("exact", "day"):
        raise ValueError(f"unknown match: {match!r}")
    axis, last = _days(start, end, now)
    with_runs = model.table("corridas").select(F.col("cal_id").alias("id")).distinct()
    calibrations = model.table("calibrados")
    chosen = calibrations.where(optional_equal("model_id", model_id)).join(with_runs, "id", "left_semi")
    order = [labels.calibration_key(use_id), F.col("id")]
    placed = numbered(chosen.withColumn("label", labels.calibration_label(use_id)), order, calibrations)
    runs = model.between("corridas", axis.start, last, closed=True, column="date")
    if match == "exact":
        runs = runs.where(F.col("date") == F.to_date("date").cast("timestamp_ntz"))
    counts = runs.groupBy(F.col("cal_id").alias("entity"), axis.bucket(F.col("date")).alias("x")).agg(
        F.count(F.lit(1)).alias("n"))
    rows = fill_rows(placed.select("y", F.col("id").alias("entity"), "label"), counts, ["entity"], axis)
    return Grid(rows, axis, "calibrados", calibrations)


def network_grid(model: Model, var_id: int, start=None, end=None, proc_id: int | None = None, has_obs: bool = True,
                 now=None) -> Grid:
    """Network × day: the observations of the eligible stations of every network."""
    axis, last = _days(start, end, now)
    series = model.table("series").where(
        (F.col("var_id") == var_id) & (F.col("proc_id") == default_procedure(var_id, proc_id)))
    stations = model.table("estaciones").where(eligible(has_obs)).select(
        F.col("unid").alias("estacion_id"), F.col("tabla").alias("tabla_id"))
    networks = model.table("redes").withColumnRenamed("id", "entity")
    chosen = series.withColumnRenamed("id", "series_id").join(stations, "estacion_id").join(networks, "tabla_id")
    facts = hits(model, "observaciones", axis, axis.start, last, closed=True)
    counts = count_members(facts, chosen.select("series_id", "entity"), ["entity"], series)
    placed = numbered(networks.withColumn("label", labels.name_and_id("entity")), [F.col("entity")],
                      networks)
    return Grid(fill_rows(placed.select("y", "entity", "label"), counts, ["entity"], axis), axis, "redes", networks)
