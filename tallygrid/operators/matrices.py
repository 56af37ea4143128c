"""Matrices: zero-filled counts of many entities at once, from a single aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.axis import Axis
from ..functions.labels import hour_label
from ..functions.periods import VECTOR_STEP, vector_bounds
from ..sources.model import Model
from ..sources.schema import Kind, kind_of
from . import catalog
from .forecasts import COVERAGE, LAST_COVERAGE, asked, value_counts
from .passes import run_rows, value_rows
from .tally import cells, fill_rows, numbered
from .vectors import observation_counts, station_counts


def _matrix(entities: DataFrame, counts: DataFrame, key: list[str], axis: Axis, order: list[str],
            bound: DataFrame) -> DataFrame:
    """(x, y, t, key…, label, n, hour); entities are ``(key…, label)`` and ``hour`` is the column label."""
    placed = numbered(entities, [F.col(c) for c in order], bound)
    return _cells(fill_rows(placed, counts, key, axis), [*key, *order], axis)


def _cells(rows: DataFrame, columns: list[str], axis: Axis) -> DataFrame:
    return cells(rows, axis, *dict.fromkeys([*columns, "label"])).withColumn("hour", hour_label(F.col("t")))


def network_matrix(model: Model, start=None, end=None, dt=VECTOR_STEP, filter=None, count: str = "registros",
                   now=None) -> DataFrame:
    """Network × bucket: observations, or distinct stations with ``count="estaciones"``."""
    start, end = vector_bounds(start, end, "vector", now)
    axis = Axis.of(start, end, dt)
    if count == "estaciones":
        counts = station_counts(model, axis, end, filter or {}, ["tabla_id"])
    else:
        counts = observation_counts(model, kind_of("puntual"), axis, end, filter or {}, ["tabla_id"])
    networks = model.table("redes")
    entities = networks.select("id", "tabla_id", F.col("nombre").alias("label"))
    return _matrix(entities, counts, ["tabla_id"], axis, ["id"], networks)


def source_matrix(model: Model, start=None, end=None, dt=VECTOR_STEP, filter=None, now=None) -> DataFrame:
    """Source × bucket of areal observations."""
    start, end = vector_bounds(start, end, "vector", now)
    axis = Axis.of(start, end, dt)
    counts = observation_counts(model, kind_of("areal"), axis, end, filter or {}, ["fuentes_id"])
    sources = model.table("fuentes")
    entities = sources.select(F.col("id").alias("fuentes_id"), F.col("nombre").alias("label"))
    return _matrix(entities, counts, ["fuentes_id"], axis, ["fuentes_id"], sources)


def raster_matrix(model: Model, start=None, end=None, dt=VECTOR_STEP, filter=None, now=None) -> DataFrame:
    """Raster series × bucket of raster observations."""
    start, end = vector_bounds(start, end, "vector", now)
    axis = Axis.of(start, end, dt)
    counts = observation_counts(model, kind_of("raster"), axis, end, filter or {}, ["series_id"])
    entities = catalog.raster_names(model).select(F.col("id").alias("series_id"), F.col("nombre").alias("label"))
    return _matrix(entities, counts, ["series_id"], axis, ["series_id"], model.table("series_rast"))


def _with_range(values: dict, kind: Kind, start, end) -> dict:
    """The calibration filter of a matrix: its filter, kind and range."""
    return {**values, "tipo": kind.tipo, "timestart": start, "timeend": end}


def _calibrations(model: Model, start, end, dt, filter, count, now, key: list[str], bound) -> DataFrame:
    """The matrix of calibrations, or of their series and runs. Where the source stores coverage, this says which rows there
    are and what values count; otherwise all comes from one pass over the forecasts."""
    start, end = vector_bounds(start, end, "forecast", now)
    axis = Axis.of(start, end, dt)
    values, kind, count = asked(filter, None, count)
    ranged, by_series = _with_range(values, kind, start, end), len(key) > 1
    order = [F.col(c) for c in key]
    labels = [F.col(c).cast("string") for c in key] if by_series else [F.col("cal_id").cast("string"), F.col("nombre")]
    label = F.concat_ws(" - ", *labels)
    if count == "corridas" or not model.stored_views & {COVERAGE, LAST_COVERAGE}:
        rows = (run_rows if count == "corridas" else value_rows)(model, kind, axis, values, ranged, by_series)
        placed = numbered(rows.withColumn("label", label), order, model.table(bound(kind)))
        return _cells(placed, key, axis)
    found = (catalog.calibration_series(model, ranged, count, named=False) if by_series
             else catalog.calibration_rows(model, ranged, count))
    entities = found.withColumnRenamed("id", "cal_id").withColumn("label", label).select(*key, "label")
    return _matrix(entities, value_counts(model, kind, axis, values, key), key, axis, key, model.table(bound(kind)))


def calibration_matrix(model: Model, start=None, end=None, dt=VECTOR_STEP, filter=None, count: str | None = None,
                       now=None) -> DataFrame:
    """Calibration × bucket: forecast values of the newest run, or runs with ``count="corridas"``."""
    return _calibrations(model, start, end, dt, filter, count, now, ["cal_id"], lambda kind: "calibrados")


def calibration_series_matrix(model: Model, start=None, end=None, dt=VECTOR_STEP, filter=None,
                              count: str | None = None, now=None) -> DataFrame:
    """Calibration, series and run × bucket, for one kind of series."""
    return _calibrations(model, start, end, dt, filter, count, now, ["cal_id", "series_id", "cor_id"],
                         lambda kind: kind.forecasts)
