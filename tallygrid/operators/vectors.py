"""Density vectors: counts for each bucket of a time axis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.axis import Axis
from ..functions.periods import VECTOR_STEP, vector_bounds
from ..functions.predicates import Spec, per_table, require_any
from ..sources.model import Model
from ..sources.schema import Kind, kind_of
from .hits import hits, point_members, station_hits
from .tally import count_members, vector, where

POINT_FILTERS = {
    "var_id": Spec("integer", "series"),
    "tabla_id": Spec("string", "redes"),
    "unit_id": Spec("integer", "series"),
    "estacion_id": Spec("integer", "series"),
    "proc_id": Spec("integer", "series"),
}
AREAL_FILTERS = {
    "var_id": Spec("integer", "series_areal"),
    "fuentes_id": Spec("integer", "series_areal"),
    "unit_id": Spec("integer", "series_areal"),
    "area_id": Spec("integer", "series_areal"),
    "proc_id": Spec("integer", "series_areal"),
}
RASTER_FILTERS = {
    "var_id": Spec("integer", "series_rast"),
    "fuentes_id": Spec("integer", "series_rast"),
    "unit_id": Spec("integer", "series_rast"),
    "escena_id": Spec("integer", "series_rast"),
    "proc_id": Spec("integer", "series_rast"),
    "series_id": Spec("integer", "observaciones_rast"),
}
OBSERVATION_FILTERS = {"puntual": POINT_FILTERS, "areal": AREAL_FILTERS, "raster": RASTER_FILTERS}


def members(model: Model, kind: Kind, conditions: dict) -> tuple[DataFrame, DataFrame]:
    """Selected series of a kind with the attributes they are counted by, and the frame that bounds them."""
    series = where(model.table(kind.series), conditions.get(kind.series))
    if kind.tipo == "puntual":
        return point_members(series, model, conditions), series
    return series.withColumnRenamed("id", "series_id"), series


def observation_counts(model: Model, kind: Kind, axis: Axis, end, values: dict, keys: list[str]) -> DataFrame:
    """(keys…, x, n) of the observations before ``end``."""
    conditions = per_table(OBSERVATION_FILTERS[kind.tipo], values)
    facts = where(hits(model, kind.observations, axis, axis.start, min(end, axis.stop)), conditions.get(kind.observations))
    chosen, bound = members(model, kind, conditions)
    return count_members(facts, chosen.select("series_id", *keys), keys, bound)


def _observations(model, tipo, start, end, dt, filter, now) -> DataFrame:
    start, end = vector_bounds(start, end, "vector", now)
    axis, values = Axis.of(start, end, dt), filter or {}
    kind = kind_of(tipo)
    require_any(OBSERVATION_FILTERS[kind.tipo], values)
    return vector(model.spark, axis, observation_counts(model, kind, axis, end, values, []))


def obs_density(model: Model, start=None, end=None, dt=VECTOR_STEP, filter=None, now=None) -> DataFrame:
    """(x, t, n): point observations for each bucket."""
    return _observations(model, "puntual", start, end, dt, filter, now)


def areal_density(model: Model, start=None, end=None, dt=VECTOR_STEP, filter=None, now=None) -> DataFrame:
    """(x, t, n): areal observations for each bucket."""
    return _observations(model, "areal", start, end, dt, filter, now)


def raster_density(model: Model, start=None, end=None, dt=VECTOR_STEP, filter=None, now=None) -> DataFrame:
    """(x, t, n): raster observations for each bucket."""
    return _observations(model, "raster", start, end, dt, filter, now)


def station_counts(model: Model, axis: Axis, end, values: dict, keys: list[str]) -> DataFrame:
    """(keys…, x, n): distinct stations with observations, from stored bitmaps where the model has them. Otherwise one row
    for each station and bucket comes first, so that the distinct count is a plain count."""
    if values.get("estacion_id") is None:
        stored = station_hits(model, axis, min(end, axis.stop), per_table(POINT_FILTERS, values), keys)
        if stored is not None:
            return stored
    seen = observation_counts(model, kind_of("puntual"), axis, end, values, ["estacion_id", *keys])
    return seen.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("n"))


def station_density(model: Model, start=None, end=None, dt=VECTOR_STEP, filter=None, now=None) -> DataFrame:
    """(x, t, n): distinct stations with observations for each bucket."""
    start, end = vector_bounds(start, end, "vector", now)
    axis, values = Axis.of(start, end, dt), filter or {}
    require_any(POINT_FILTERS, values)
    return vector(model.spark, axis, station_counts(model, axis, end, values, []))


def as_arrays(rows: DataFrame, include_timestamps: bool = False) -> DataFrame:
    """One row ``(values[, timestamps])`` of a vector, as long as its axis."""
    ordered = rows.agg(F.array_sort(F.collect_list(F.struct("x", "t", "n"))).alias("v"))
    columns = [F.col("v.n").alias("values")]
    if include_timestamps:
        columns.append(F.col("v.t").alias("timestamps"))
    return ordered.select(*columns)


def as_tuples(rows: DataFrame) -> DataFrame:
    """One row with the array of ``(x, t, count)`` of a vector."""
    return rows.agg(F.array_sort(F.collect_list(F.struct("x", "t", F.col("n").alias("count")))).alias("tuples"))
