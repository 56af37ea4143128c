"""Catalogue lookups: networks, variables, procedures, units, sources, groups, series and calibrations."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import Spec, per_table
from ..functions.sizing import broadcast_if
from ..sources.model import Model
from ..sources.schema import KINDS, Kind, kind_of
from .forecasts import LAST_COVERAGE, newest_runs, spans
from .tally import where

_UNSAFE = re.compile(r"[';\s]")
# Series ids of one list of nested series.
IDS_PER_LIST = 1000

CALIBRATION_FILTERS = {
    "cal_grupo_id": Spec("integer", "calibrados", "grupo_id"),
    "cal_id": Spec("integer", "calibrados", "id"),
    "series_id": Spec("integer", "series"),
    "var_id": Spec("integer", "series"),
    "unit_id": Spec("integer", "series"),
    "timestart": Spec("timestart", "covered", "end_date"),
    "timeend": Spec("timeend", "covered", "begin_date"),
    "estacion_id": Spec("integer", "series"),
    "area_id": Spec("integer", "series"),
    "escena_id": Spec("integer", "series"),
}
SERIES_COLUMNS = (
    "series_id", "series_table", "estacion_id", "tabla", "var_id", "cor_id", "begin_date", "end_date", "count",
    "qualifiers", "tipo", "proc_id", "unit_id", "fuentes_id", "estacion_nombre", "fuentes_nombre", "var_var",
    "var_nombre", "var_timeSupport", "proc_nombre", "unit_nombre", "unit_abrev",
)
# The same, in the order of nested series.
LISTED_COLUMNS = ("series_table", "series_id", "cor_id", *[
    c for c in SERIES_COLUMNS if c not in ("series_table", "series_id", "cor_id")])


def chosen(frame: DataFrame, wanted, code: str | None = None) -> DataFrame:
    """All rows, those with a numeric id, or those with a code where the table has one."""
    if wanted is None or wanted == "" or wanted == 0:
        return frame
    if re.fullmatch(r"\d+", str(wanted)):
        return frame.where(F.col("id") == int(wanted))
    if code is None or _UNSAFE.search(str(wanted)):
        raise ValueError(f"parameter has characters that are not allowed: {wanted!r}")
    return frame.where(F.col(code) == str(wanted))


def networks(model: Model, tabla=None) -> DataFrame:
    return chosen(model.table("redes"), tabla, "tabla_id").orderBy("id")


def variables(model: Model, var_id=None) -> DataFrame:
    return chosen(model.table("var"), var_id, "var").orderBy("id")


def procedures(model: Model, proc_id=None) -> DataFrame:
    return chosen(model.table("procedimiento"), proc_id).orderBy("id")


def units(model: Model, unit_id=None) -> DataFrame:
    return chosen(model.table("unidades").select("id", "nombre"), unit_id).orderBy("id")


def sources(model: Model, source_id=None) -> DataFrame:
    return chosen(model.table("fuentes"), source_id).orderBy("id")


def calibration_groups(model: Model, group_id=None) -> DataFrame:
    specs = {"id": Spec("integer", "calibrados_grupos")}
    conditions = per_table(specs, {"id": group_id})
    return where(model.table("calibrados_grupos"), conditions.get("calibrados_grupos")).orderBy("id")


def raster_names(model: Model) -> DataFrame:
    """(id, nombre) of raster series, the name being variable and source."""
    variable = model.table("var").select(F.col("id").alias("var_id"), "var")
    source = model.table("fuentes").select(F.col("id").alias("fuentes_id"), F.col("nombre").alias("fuente"))
    return model.table("series_rast").join(variable, "var_id").join(source, "fuentes_id").select(
        "id", F.concat("var", F.lit("/"), "fuente").alias("nombre"))


def raster_series(model: Model, series_id=None) -> DataFrame:
    return chosen(raster_names(model), series_id).orderBy("id")


def picker_label(frame: DataFrame, code: str | None = None) -> DataFrame:
    """The frame with ``label``: ``name(code[id])``, or ``name (id)`` for tables without a code."""
    number = F.col("id").cast("string")
    if code:
        text = F.concat("nombre", F.lit("("), code, F.lit("["), number, F.lit("])"))
    else:
        text = F.concat("nombre", F.lit(" ("), number, F.lit(")"))
    return frame.withColumn("label", text)


NAMED_COLUMNS = (
    "tipo", "id", "estacion_id", "area_id", "escena_id", "var_id", "proc_id", "unit_id", "fuentes_id",
    "estacion_nombre", "fuentes_nombre", "var_var", "var_nombre", "var_timeSupport", "proc_nombre", "unit_nombre",
    "unit_abrev",
)
# Columns that a kind of series does not have.
ABSENT = {
    "puntual": {"area_id": "bigint", "escena_id": "bigint", "fuentes_id": "bigint", "fuentes_nombre": "string"},
    "areal": {"estacion_id": "bigint", "escena_id": "bigint", "tabla": "string"},
    "raster": {"estacion_id": "bigint", "area_id": "bigint", "tabla": "string", "estacion_nombre": "string"},
}


def _named(model: Model, kind: Kind) -> DataFrame:
    """The series of one kind with the names of their place, source, variable, procedure and unit, and their network."""
    named = model.table(kind.series)
    if kind.tipo == "puntual":
        stations = model.table("estaciones").selectExpr("unid estacion_id", "nombre estacion_nombre", "tabla")
        named = named.join(stations, "estacion_id", "left")
    else:
        origins = model.table("fuentes").selectExpr("id fuentes_id", "nombre fuentes_nombre")
        named = named.join(origins, "fuentes_id", "left")
    if kind.tipo == "areal":
        areas = model.table("areas_pluvio").selectExpr("unid area_id", "nombre estacion_nombre")
        named = named.join(areas, "area_id", "left")
    variable = model.table("var").selectExpr("id var_id", "var var_var", "nombre var_nombre")
    procedure = model.table("procedimiento").selectExpr("id proc_id", "nombre proc_nombre")
    unit = model.table("unidades").selectExpr("id unit_id", "nombre unit_nombre", "abrev unit_abrev")
    named = named.join(variable, "var_id", "left").join(procedure, "proc_id", "left").join(unit, "unit_id", "left")
    absent = [f"cast(null as {kind_of_column}) {name}" for name, kind_of_column in ABSENT[kind.tipo].items()]
    return named.selectExpr("*", f"'{kind.tipo}' tipo", "cast(null as string) var_timeSupport", *absent)


def named_series(model: Model, kinds: list[Kind] | None = None) -> DataFrame:
    """Series of all kinds in one frame, with names."""
    parts = [_named(model, kind).select(*NAMED_COLUMNS) for kind in kinds or KINDS.values()]
    return reduce(DataFrame.unionByName, parts)


def _runs(model: Model, count: str | None, conditions: dict) -> DataFrame:
    """(cor_id, cal_id): the runs, or newest runs, of the active calibrations that pass the filter."""
    active = active_calibrations(model, conditions)
    if count != "pronosticos":
        runs = model.table("corridas").select(F.col("id").alias("cor_id"), "cal_id")
    elif LAST_COVERAGE in model.stored_views:
        runs = model.table(LAST_COVERAGE).select("cor_id", "cal_id").distinct()
    else:
        runs = newest_runs(model).select("cor_id", "cal_id")
    runs = runs.join(broadcast_if(active.select("cal_id"), model.table("calibrados")), "cal_id", "left_semi")
    # Newest runs are as few as calibrations, so the coverage is not moved to meet them.
    return broadcast_if(runs, model.table("calibrados")) if count == "pronosticos" else runs


def _covered(model: Model, kind: Kind, runs: DataFrame, conditions: dict, named: bool) -> DataFrame:
    """The coverage of one kind in the given runs, joined to its series, that passes the filter; runs without any drop
    out. Only forecasts of these runs and of the series that pass are aggregated."""
    series = _named(model, kind) if named else model.table(kind.series)
    series = where(series.withColumnRenamed("id", "series_id"), conditions.get("series"))
    wanted = None
    if "series" in conditions:
        own = where(model.table(kind.series).withColumnRenamed("id", "series_id"), conditions["series"])
        wanted = broadcast_if(own.select("series_id"), model.table(kind.series))
    found = spans(model, kind, runs, wanted)
    found = where(found, conditions.get("covered")).join(series, "series_id")
    return found.withColumn("series_table", F.lit(kind.series))


def active_calibrations(model: Model, conditions: dict) -> DataFrame:
    active = where(model.table("calibrados").where("activar"), conditions.get("calibrados"))
    return active.select(F.col("id").alias("cal_id"), "nombre")


def calibration_conditions(filter: dict | None) -> tuple[Kind, dict]:
    values = dict(filter or {})
    kind = kind_of(values.pop("tipo", None))
    # For areas and scenes a request may name the place in the station's field. Places of other kinds do not apply.
    places = {k.place: values.pop(k.place, None) for k in KINDS.values()}
    values[kind.place] = places[kind.place] if places[kind.place] is not None else places["estacion_id"]
    return kind, per_table(CALIBRATION_FILTERS, values)


def calibration_rows(model: Model, filter: dict | None = None, count: str | None = None) -> DataFrame:
    """(id, nombre): active calibrations with a run that has matching forecast series, in no order."""
    kind, conditions = calibration_conditions(filter)
    runs = _runs(model, count, conditions)
    with_any = _covered(model, kind, runs, conditions, named=False).select("cor_id").distinct()
    found = with_any.join(runs, "cor_id").select("cal_id").distinct()
    return active_calibrations(model, conditions).join(found, "cal_id", "left_semi").select(
        F.col("cal_id").alias("id"), "nombre")


def calibration_series(model: Model, filter: dict | None = None, count: str | None = None,
                       named: bool = True) -> DataFrame:
    """(id, nombre, series columns…): one row for each calibration, run and matching forecast series."""
    kind, conditions = calibration_conditions(filter)
    runs = _runs(model, count, conditions)
    covered = _covered(model, kind, runs, conditions, named)
    owners = runs.join(broadcast_if(active_calibrations(model, conditions), model.table("calibrados")), "cal_id")
    columns = SERIES_COLUMNS if named else ("series_id", "series_table", "cor_id")
    return covered.join(owners, "cor_id").select(F.col("cal_id").alias("id"), "nombre", *columns)


def calibrations(model: Model, filter: dict | None = None, count: str | None = None, get_series: bool = False,
                 ids_per_list: int = IDS_PER_LIST) -> DataFrame:
    """Active calibrations with matching forecasts; with ``get_series`` also their series as lists of structs.

    The lists ``(id, nombre, series_table, part, series)`` hold the runs of so many series ids each: ``part`` is the id
    divided by ``ids_per_list``. One after the other in order of id, table and part, a calibration's lists are its series in
    order of table, series and run, however many there are.
    """
    if not get_series:
        return calibration_rows(model, filter, count).orderBy("id")
    rows = calibration_series(model, filter, count)
    part = F.floor(F.col("series_id") / ids_per_list).cast("bigint").alias("part")
    lists = rows.groupBy("id", "nombre", "series_table", part).agg(
        F.array_sort(F.collect_list(F.struct(*LISTED_COLUMNS))).alias("series"))
    return lists.orderBy("id", "series_table", "part")
