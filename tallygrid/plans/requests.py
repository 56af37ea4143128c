"""Requests as they come: a dict of texts names the period, the step, the filter and the shape of the answer."""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame

from ..functions.periods import INTRADAY_STEP, VECTOR_STEP, default_period
from ..functions.predicates import clean_filter
from ..operators import forecasts, grids, matrices, render, vectors
from ..operators.forecasts import asked
from ..sources.model import Model

# Keys that choose the answer and are no filters.
SHAPES = {"arrays": vectors.as_arrays, "tuples": vectors.as_tuples}
OBSERVED = {
    ("puntual", "registros"): vectors.obs_density, ("puntual", "estaciones"): vectors.station_density,
    ("areal", "registros"): vectors.areal_density, ("raster", "registros"): vectors.raster_density,
}


def _parts(query: dict[str, Any]) -> tuple[dict, dict]:
    """The period as arguments, and the filter, without what is empty."""
    given = {k: v for k, v in query.items() if v is not None and v != ""}
    period = {"start": given.get("timestart"), "end": given.get("timeend"), "dt": given.get("dt", VECTOR_STEP)}
    values = clean_filter(query)
    values.pop("shape", None)
    return period, values


def _shaped(rows: DataFrame, query: dict[str, Any]) -> DataFrame:
    shape = query.get("shape")
    if not shape:
        return rows
    if shape not in SHAPES:
        raise ValueError(f"cannot answer as {shape!r}; shapes are {' and '.join(SHAPES)}")
    return SHAPES[shape](rows)


def observed(model: Model, query: dict[str, Any], now=None) -> DataFrame:
    """A vector of observations, or of stations with ``count=estaciones``, of the kind that ``tipo`` names."""
    period, values = _parts(query)
    tipo, count = values.pop("tipo", "puntual"), values.pop("count", "registros")
    tipo = "raster" if tipo == "rast" else tipo
    if (tipo, count) not in OBSERVED:
        raise ValueError(f"cannot count {count!r} of {tipo!r}")
    return _shaped(OBSERVED[tipo, count](model, filter=values, now=now, **period), query)


def forecast(model: Model, query: dict[str, Any], now=None) -> DataFrame:
    """A vector of forecast values or, with ``count=corridas``, of runs."""
    period, values = _parts(query)
    return _shaped(forecasts.forecast_density(model, filter=values, now=now, **period), query)


def calibrations(model: Model, query: dict[str, Any], now=None) -> DataFrame:
    """Calibration × bucket of forecast values or runs."""
    period, values = _parts(query)
    values, kind, count = asked(values, None, None)
    return matrices.calibration_matrix(model, filter={**values, "tipo": kind.tipo}, count=count, now=now, **period)


def report(model: Model, query: dict[str, Any], kind: str | None = None, now=None) -> DataFrame:
    """The station grid that a request describes, as its ``format`` says: ``(line_no, line)`` of a report with title
    (``fwc``) or header (``csv``), or the pieces of the JSON document. ``kind`` is ``dia`` for one day by steps, ``anio`` for
    a year by months; otherwise a month (``mes``) or a range by days.
    """
    asked_for = {k: v for k, v in query.items() if v is not None and v != ""}
    now, form = now or datetime.now(), str(asked_for.get("format", "json")).lower()
    tabla, var_id = asked_for.get("tabla"), asked_for.get("varId")
    proc_id = asked_for.get("procId")
    options = {"proc_id": int(proc_id) if proc_id is not None else None, "use_id": asked_for.get("use_id"), "now": now}
    start = end = dt = None
    if kind == "dia":
        value, dt = str(asked_for.get("date", now.date())), str(asked_for.get("dt", INTRADAY_STEP))
        grid = grids.intraday_grid(model, tabla, var_id, value, dt, **options)
    elif kind == "anio":
        value = str(asked_for.get("anio", now.year))
        grid = grids.year_grid(model, tabla, var_id, int(value), **options)
    elif kind is not None:
        raise ValueError(f"unknown kind of report: {kind!r}")
    elif "mes" in asked_for:
        kind = "mes"
        value = str(asked_for["mes"])
        grid = grids.day_grid(model, tabla, var_id, month=value, **options)
    else:
        value = None
        start, end = (str(asked_for.get(k, default.date())) for k, default in zip(
            ("timestart", "timeend"), default_period("grid", now)))
        grid = grids.day_grid(model, tabla, var_id, start, end, **options)
    if form == "json":
        return render.document_json(grid)
    return render.report(model, grid, tabla, var_id, kind, value, form, start, end, asked_for.get("sep"), dt)
