"""Forecast coverage, and density vectors of forecast values and model runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.axis import Axis
from ..functions.periods import VECTOR_STEP, vector_bounds
from ..functions.predicates import Spec, per_table, require_any
from ..functions.sizing import broadcast_if, fits
from ..sources.model import Model
from ..sources.schema import KINDS, QUALIFIER, SCHEMAS, Kind, kind_of
from .tally import vector, where
from .vectors import members

COVERAGE, LAST_COVERAGE = "series_prono_date_range", "series_prono_date_range_last"
# What forecast vectors and matrices count, the first by default.
COUNTS = ("pronosticos", "corridas")
SERIES_FILTERS = {
    "var_id": Spec("integer"),
    "unit_id": Spec("integer"),
    "proc_id": Spec("integer"),
    "series_id": Spec("integer", column="id"),
}
VALUE_FILTERS = {
    "cal_id": Spec("integer", LAST_COVERAGE),
    "cal_grupo_id": Spec("integer", LAST_COVERAGE),
    "cor_id": Spec("integer", LAST_COVERAGE),
    "forecast_date": Spec("date", LAST_COVERAGE),
}
RUN_FILTERS = {
    "cal_id": Spec("integer", "corridas"),
    "cal_grupo_id": Spec("integer", "calibrados", "grupo_id"),
    "cor_id": Spec("integer", "corridas", "id"),
    "forecast_date": Spec("date", "corridas", "date"),
}
PLACE_FILTERS = {
    "puntual": {"tabla_id": Spec("string", "redes"), "estacion_id": Spec("integer")},
    "areal": {"fuentes_id": Spec("integer"), "area_id": Spec("integer")},
    "raster": {"fuentes_id": Spec("integer"), "escena_id": Spec("integer")},
}


def newest_runs(model: Model, condition: Column | None = None) -> DataFrame:
    """(cor_id, cal_id, cal_grupo_id, forecast_date): the newest run of each calibration, ties by the greater id."""
    newest = model.table("corridas").groupBy("cal_id").agg(F.max(F.struct("date", "id")).alias("run"))
    groups = model.table("calibrados").select(F.col("id").alias("cal_id"), F.col("grupo_id").alias("cal_grupo_id"))
    runs = newest.join(groups, "cal_id").select(
        F.col("run.id").alias("cor_id"), "cal_id", "cal_grupo_id", F.col("run.date").alias("forecast_date"))
    return broadcast_if(where(runs, condition), model.table("calibrados"))


def _series_attributes(model: Model, kind: Kind) -> DataFrame:
    series = model.table(kind.series)
    if kind.tipo != "puntual":
        return series.selectExpr("id series_id", "cast(null as bigint) estacion_id", "cast(null as string) tabla", "var_id")
    stations = model.table("estaciones").selectExpr("unid estacion_id", "tabla")
    return series.join(stations, "estacion_id", "left").selectExpr("id series_id", "estacion_id", "tabla", "var_id")


def _of_runs(facts: DataFrame, runs: DataFrame | None) -> DataFrame:
    """The rows of the given runs. This join precedes every aggregation, so that other forecasts drop out in the
    scan stage."""
    return facts if runs is None else facts.join(runs.select("cor_id"), "cor_id", "left_semi")


def spans(model: Model, kind: Kind, runs: DataFrame | None = None, series: DataFrame | None = None) -> DataFrame:
    """(series_id, cor_id, begin_date, end_date, count, qualifiers) of the forecasts of one kind, of the given runs and
    the given ``(series_id)`` only."""
    stored = COVERAGE in model.stored_views
    facts = model.table(COVERAGE).where(F.col("series_table") == kind.series) if stored else model.table(kind.forecasts)
    facts = _of_runs(facts, runs)
    if series is not None:
        facts = facts.join(series, "series_id", "left_semi")
    if stored:
        return facts.select("series_id", "cor_id", "begin_date", "end_date", "count", "qualifiers")
    qualified = QUALIFIER in facts.columns
    texts = [F.array_sort(F.collect_set(QUALIFIER)).alias("qualifiers")] if qualified else []
    found = facts.groupBy("series_id", "cor_id").agg(
        F.min("timestart").alias("begin_date"), F.max("timestart").alias("end_date"),
        F.count(F.lit(1)).alias("count"), *texts)
    return found if qualified else found.withColumn("qualifiers", F.expr("cast(array() as array<string>)"))


def covered_pairs(model: Model, kind: Kind, runs: DataFrame | None = None) -> DataFrame:
    """(series_id, cor_id) of the coverage, without its attributes."""
    if COVERAGE in model.stored_views:
        return spans(model, kind, runs).select("series_id", "cor_id")
    return _of_runs(model.table(kind.forecasts), runs).select("series_id", "cor_id").distinct()


def coverage(model: Model, kinds: list[Kind] | None = None, runs: DataFrame | None = None) -> DataFrame:
    """First and last instant and count of the forecasts of each series and run, of the given kinds and runs only."""
    kinds = kinds or list(KINDS.values())
    if COVERAGE in model.stored_views:
        return _of_runs(model.table(COVERAGE).where(F.col("series_table").isin([k.series for k in kinds])), runs)
    parts = [
        spans(model, kind, runs).join(_series_attributes(model, kind), "series_id", "left").withColumn(
            "series_table", F.lit(kind.series))
        for kind in kinds]
    return reduce(DataFrame.unionByName, parts).select(*SCHEMAS[COVERAGE].names)


def last_coverage(model: Model, kinds: list[Kind] | None = None, condition: Column | None = None) -> DataFrame:
    """The coverage of the newest run of each calibration. The condition is on columns of the run."""
    if LAST_COVERAGE in model.stored_views:
        tables = [k.series for k in kinds or KINDS.values()]
        return where(model.table(LAST_COVERAGE), condition).where(F.col("series_table").isin(tables))
    runs = newest_runs(model, condition)
    return coverage(model, kinds, runs).join(runs, "cor_id").select(*SCHEMAS[LAST_COVERAGE].names)


def series_specs(kind: Kind, run_filters: dict) -> dict:
    return {**SERIES_FILTERS, **run_filters, **PLACE_FILTERS[kind.tipo]}


def _run_weights(model: Model, kind: Kind, condition: Column | None) -> DataFrame:
    """(cor_id, cal_id, covered): the newest runs and the number of series that each covers."""
    if LAST_COVERAGE in model.stored_views:
        last = last_coverage(model, [kind], condition).groupBy("cor_id", "cal_id").agg(F.count(F.lit(1)).alias("covered"))
    else:
        runs = newest_runs(model, condition)
        covered = covered_pairs(model, kind, runs).groupBy("cor_id").agg(F.count(F.lit(1)).alias("covered"))
        last = covered.join(runs.select("cor_id", "cal_id"), "cor_id")
    # There is one row for each newest run, so the calibrations bound it.
    return broadcast_if(last, model.table("calibrados"))


def value_counts(model: Model, kind: Kind, axis: Axis, values: dict, keys: list[str],
                 dedupe: bool = False) -> DataFrame:
    """(keys…, x, n) of forecast values of the newest runs.

    A value counts once for each covered series of its run, or once in all with ``dedupe``. Keys are ``cal_id``,
    ``cor_id``, ``series_id``.
    """
    conditions = per_table(series_specs(kind, VALUE_FILTERS), values, kind.series)
    weights = _run_weights(model, kind, conditions.get(LAST_COVERAGE))
    if dedupe:
        weights = weights.withColumn("covered", F.lit(1).cast("bigint"))
    facts = model.between(kind.forecasts, axis.start, axis.stop)
    facts = facts.select("cor_id", "series_id", axis.bucket(F.col("timestart")).alias("x"))
    hits = facts.join(weights, "cor_id").groupBy("cor_id", "cal_id", "series_id", "x").agg(
        F.sum("covered").alias("n"))
    chosen, _ = members(model, kind, conditions)
    return hits.join(chosen.select("series_id"), "series_id").groupBy(*keys, "x").agg(F.sum("n").alias("n"))


def run_counts(model: Model, kind: Kind, axis: Axis, values: dict, keys: list[str],
               distinct_runs: bool = False) -> DataFrame:
    """(keys…, x, n) of model runs: once for each matching forecast series, or once each with ``distinct_runs``."""
    conditions = per_table(series_specs(kind, RUN_FILTERS), values, kind.series)
    runs = where(model.between("corridas", axis.start, axis.stop, column="date"), conditions.get("corridas"))
    groups = where(model.table("calibrados"), conditions.get("calibrados")).select(F.col("id").alias("cal_id"))
    runs = runs.join(groups, "cal_id").select(F.col("id").alias("cor_id"), "cal_id",
                                              axis.bucket(F.col("date")).alias("x"))
    if fits(model.table("corridas")):
        runs = F.broadcast(runs)
        pairs = covered_pairs(model, kind, runs)
    else:
        # Too many runs to broadcast: the forecasts shrink to their distinct pairs before they meet the runs.
        pairs = covered_pairs(model, kind)
    chosen, _ = members(model, kind, conditions)
    hits = pairs.join(runs, "cor_id").join(chosen.select("series_id"), "series_id")
    if distinct_runs:
        hits = hits.select(*dict.fromkeys([*keys, "cor_id", "x"])).distinct()
    return hits.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("n"))


def asked(filter: dict | None, tipo: str | None, count: str | None) -> tuple[dict, Kind, str]:
    """The filter without ``tipo`` and ``count``, and what is asked for by these, as arguments or in the filter."""
    values = dict(filter or {})
    for name, given in (("tipo", tipo), ("count", count)):
        own = values.get(name)
        if own and given and own != given:
            raise ValueError(f"{name} is {given!r} as an argument and {own!r} in the filter")
    tipo, count = tipo or values.pop("tipo", None), count or values.pop("count", None)
    values.pop("tipo", None)
    values.pop("count", None)
    if count not in (None, "", *COUNTS):
        raise ValueError(f"cannot count {count!r}; counts are of {' and '.join(COUNTS)}")
    return values, kind_of(tipo), count or COUNTS[0]


def forecast_density(model: Model, start=None, end=None, dt=VECTOR_STEP, filter=None, tipo: str | None = None,
                     count: str | None = None, dedupe: bool = False, distinct_runs: bool = False,
                     now=None) -> DataFrame:
    """(x, t, n): forecast values of the newest runs, or runs with ``count="corridas"``, for each bucket. ``tipo`` and
    ``count`` may be in the filter as well.

    Unlike observations, forecasts reach to the end of the last bucket.
    """
    start, end = vector_bounds(start, end, "forecast", now)
    axis = Axis.of(start, end, dt)
    values, kind, count = asked(filter, tipo, count)
    runs = count == "corridas"
    require_any(series_specs(kind, RUN_FILTERS if runs else VALUE_FILTERS), values)
    counts = (run_counts(model, kind, axis, values, [], distinct_runs) if runs
              else value_counts(model, kind, axis, values, [], dedupe))
    return vector(model.spark, axis, counts)
