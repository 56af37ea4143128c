"""Registered queries: every operator over whole tables, as ``(spark, directory) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import NOT_NULL, Spec, per_table
from ..operators import catalog, export, forecasts, grids, matrices, render, vectors
from ..operators.tally import maximum
from ..functions.sizing import shared_folder
from ..plans import reports, requests
from ..plans.coverage import CoverageStore
from ..plans.panel import panel
from ..plans.tallies import DayTallies
from ..sources.fixture import PANEL_PAIRS, fixture
from ..sources.model import Model
from ..sources.schema import KINDS

Query = Callable[[SparkSession, str], DataFrame]

JANUARY = ("2024-01-01", "2024-01-31")
FIRST_HALF = ("2024-01-01", "2024-01-15")
YEAR_1996 = ("1996-01-01", "1997-01-01")
MARCH_1996 = ("1996-03-01", "1996-03-31")
JANUARY_1996 = ("1996-01-01", "1996-01-31")
ALL_YEARS = ("1995-01-01", "2002-01-01")
ALL_GROUPS = {"cal_grupo_id": [1, 2, 3, 4, 5]}
TIPOS = {"point": "puntual", "areal": "areal", "raster": "raster"}
# A bent line, and a polygon with a hole.
LINE = "LINESTRING (0.0005 0.0021, 0.011 -0.0004, 0.0302 0.0013, 0.0302 0.0044)"
POLYGON = "POLYGON ((0.004 -0.01, 0.041 -0.01, 0.036 0.02, 0.004 0.02, 0.004 -0.01), (0.0112 -0.003, 0.0219 -0.003, 0.0219 0.004, 0.0112 0.004, 0.0112 -0.003))"
TALLIED = (
    "obs_density_1d", "obs_density_unaligned", "station_density_1d", "station_density_3d", "areal_density_1m",
    "matrix_network_stations", "grid_day_station_ext", "grid_day_area",
)
MODES = {"ext": "ext", "ext_only": "ext_only", "name": "nombre", "id": "id", "default": None}


def _plain(rows: DataFrame) -> DataFrame:
    """Instants as text, which compares alike in every engine."""
    texts = [F.col(c).cast("string").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in rows.dtypes]
    return rows.select(*texts)


def _asked(span: tuple[str, str], dt: str) -> dict[str, str]:
    return {"timestart": span[0], "timeend": span[1], "dt": dt}


def _vectors() -> dict[str, Callable[[Model], DataFrame]]:
    found = {
        "obs_density_1d": lambda m: vectors.obs_density(m, *JANUARY, "1 day", {"var_id": 1}),
        "obs_density_3h": lambda m: vectors.obs_density(
            m, "2024-01-05", "2024-01-08", "3 hours", {"tabla_id": "asia", "proc_id": 1}),
        "obs_density_unaligned": lambda m: vectors.obs_density(
            m, "2024-01-02 05:30:00", "2024-01-31", "7 days", {"var_id": [1, 2]}),
        "obs_density_7d_none": lambda m: vectors.obs_density(m, *JANUARY, "7 days", {"estacion_id": 1400}),
        "station_density_1d": lambda m: vectors.station_density(m, *JANUARY, "1 day", {"var_id": 1}),
        "station_density_3d": lambda m: vectors.station_density(
            m, *JANUARY, "3 days", {"tabla_id": ["asia", "europe"], "proc_id": 1}),
        "areal_density_1m": lambda m: vectors.areal_density(m, *YEAR_1996, "1 month", {"fuentes_id": 3}),
        "areal_density_1m_jan31": lambda m: vectors.areal_density(
            m, "1996-01-31", "1997-01-01", "1 month", {"fuentes_id": 3}),
        "raster_density_3m": lambda m: vectors.raster_density(m, *ALL_YEARS, "3 months", {"var_id": 1}),
        "raster_density_series": lambda m: vectors.raster_density(m, *ALL_YEARS, "6 months", {"series_id": 321}),
        "prono_density_dedupe": lambda m: forecasts.forecast_density(
            m, *ALL_YEARS, "1 year", ALL_GROUPS, dedupe=True),
        "request_forecast_areal": lambda m: requests.forecast(
            m, {**_asked(ALL_YEARS, "1 year"), **ALL_GROUPS, "tipo": "areal"}),
        "request_runs_raster": lambda m: requests.forecast(
            m, {**_asked(YEAR_1996, "1 month"), "cal_grupo_id": "2", "tipo": "rast", "count": "corridas", "cal_id": ""}),
        "request_stations": lambda m: requests.observed(
            m, {**_asked(JANUARY, "1 day"), "var_id": "1", "count": "estaciones", "colour": "red", "estacion_id": None}),
        "obs_density_open_period": lambda m: vectors.obs_density(
            m, None, None, "1 day", {"var_id": 1}, now=datetime(2024, 1, 20, 15, 30)),
        "run_density_distinct": lambda m: forecasts.forecast_density(
            m, *YEAR_1996, "1 month", {"cal_grupo_id": 2}, count="corridas", distinct_runs=True),
        "vector_arrays": lambda m: render.to_json(vectors.as_arrays(
            _plain(vectors.obs_density(m, *JANUARY, "1 day", {"var_id": 1})), True), "vector"),
        "vector_tuples": lambda m: render.to_json(vectors.as_tuples(
            _plain(vectors.obs_density(m, *JANUARY, "1 day", {"var_id": 1}))), "vector"),
    }
    for name, tipo in TIPOS.items():
        found[f"prono_density_{name}"] = lambda m, tipo=tipo: forecasts.forecast_density(
            m, *ALL_YEARS, "1 year", ALL_GROUPS, tipo)
        found[f"run_density_1m_{name}"] = lambda m, tipo=tipo: forecasts.forecast_density(
            m, *YEAR_1996, "1 month", {"cal_grupo_id": 2}, tipo, count="corridas")
    return found


def _matrices() -> dict[str, Callable[[Model], DataFrame]]:
    def network(m, count="registros"):
        return matrices.network_matrix(m, *JANUARY, "1 day", {"var_id": 1}, count)

    found = {
        "matrix_network_obs": network,
        "matrix_network_stations": lambda m: network(m, "estaciones"),
        "matrix_source_areal": lambda m: matrices.source_matrix(m, *YEAR_1996, "1 month"),
        "matrix_raster_series": lambda m: matrices.raster_matrix(m, *YEAR_1996, "3 months"),
        "matrix_calibration_values": lambda m: matrices.calibration_matrix(m, *ALL_YEARS, "1 year"),
        "matrix_calibration_runs": lambda m: matrices.calibration_matrix(
            m, *YEAR_1996, "1 month", count="corridas"),
        "matrix_max": lambda m: maximum(network(m)),
        "panel_month": lambda m: panel(m, PANEL_PAIRS, "2023-12-01", "2024-02-01"),
    }
    for name, tipo in TIPOS.items():
        found[f"matrix_calibration_series_{name}"] = lambda m, tipo=tipo: matrices.calibration_series_matrix(
            m, *ALL_YEARS, "1 year", {"tipo": tipo})
    return found


def _grids() -> dict[str, Callable[[Model], DataFrame]]:
    def asia(m, use_id="ext", **options):
        return grids.day_grid(m, "asia", 1, *FIRST_HALF, use_id=use_id, **options)

    found = {f"grid_day_station_{name}": lambda m, mode=mode: asia(m, mode).cells() for name, mode in MODES.items()}
    found |= {
        "grid_day_station_default_proc": lambda m: grids.day_grid(m, "asia", 4, *FIRST_HALF).cells(),
        "grid_day_station_any_obs": lambda m: asia(m, has_obs=False).cells(),
        "grid_year_station": lambda m: grids.year_grid(m, "asia", 1, 2024, use_id="ext").cells(),
        "grid_intraday_station_3h": lambda m: grids.intraday_grid(m, "asia", 1, "2024-01-10", "03:00").cells(),
        "grid_intraday_station_5h": lambda m: grids.intraday_grid(m, "asia", 1, "2024-01-10", "05:00").cells(),
        "grid_day_area": lambda m: grids.area_grid(m, 3, *MARCH_1996).cells(),
        "grid_day_area_var_proc": lambda m: grids.area_grid(m, 3, *MARCH_1996, var_id=1, proc_id=2).cells(),
        "grid_day_runs": lambda m: grids.run_grid(m, *JANUARY_1996).cells(),
        "grid_day_runs_by_day": lambda m: grids.run_grid(m, *JANUARY_1996, match="day").cells(),
        "grid_day_runs_model": lambda m: grids.run_grid(m, *JANUARY_1996, model_id=2, use_id=False).cells(),
        "grid_day_network": lambda m: grids.network_grid(m, 1, *JANUARY).cells(),
        "grid_document": lambda m: render.document_json(grids.network_grid(m, 1, *JANUARY)),
        "grid_document_runs": lambda m: render.document_json(grids.run_grid(m, *JANUARY_1996)),
        "grid_document_station": lambda m: render.document_json(asia(m), 10),
        "grid_document_area": lambda m: render.document_json(grids.area_grid(m, 3, *MARCH_1996), 8),
        "grid_document_lines": lambda m: render.document_lines(asia(m)),
    }
    return found


def _filters() -> dict[str, Callable[[Model], DataFrame]]:
    def on(table: str, key: str, ids: str, spec: Spec, value) -> Callable[[Model], DataFrame]:
        # The condition itself is built for every run, from the text values of a request.
        return lambda m: m.table(table).where(per_table({key: spec}, {key: value})[""]).select(ids)

    stations, runs = ("estaciones", "unid"), ("corridas", "id")

    def station(key, spec, value):
        return on(stations[0], key, stations[1], spec, value)

    def run(key, spec, value):
        return on(runs[0], key, runs[1], spec, value)

    def near(place):
        key = F.col("unid")
        point = F.struct((key % 50 / 1000.0).alias("lon"), (key % 7 / 10000.0).alias("lat"))
        return lambda m: m.table("estaciones").withColumn("geom", point).where(
            per_table({"geom": Spec("geometry")}, {"geom": place})[""]).select("unid")

    found = {
        "filter_not_null": station("id_externo", Spec("string"), NOT_NULL),
        "filter_regex": station("nombre", Spec("regex_string"), "^household.*7$"),
        "filter_string": station("tabla", Spec("string"), "asia"),
        "filter_string_list": station("tabla", Spec("string"), ["asia", None, "", "europe"]),
        "filter_string_fold": station("tabla", Spec("string", case_insensitive=True), ["ASIA", "Middle_East"]),
        "filter_boolean": station("has_obs", Spec("boolean"), "no"),
        "filter_only_true": station("habilitar", Spec("boolean_only_true"), "si"),
        "filter_only_false": station("habilitar", Spec("boolean_only_false"), "0"),
        "filter_geometry": lambda m: near((0.01, 0.0002))(m),
        "filter_geometry_line": lambda m: near(LINE)(m),
        "filter_geometry_polygon": lambda m: near(POLYGON)(m),
        "filter_geometry_json": lambda m: near({"type": "MultiPoint", "coordinates": [[0.01, 0.0002], [0.03, 0.0005]]})(m),
        "filter_date": run("date", Spec("date"), "1996-01-05"),
        "filter_timestart": run("date", Spec("timestart"), "2001-01-01T12:00:00"),
        "filter_timeend": run("date", Spec("timeend"), "1995-06-01T12:00:00"),
        "filter_from_date": run("date", Spec("greater_or_equal_date"), "2001-05-05T00:00:00Z"),
        "filter_to_date": run("date", Spec("smaller_or_equal_date"), "1995-02-02"),
        "filter_numeric_interval": on("valores_num", "valor", "obs_id", Spec("numeric_interval"), ["5.5", "9.25"]),
        "filter_numeric_min": on("valores_num", "valor", "obs_id", Spec("numeric_min"), "90"),
        "filter_numeric_max": on("valores_num", "valor", "obs_id", Spec("numeric_max"), "1.5"),
        "filter_integer": station("unid", Spec("integer"), "12abc"),
        "filter_integer_list": station("unid", Spec("integer"), ["7", "8.9", "x", 140]),
        "filter_number": on("valores_num", "valor", "obs_id", Spec("number"), "6.55"),
        "filter_number_list": on("valores_num", "valor", "obs_id", Spec("float"), ["6.55 m", "x", 1.63]),
        "filter_untyped": station("unid", Spec(), [3, 30]),
    }
    found["filter_interval"] = lambda m: m.table("pronosticos").join(
        m.table("corridas").select(F.col("id").alias("cor_id"), "date"), "cor_id").withColumn(
        "lead", F.col("timestart") - F.col("date")).where(
        per_table({"lead": Spec("interval")}, {"lead": "3 days"})[""]).select("cor_id", "series_id")
    found["filter_case_insensitive"] = station("tabla", Spec("string", case_insensitive=True), "EUROPE")
    found["filter_required"] = lambda m: m.table("estaciones").where(per_table(
        {"unid": Spec("integer", required=True), "habilitar": Spec("boolean")}, {"unid": [3, 30], "habilitar": None})[""]).select("unid")
    for field in ("microseconds", "milliseconds", "second", "minute"):
        found[f"filter_date_{field}"] = on(
            "observaciones", "timestart", "id", Spec("date", trunc=field), "2024-01-01T00:00:07")
    for field in ("hour", "day", "week", "month", "quarter", "year", "decade", "century", "millennium"):
        found[f"filter_date_{field}"] = run("date", Spec("date", trunc=field), "1998-08-05T12:34:56")
    return found


def _catalog() -> dict[str, Callable[[Model], DataFrame]]:
    overlap = {"timestart": YEAR_1996[0], "timeend": YEAR_1996[1]}
    found = {
        "catalog_networks": catalog.networks,
        "catalog_network_by_id": lambda m: catalog.networks(m, "3"),
        "catalog_network_by_code": lambda m: catalog.networks(m, "asia"),
        "catalog_variables": catalog.variables,
        "catalog_variable_by_code": lambda m: catalog.variables(m, "view"),
        "catalog_procedures": catalog.procedures,
        "catalog_units": catalog.units,
        "catalog_sources": catalog.sources,
        "catalog_source_by_id": lambda m: catalog.sources(m, "12"),
        "catalog_groups": catalog.calibration_groups,
        "catalog_group_by_id": lambda m: catalog.calibration_groups(m, 2),
        "catalog_raster_series": catalog.raster_series,
        "catalog_raster_series_by_id": lambda m: catalog.raster_series(m, 321),
        "catalog_network_labels": lambda m: catalog.picker_label(catalog.networks(m), "tabla_id"),
        "catalog_source_labels": lambda m: catalog.picker_label(catalog.sources(m)),
        "forecast_coverage": lambda m: _listed(forecasts.coverage(m)),
        "forecast_coverage_last": lambda m: _listed(forecasts.last_coverage(m)),
        "forecast_coverage_refreshed": lambda m: _listed(_refreshed(m).coverage()),
        "forecast_coverage_last_refreshed": lambda m: _listed(_refreshed(m).last_coverage()),
        "matrix_calibration_values_stored": lambda m: matrices.calibration_matrix(_refreshed(m).model(m), *ALL_YEARS, "1 year"),
        "series_named": catalog.named_series,
        "calibrations_last": lambda m: catalog.calibrations(m, {"cal_grupo_id": [1, 2, 3]}, "pronosticos"),
        "calibrations_filtered": lambda m: catalog.calibrations(m, {**overlap, "var_id": 2, "unit_id": 1}),
        "calibrations_nested": lambda m: _nested(catalog.calibrations(m, overlap, "pronosticos", get_series=True)),
    }
    for name, tipo in TIPOS.items():
        found[f"calibrations_{name}"] = lambda m, tipo=tipo: catalog.calibrations(m, {**overlap, "tipo": tipo})
        found[f"calibrations_series_{name}"] = lambda m, tipo=tipo: _listed(catalog.calibration_series(
            m, {**overlap, "tipo": tipo}))
    return found


def _refreshed(m: Model) -> CoverageStore:
    """A store of the coverage as it was before 1998, after it has taken over the runs with later forecasts."""
    def before(name: str) -> DataFrame:
        time = {"corridas": "date", **{kind.forecasts: "timestart" for kind in KINDS.values()}}.get(name)
        return m.table(name).where(F.col(time) < F.lit("1998-01-01").cast("timestamp_ntz")) if time else m.table(name)

    store = CoverageStore(m.spark, shared_folder(m.spark))
    store.write(Model(m.spark, before), 8)
    later = [m.table(kind.forecasts).where("timestart >= timestamp_ntz'1998-01-01'").select("cor_id") for kind in KINDS.values()]
    runs = m.table("corridas").where("date >= timestamp_ntz'1998-01-01'").select(F.col("id").alias("cor_id"))
    store.refresh(m, later[0].union(later[1]).union(later[2]).union(runs))
    return store


def _tallied(m: Model) -> Model:
    """The model with its observations counted by day, some days twice; the last of the ranges asked for are not stored."""
    store = DayTallies(m.spark, shared_folder(m.spark))
    store.append(m, date(2024, 1, 1), date(2024, 1, 10), ("puntual",))
    store.append(m, date(2024, 1, 8), date(2024, 1, 26), ("puntual",))
    store.append(m, date(1996, 1, 1), date(1996, 12, 20), ("areal",))
    return store.model(m)


def _stored() -> dict[str, Callable[[Model], DataFrame]]:
    """The same questions as elsewhere, asked of stored tallies."""
    def asked(ask: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
        return lambda m: ask(_tallied(m))

    found = {**_vectors(), **_matrices(), **_grids()}
    return {f"{name}_tallied": asked(found[name]) for name in TALLIED}


def _published(m: Model) -> DataFrame:
    """Two months published one after the other, the second with one that replaces the first's."""
    directory = shared_folder(m.spark)
    for first, last in (("2023-12-31", "2024-01-31"), ("2024-01-01", "2024-02-01")):
        reports.publish_report_set(reports.monthly(m, "asia", 1, first, last), directory)
    return reports.published(m.spark, directory)


def _listed(rows: DataFrame) -> DataFrame:
    """Lists as text, which compares alike in every engine."""
    return rows.withColumn("qualifiers", F.array_join("qualifiers", ","))


def _nested(rows: DataFrame) -> DataFrame:
    def item(series: Column) -> Column:
        return F.struct(*[
            (series[c].cast("string") if c in ("begin_date", "end_date") else series[c]).alias(c)
            for c in catalog.LISTED_COLUMNS])

    text = F.to_json(F.transform("series", item), {"ignoreNullFields": "false"})
    return rows.select("id", "nombre", "series_table", "part", text.alias("series"))


def _reports() -> dict[str, Callable[[Model], DataFrame]]:
    def month(m, use_id="ext"):
        return grids.day_grid(m, "asia", 1, month="2024-01", use_id=use_id)

    def asked(kind=None, **query):
        return lambda m: requests.report(m, {"tabla": "asia", "varId": "1", **query}, kind)

    return {
        "report_full_month": asked(mes="2024-01", format="fwc", use_id="ext"),
        "report_full_month_csv": asked(mes="2024-01", format="csv", use_id="ext_only", sep=","),
        "report_full_day": asked("dia", date="2024-01-10", format="fwc", use_id="ext"),
        "report_full_day_csv": asked("dia", date="2024-01-10", dt="05:00", format="csv", use_id="ext_only"),
        "report_full_year": asked("anio", anio="2024", format="fwc", use_id="ext"),
        "report_full_year_csv": asked("anio", anio="2024", format="csv", use_id="ext_only"),
        "report_full_range": asked(timestart=FIRST_HALF[0], timeend=FIRST_HALF[1], format="fwc"),
        "report_full_range_csv": asked(timestart=FIRST_HALF[0], timeend=FIRST_HALF[1], format="CSV", sep="|"),
        "report_full_range_json": asked(timestart=FIRST_HALF[0], timeend=FIRST_HALF[1]),
        "report_fwc_month": lambda m: render.fixed_width(month(m), "mes"),
        "report_csv_month": lambda m: render.csv(month(m, "ext_only"), "mes", ","),
        "report_fwc_range": lambda m: render.fixed_width(grids.day_grid(m, "asia", 1, *FIRST_HALF)),
        "report_fwc_year": lambda m: render.fixed_width(grids.year_grid(m, "asia", 1, 2024, use_id="ext"), "anio"),
        "report_csv_day": lambda m: render.csv(
            grids.intraday_grid(m, "asia", 1, "2024-01-10", use_id="ext_only"), "dia"),
        "report_title": lambda m: render.title(m, "asia", 1, "mes", "2024-01"),
        "report_header": lambda m: render.header(m, "asia", 1, "mes", "2024-01"),
        "report_set_monthly": lambda m: reports.monthly(m, "asia", 1, "2023-12-31", "2024-02-01").text_lines(),
        "report_set_monthly_csv": lambda m: reports.monthly(m, "asia", 1, "2023-12-31", "2024-02-01").csv_lines(),
        "report_set_yearly": lambda m: reports.yearly(m, "asia", 1, "2023-06-01", "2024-06-01").text_lines(),
        "report_set_daily": lambda m: reports.daily(m, "asia", 1, "2024-01-09", "2024-01-11").text_lines(),
        "report_set_daily_5h": lambda m: reports.daily(m, "asia", 1, "2024-01-09", "2024-01-11", "05:00").csv_lines(),
        "report_set_published": _published,
        "level_export": lambda m: export.levels(m, 8, *JANUARY),
        "level_export_lines": lambda m: export.level_lines(export.levels(m, 8, *JANUARY)),
    }


def queries() -> dict[str, Query]:
    found = {**_vectors(), **_matrices(), **_grids(), **_filters(), **_catalog(), **_reports(), **_stored()}
    return {
        name: lambda spark, directory, ask=ask: _plain(ask(fixture(spark, directory)))
        for name, ask in found.items()
    }
