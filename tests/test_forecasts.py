from datetime import datetime, timedelta

import pytest
from pyspark.sql import types as T

from tallygrid.operators import catalog, forecasts, matrices
from tallygrid.sources.schema import KINDS, kind_of

START, END = datetime(2024, 1, 1), datetime(2024, 1, 3)
DAY = timedelta(days=1)
CALIBRATIONS = [(1, "One", 10, 1, True), (2, "Two", 20, 1, True), (3, "Off", 10, 1, False), (4, "Idle", 10, 1, True)]
# Run 12 is the newest of calibration 1, by id; run 21 is that of 2.
RUNS = [(11, 1, START), (12, 1, START), (21, 2, START + 3 * DAY + timedelta(hours=23)), (20, 2, START - DAY), (31, 3, START)]
SERIES = [(1, 5, 1, 1, 1), (2, 5, 2, 1, 1), (3, 6, 1, 2, 2)]
VALUES = [
    (11, 1, START), (12, 1, START), (12, 1, START + DAY), (12, 2, START + 2 * DAY), (12, 9, START + 40 * DAY),
    (12, 2, START + 3 * DAY - timedelta(seconds=1)), (12, 2, START + 3 * DAY), (21, 3, START + DAY), (20, 3, START),
    (31, 1, START),
]


@pytest.fixture
def model(model_of):
    return model_of(
        redes=[(1, "north", "North")],
        estaciones=[(5, 1, None, "Five", "north", True, True), (6, 2, None, "Six", "nowhere", True, True)],
        series=SERIES, calibrados=CALIBRATIONS, corridas=RUNS, pronosticos=VALUES,
        series_areal=[(1, 8, 7, 1, 1, 1)], pronosticos_areal=[(12, 1, START), (21, 1, START)],
        series_rast=[(1, 4, 7, 1, 1, 1)], pronosticos_rast=[(12, 1, START + DAY)],
        var=[(1, "h", "Level"), (2, "q", "Flow")], procedimiento=[(1, "measured")], unidades=[(1, "metre", "m")],
        fuentes=[(7, "Radar")], areas_pluvio=[(8, "Basin", True, True)])


def counts(rows):
    return [r.n for r in rows.collect()]


def density(model, filter, **options):
    return counts(forecasts.forecast_density(model, START, END, "1 day", filter, **options))


def check_values(model):
    # Run 12 covers series 1, 2 and the unknown 9, so each of its values counts three times. The last bucket is full.
    assert density(model, {"cal_id": 1}) == [3, 3, 6]
    assert density(model, {"cal_id": 1}, dedupe=True) == [1, 1, 2]
    assert density(model, {"series_id": 2}) == [0, 0, 6]
    assert density(model, {"cal_grupo_id": 20}) == [0, 0, 0]  # its station is in no known network
    # Also run 31, the newest of a calibration that is not active.
    assert density(model, {"forecast_date": START}, dedupe=True) == [2, 1, 2]
    assert density(model, {"cor_id": 11}) == [0, 0, 0]
    assert density(model, {"tabla_id": "north", "estacion_id": 5, "var_id": 1}) == [4, 3, 0]
    assert density(model, {"fuentes_id": 7}, tipo="areal") == [2, 0, 0]
    assert density(model, {"area_id": 8, "cal_id": 2}, tipo="areal") == [1, 0, 0]
    assert density(model, {"fuentes_id": 7, "escena_id": 4}, tipo="rast") == [0, 1, 0]


def check_runs(model):
    runs = {"count": "corridas"}
    # Runs 11, 12 (series 1 and 2) and 31 on the first day.
    assert density(model, {"tabla_id": "north"}, **runs) == [4, 0, 0]
    assert density(model, {"tabla_id": "north"}, distinct_runs=True, **runs) == [3, 0, 0]
    assert density(model, {"cal_grupo_id": 10, "var_id": 2}, **runs) == [1, 0, 0]
    assert density(model, {"cor_id": [11, 31]}, **runs) == [2, 0, 0]
    assert density(model, {"fuentes_id": 7}, tipo="areal", **runs) == [1, 0, 0]
    assert counts(forecasts.forecast_density(
        model, START, START + 3 * DAY, "1 day", {"fuentes_id": 7}, "areal", "corridas")) == [1, 0, 0, 1]


def test_values(model):
    check_values(model)


def test_values_of_large_tables(model, nothing_fits):
    check_values(model)


def test_runs(model):
    check_runs(model)


def test_runs_of_large_tables(model, nothing_fits):
    check_runs(model)


def test_guards(model):
    with pytest.raises(ValueError):
        density(model, {})
    with pytest.raises(ValueError):
        density(model, {"tabla_id": "north"}, tipo="areal")
    with pytest.raises(ValueError):
        density(model, {"cal_id": "x"})


def test_coverage(model):
    rows = {(r.series_table, r.series_id, r.cor_id): r for r in forecasts.coverage(model).collect()}
    assert len(rows) == 10
    found = rows["series", 2, 12]
    assert (found.begin_date, found.end_date, found["count"]) == (START + 2 * DAY, START + 3 * DAY, 3)
    assert (found.estacion_id, found.tabla, found.var_id, found.qualifiers) == (5, "north", 2, [])
    assert rows["series", 9, 12].var_id is None and rows["series_areal", 1, 12].estacion_id is None
    last = {(r.series_table, r.series_id, r.cor_id): r for r in forecasts.last_coverage(model).collect()}
    assert set(last) == {k for k in rows if k[2] in (12, 21, 31)}
    assert last["series", 3, 21].cal_grupo_id == 20 and last["series", 1, 12].forecast_date == START


def test_qualifiers(model_of):
    qualifier = T.StructField("qualifier", T.StringType())
    model = model_of(_extra={"pronosticos": [qualifier]}, pronosticos=[
        (1, 1, START, "p95"), (1, 1, START, "p05"), (1, 1, END, "p95"), (1, 1, END, None)])
    assert forecasts.coverage(model, [KINDS["puntual"]]).collect()[0].qualifiers == ["p05", "p95"]


def test_stored_views(model, model_of):
    views = {"series_prono_date_range": [tuple(r) for r in forecasts.coverage(model).collect()],
             "series_prono_date_range_last": [tuple(r) for r in forecasts.last_coverage(model).collect()]}
    tables = {name: [tuple(r) for r in model.table(name).collect()] for name in (
        "redes", "estaciones", "series", "calibrados", "corridas", "pronosticos", "series_areal", "pronosticos_areal",
        "series_rast", "pronosticos_rast")}
    stored = model_of(stored_views=views, **views, **tables)
    check_values(stored)
    check_runs(stored)
    assert forecasts.coverage(stored, [kind_of("areal")]).count() == 2
    assert [r.id for r in catalog.calibrations(stored, {}, "pronosticos").collect()] == [1, 2]


def ids(rows):
    return [r.id for r in rows.collect()]


def test_calibrations(model):
    assert ids(catalog.calibrations(model)) == [1, 2]
    assert ids(catalog.calibrations(model, {"cal_grupo_id": 20})) == [2]
    assert ids(catalog.calibrations(model, {"timestart": START + 2 * DAY})) == [1]
    assert ids(catalog.calibrations(model, {"timeend": START - DAY})) == []
    assert ids(catalog.calibrations(model, {"timeend": START})) == [1, 2]
    # The newest run of 2 begins a day later than its first.
    assert ids(catalog.calibrations(model, {"timeend": START}, "pronosticos")) == [1]
    assert ids(catalog.calibrations(model, {"tipo": "raster"})) == [1]
    assert ids(catalog.calibrations(model, {"tipo": "areal", "area_id": 8, "cal_id": 2})) == [2]
    assert ids(catalog.calibrations(model, {"tipo": "areal", "estacion_id": 9})) == []
    assert ids(catalog.calibrations(model, {"estacion_id": 6, "unit_id": 2})) == [2]
    with pytest.raises(ValueError):
        catalog.calibrations(model, {"cal_id": "x"})


def test_nested_series(model):
    rows = catalog.calibrations(model, {}, get_series=True).collect()
    assert [(r.id, r.part, [(s.series_id, s.cor_id) for s in r.series]) for r in rows] == [
        (1, 0, [(1, 11), (1, 12), (2, 12)]), (2, 0, [(3, 20), (3, 21)])]
    assert rows[0].series[0].estacion_nombre == "Five" and rows[0].series[0].unit_abrev == "m"
    split = catalog.calibrations(model, {}, get_series=True, ids_per_list=1).collect()
    assert [(r.id, s.series_id, s.cor_id) for r in split for s in r.series] == [
        (r.id, s.series_id, s.cor_id) for r in rows for s in r.series]
    assert [(r.id, r.part) for r in split] == [(1, 1), (1, 2), (2, 3)]


def test_what_is_asked_for_may_be_in_the_filter(model):
    def counted(filter, **options):
        return [r.n for r in forecasts.forecast_density(model, START, START + 3 * DAY, "1 day", filter, **options).collect()]

    for tipo in ("puntual", "areal", "raster"):
        for count in ("pronosticos", "corridas"):
            assert counted({"cal_id": 1}, tipo=tipo, count=count) == counted({"cal_id": 1, "tipo": tipo, "count": count})
    for filter, options in (
            ({"tipo": "areal"}, {"tipo": "raster"}), ({"count": "corridas"}, {"count": "pronosticos"}), ({"count": "days"}, {})):
        with pytest.raises(ValueError):
            counted({"cal_id": 1, **filter}, **options)


def test_filters_of_catalogues_come_before_the_coverage_is_aggregated(model):
    found = catalog.calibration_series(model, {"cal_id": 1, "var_id": 1}, "pronosticos")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate [series_id"):]
    assert below.count("LeftSemi") >= 2 and "var_id" in below


@pytest.mark.parametrize("large", [False, True])
def test_matrices(model, large, request):
    if large:
        request.getfixturevalue("nothing_fits")
    values = matrices.calibration_matrix(model, START, END, "1 day").orderBy("y", "x").collect()
    assert [(r.label, r.n) for r in values] == [("1 - One", n) for n in (3, 3, 6)] + [("2 - Two", 0)] * 3
    runs = matrices.calibration_matrix(model, START, END, "1 day", count="corridas").orderBy("y", "x").collect()
    assert [r.n for r in runs] == [3, 0, 0, 0, 0, 0]
    series = matrices.calibration_series_matrix(model, START, END, "1 day", {"tipo": "puntual"}).orderBy("y", "x").collect()
    assert [(r.label, r.n) for r in series] == [
        ("1 - 1 - 12", 3), ("1 - 1 - 12", 3), ("1 - 1 - 12", 0), ("1 - 2 - 12", 0), ("1 - 2 - 12", 0),
        ("1 - 2 - 12", 6), ("2 - 3 - 21", 0), ("2 - 3 - 21", 0), ("2 - 3 - 21", 0)]


def test_other_matrices(model_of):
    model = model_of(
        fuentes=[(8, "Sat"), (7, "Radar")], var=[(1, "h", "Level")],
        series_areal=[(1, 5, 7, 1, 1, 1)], observaciones_areal=[(1, START), (1, START + DAY)],
        series_rast=[(1, 4, 7, 1, 1, 1), (2, 4, 8, 1, 1, 1)], observaciones_rast=[(2, START)])
    areal = matrices.source_matrix(model, START, END, "1 day").orderBy("y", "x").collect()
    assert [(r.label, r.n) for r in areal] == [("Radar", 1), ("Radar", 1), ("Radar", 0)] + [("Sat", 0)] * 3
    raster = matrices.raster_matrix(model, START, END, "1 day").orderBy("y", "x").collect()
    assert [(r.label, r.n) for r in raster] == [("h/Radar", 0)] * 3 + [("h/Sat", 1), ("h/Sat", 0), ("h/Sat", 0)]
