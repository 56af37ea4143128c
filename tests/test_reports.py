import json
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallygrid.functions.labels import number_text
from tallygrid.operators import export, grids, render
from tallygrid.plans import reports
from tallygrid.plans.panel import panel

STATIONS = [
    (5, 71, "B100", "Ñandubay río", "north", True, True), (3, 72, "A200", "Łódź", "north", True, True),
    (4, 73, None, "Third station of the network", "north", True, True),
]
SERIES = [(1, 5, 1, 1, 1), (2, 3, 1, 1, 1), (3, 4, 1, 1, 1), (4, 5, 2, 1, 1)]
LAST_SECOND = timedelta(hours=23, minutes=59, seconds=59)
OBSERVED = [
    (1, datetime(2023, 12, 31, 22), 1.0), (1, datetime(2024, 1, 1), 2.5), (1, datetime(2024, 1, 1, 3), None),
    # In a month of reports, the rest of the last second of a month counts nowhere, as in a report of its own.
    (2, datetime(2024, 1, 31) + LAST_SECOND, 0.0), (2, datetime(2024, 1, 31, 23, 59, 59, 1), 0.0),
    (3, datetime(2024, 2, 29), 0.0), (3, datetime(2024, 2, 10, 23, 59, 59, 9), 0.0),
    (4, datetime(2024, 1, 1, 7, 45), 1.25), (4, datetime(2024, 1, 2), 3.0), (4, datetime(2024, 1, 3, 0, 0, 1), 3.0),
    (4, datetime(2024, 1, 1, 7, 5), 1e-7),
]


@pytest.fixture
def model(model_of):
    return model_of(
        redes=[(1, "north", "Red Norte")], var=[(1, "P", "Lluvia")], estaciones=STATIONS, series=SERIES,
        observaciones=[(i, s, t) for i, (s, t, _) in enumerate(OBSERVED)],
        valores_num=[(i, v) for i, (_, _, v) in enumerate(OBSERVED)])


def lines(frame):
    return [r.line for r in frame.orderBy("line_no").collect()]


def test_fixed_width(model):
    grid = grids.day_grid(model, "north", 1, "2024-01-31", "2024-02-01", use_id="ext")
    assert lines(render.fixed_width(grid, "mes")) == [
        "Fecha:                    31    01", "A200 - Łódź                2     0",
        "B100 - Ñandubay rí         0     0", "4 - Third stati            0     0"]
    wide = lines(render.fixed_width(grid))
    assert wide[0] == "Fecha:                 2024-01-31 2024-02-01" and wide[1].endswith("          2          0")
    assert {len(line) for line in wide} == {44}


def test_csv(model):
    grid = grids.day_grid(model, "north", 1, "2024-01-31", "2024-02-01")
    assert lines(render.csv(grid))[:2] == ["Fecha;2024-01-31;2024-02-01", "Łódź (3);2;0"]
    assert lines(render.csv(grid, "mes", ",;"))[0] == "Fecha,31,01"
    named = grids.day_grid(model, "north", 1, "2024-02-29", "2024-02-29", use_id="ext_only")
    assert lines(render.csv(named, "mes")) == ["Fecha;29", "A200;0", "B100;0", "4;1"]


def test_tables_without_stations(model):
    grid = grids.day_grid(model, "south", 1, "2024-01-31", "2024-02-01")
    assert lines(render.csv(grid, "mes")) == ["Fecha;31;01"]


def test_title_and_header(model):
    assert lines(render.title(model, "north", "P", "mes", "2024-01")) == [
        "Cantidad de registros por día.", "Red: Red Norte (north [1]).", "Variable: Lluvia (P [1]).", "Mes: 2024-01", ""]
    assert lines(render.title(model, "none", 9, None, start="a", end="b")) == [
        "Cantidad de registros por día.", "Red: .", "Variable: .", "Inicio: a", "Fin: b", ""]
    assert lines(render.title(model, 1, 1, "anio", "2024"))[3] == "Año: 2024"
    assert lines(render.title(model, 1, 1, "dia", "2024-01-02"))[0] == "Cantidad de registros por intervalo."
    assert lines(render.header(model, "north", 1, "dia", "2024-01-02")) == [
        "redNombre=Red Norte", "redTabla=north", "redId=1", "variableNombre=Lluvia", "variableCode=P", "variableId=1",
        "intervaloTemporal=03:00", "fecha=2024-01-02", "", ""]
    assert lines(render.header(model, "x", "y", "anio", "2024"))[2:7] == [
        "redId=", "variableNombre=", "variableCode=", "variableId=", "intervaloTemporal=mensual"]
    assert len(lines(render.header(model, "north", 1))) == 8


def test_stacked(model):
    grid = grids.day_grid(model, "north", 1, month="2024-02", use_id="ext")
    whole = lines(render.stacked(render.title(model, "north", 1, "mes", "2024-02"), render.fixed_width(grid, "mes")))
    assert whole[4:6] == ["", "Fecha:                " + "".join(f"{d:>6}" for d in ["%02d" % i for i in range(1, 30)])]
    assert len(whole) == 9


def content(path):
    return Path(path).read_bytes().decode("latin-1").split("\n")


def replaced(texts):
    return [t.encode("latin-1", "replace").decode("latin-1") for t in texts]


def text_report(model, grid, period, value):
    return replaced(lines(render.stacked(
        render.title(model, "north", 1, period, value), render.fixed_width(grid, period)))) + [""]


def csv_report(model, grid, period, value, dt=None):
    return replaced(lines(render.stacked(
        render.header(model, "north", 1, period, value, dt), render.csv(grid, period, ",")))) + [""]


def test_monthly_files_equal_single_reports(model, tmp_path):
    made = reports.monthly(model, "north", 1, "2023-12-31", "2024-02-01")
    paths = reports.write_report_set(made, str(tmp_path))
    assert [Path(p).name for p in paths] == [
        f"RepCuantMensual_{m}.{s}" for m in ("202312", "202401", "202402") for s in ("csv", "txt")]
    for month in ("2023-12", "2024-01", "2024-02"):
        name = tmp_path / f"RepCuantMensual_{month.replace('-', '')}"
        text = grids.day_grid(model, "north", 1, month=month, use_id="ext")
        table = grids.day_grid(model, "north", 1, month=month, use_id="ext_only")
        assert content(f"{name}.txt") == text_report(model, text, "mes", month)
        assert content(f"{name}.csv") == csv_report(model, table, "mes", month)
    # What Latin-1 lacks becomes a question mark.
    assert content(f"{name}.txt")[6].startswith("A200 - ?ód? ") and "Ñandubay rí" in content(f"{name}.txt")[7]
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("_")]


def test_yearly_and_daily_files(model, tmp_path):
    reports.write_report_set(reports.yearly(model, "north", 1, "2023-05-01", "2024-01-01"), str(tmp_path))
    for year in ("2023", "2024"):
        grid = grids.year_grid(model, "north", 1, int(year), use_id="ext")
        assert content(tmp_path / f"RepCuantAnual_{year}.txt") == text_report(model, grid, "anio", year)
    reports.write_report_set(reports.daily(model, "north", 1, "2023-12-31", "2024-01-02", "05:00"), str(tmp_path))
    for day in ("2023-12-31", "2024-01-01", "2024-01-02"):
        grid = grids.intraday_grid(model, "north", 1, day, "05:00", use_id="ext_only")
        path = tmp_path / f"RepCuantDiario_{day.replace('-', '')}.csv"
        assert content(path) == csv_report(model, grid, "dia", day, "05:00")


def test_long_reports_go_on_in_numbered_files(model, tmp_path):
    made = reports.monthly(model, "north", 1, "2024-01-01", "2024-01-31")
    paths = reports.write_files(made.lines(), str(tmp_path), "Rep", file_lines=12)
    assert [Path(p).name for p in paths] == ["Rep_202401.1.csv", "Rep_202401.csv", "Rep_202401.txt"]
    whole = content(tmp_path / "Rep_202401.csv")[:-1] + content(tmp_path / "Rep_202401.1.csv")[:-1]
    assert whole == [r.line for r in made.csv_lines().orderBy("line_no").collect()]


def test_files_are_replaced(model, tmp_path):
    for _ in range(2):
        paths = reports.write_report_set(reports.monthly(model, "north", 1, "2024-01-01", "2024-01-31"), str(tmp_path))
    assert len(paths) == 2 and len(list(tmp_path.glob("Rep*"))) == 2


def test_bad_ranges(model):
    for make in (reports.yearly, reports.monthly, reports.daily):
        with pytest.raises(ValueError):
            make(model, "north", 1, "2025-02-01", "2024-01-01")
    with pytest.raises(ValueError):
        reports.daily(model, "north", 1, "2024-01-01", "2024-01-01", "1 month")


@pytest.mark.parametrize("day", [29, 30, 31])
def test_every_month_of_the_range(model, day):
    made = reports.monthly(model, "north", 1, f"2024-01-{day}", "2024-03-01")
    assert [p.period for p in made.periods.frame(model.spark).collect()] == ["202401", "202402", "202403"]


@pytest.mark.parametrize("large", [False, True])
def test_levels(model, large, request):
    if large:
        request.getfixturevalue("nothing_fits")
    found = export.level_lines(export.levels(model, "5", "2024-01-01", "2024-01-02")).collect()
    assert [r.line for r in found] == ["5,1,01/01/2024,7,5,1e-7", "5,1,01/01/2024,7,45,1.25", "5,1,02/01/2024,0,0,3"]


def test_number_text(spark):
    expected = {
        3.0: "3", -6.55: "-6.55", 0.0: "0", -0.0: "0", 100.0: "100", 12345678.91: "12345678.91", 1e-6: "0.000001",
        1.5e-7: "1.5e-7", 1e21: "1e+21", 123456789012345670000.0: "123456789012345670000", 0.1 + 0.2: "0.30000000000000004",
        2251799813685248.5: "2251799813685248.5",
    }
    found = spark.createDataFrame([(v,) for v in expected], "v double").select("v", number_text(F.col("v")).alias("t"))
    assert {r.v: r.t for r in found.collect()} == expected


def test_document_files(model, tmp_path):
    grid = grids.day_grid(model, "north", 1, "2024-01-31", "2024-02-01", use_id="ext")
    reports.write_document(grid, str(tmp_path / "doc"))
    parts = sorted((tmp_path / "doc").glob("part-*"))
    found = json.loads("".join(p.read_text() for p in parts))
    whole = json.loads(render.document_json(grid).first().cells)
    assert {**found, "cells": sorted(found["cells"])} == whole


@pytest.mark.parametrize("station, start, end", [
    (None, "2024-01-01", "2024-01-02"), ("x", "2024-01-01", "2024-01-02"), (5, None, "2024-01-02"),
    (5, "2024-01-01", ""), (5, "someday", "2024-01-02"), (5, "2024-01-01", "someday"),
])
def test_level_arguments(model, station, start, end):
    with pytest.raises(ValueError):
        export.levels(model, station, start, end)


def test_panel(model):
    pairs = [(1, 2, "levels"), (1, 1, "rain"), (9, 1, "nowhere")]
    rows = panel(model, pairs, "2023-12-01", "2024-03-01").orderBy("y", "x").collect()
    assert [(r.label, [q.n for q in rows[4 * i:4 * i + 4]]) for i, r in enumerate(rows[::4])] == [
        ("levels", [0, 4, 0, 0]), ("rain", [1, 4, 2, 0]), ("nowhere", [0, 0, 0, 0])]
    assert rows[0].hour == "2023-12-01T00"


def test_no_line_is_lost_whatever_the_session_says_of_parts(model, tmp_path, setting):
    made = reports.monthly(model, "north", 1, "2024-01-01", "2024-02-01")
    before = {p.name: p.read_bytes() for p in tmp_path.iterdir()}
    reports.write_report_set(made, str(tmp_path))
    whole = {p.name: p.read_bytes() for p in tmp_path.glob("Rep*")}
    assert not before and len(whole) == 4
    with setting(**{"spark.sql.files.maxRecordsPerFile": "5"}):
        reports.write_report_set(made, str(tmp_path))
    assert {p.name: p.read_bytes() for p in tmp_path.glob("Rep*")} == whole


def test_files_stay_as_they_were_when_a_new_one_is_not_whole(spark, tmp_path):
    staging = tmp_path / "_staging-x"
    for name, parts in (("a.txt", 1), ("b.txt", 2)):
        (staging / f"file={name}").mkdir(parents=True)
        for i in range(parts):
            (staging / f"file={name}" / f"part-{i:05d}").write_text("new")
    (tmp_path / "a.txt").write_text("old")
    with pytest.raises(OSError):
        reports._publish(spark, str(staging), str(tmp_path))
    assert (tmp_path / "a.txt").read_text() == "old"


def test_the_plan_of_a_set_does_not_grow_with_its_periods(model):
    def size(end):
        made = reports.daily(model, "north", 1, "2024-01-01", end).lines()
        return len(made._jdf.queryExecution().logical().toString())

    assert size("2029-12-31") < size("2024-01-07") + 500
