import json
from collections import Counter
from datetime import datetime, timedelta

import pytest

from tallygrid.operators import grids, matrices, render

FIRST, LAST = "2024-01-30", "2024-02-02"
NETWORKS = [(1, "north", "North"), (2, "south", "South of all"), (3, "none", "None")]
# unid, id, id_externo, nombre, tabla, habilitar, has_obs
STATIONS = [
    (5, 71, "EXT-000-LONG", "Alpha river station", "north", True, True),
    (3, 72, None, "Bee", "north", True, True),
    (4, 100234, "B", None, "north", True, True),
    (9, 74, "A", "Hidden", "north", False, True),
    (8, 75, "A", "Unseen", "north", True, False),
    (7, 76, "A", "Unknown", "north", True, None),
    (6, 77, "A", "Sea", "south", True, True),
]
# Station 3 has two matching series.
SERIES = [(1, 5, 1, 1, 1), (2, 3, 1, 1, 1), (22, 3, 1, 1, 2), (3, 4, 1, 1, 1), (4, 9, 1, 1, 1), (5, 8, 1, 1, 1),
          (6, 7, 1, 1, 1), (7, 6, 1, 1, 1), (8, 5, 4, 1, 1), (9, 5, 4, 2, 1)]
DAY = datetime(2024, 1, 30)
OBSERVED = [
    (1, DAY), (1, DAY + timedelta(hours=23, minutes=59, seconds=59, milliseconds=500)), (1, DAY - timedelta(microseconds=1)),
    (2, DAY + timedelta(days=1)), (22, DAY + timedelta(days=1, hours=3)),
    (3, datetime(2024, 2, 2, 23, 59, 59)), (3, datetime(2024, 2, 2, 23, 59, 59, 1)), (5, DAY), (6, DAY), (7, DAY),
    (8, DAY), (9, DAY), (9, DAY), (4, DAY),
]


@pytest.fixture
def model(model_of):
    return model_of(redes=NETWORKS, estaciones=STATIONS, series=SERIES,
                    observaciones=[(i, *row) for i, row in enumerate(OBSERVED)])


def table(grid):
    """label -> counts, in order of y."""
    rows = grid.rows.orderBy("y").collect()
    assert [r.y for r in rows] == list(range(len(rows)))
    return [(r.label, r["values"]) for r in rows]


def day_grid(model, **options):
    return grids.day_grid(model, "north", 1, FIRST, LAST, **options)


def check_days(model):
    # Both series of station 3 give a row, each with the counts of the station. The half second after the last
    # second of the range is lost; the one inside the range is not.
    assert table(day_grid(model)) == [
        ("Bee (3)", [0, 2, 0, 0]), ("Bee (3)", [0, 2, 0, 0]), (None, [0, 0, 0, 1]), ("Alpha river (5)", [2, 0, 0, 0])]


def test_days(model):
    check_days(model)


def test_days_of_large_tables(model, nothing_fits):
    check_days(model)


@pytest.mark.parametrize("mode, expected", [
    ("ext", [None, "EXT-000- - Alpha river", "3 - Bee", "3 - Bee"]),
    ("ext_only", ["B", "EXT-000-LONG", "3", "3"]),
    ("nombre", ["Alpha river sta", "Bee", "Bee", "4"]),
    ("id", ["71", "72", "72", "100234"]),
    ("other", ["Bee (3)", "Bee (3)", None, "Alpha river (5)"]),
])
@pytest.mark.parametrize("large", [False, True])
def test_labels_and_order(model, mode, expected, large, request):
    if large:
        request.getfixturevalue("nothing_fits")
    found = [label for label, _ in table(day_grid(model, use_id=mode))]
    # Key 100234 is cut to 10023, which sorts after 00071 and 00072.
    assert found == expected


def test_stations_without_known_observations(model):
    labels = [label for label, _ in table(day_grid(model, has_obs=False))]
    assert labels == ["Bee (3)", "Bee (3)", None, "Alpha river (5)", "Unseen (8)"]


def test_default_procedure(model):
    assert table(grids.day_grid(model, "north", 4, FIRST, LAST)) == [("Alpha river (5)", [2, 0, 0, 0])]
    assert table(grids.day_grid(model, "north", 4, FIRST, LAST, proc_id=1)) == [("Alpha river (5)", [1, 0, 0, 0])]


def test_month_argument(model):
    grid = grids.day_grid(model, "north", 1, month="2024-02")
    assert len(grid.dates()) == 29 and grid.dates()[-1] == "2024-02-29"
    assert dict(table(grid))[None][:3] == [0, 2, 0]


def test_year_is_the_sum_of_days(model):
    year = Counter()
    for label, values in table(grids.year_grid(model, "north", 1, 2024)):
        year[label] = values
    days = grids.day_grid(model, "north", 1, "2024-01-01", "2024-12-31").cells().collect()
    sums = Counter()
    for row in {(r.label, r.t, r.n) for r in days}:
        sums[row[0], row[1].month] += row[2]
    assert {(label, m + 1): n for label, values in year.items() for m, n in enumerate(values)} == dict(sums)


def test_intraday(model):
    grid = grids.intraday_grid(model, "north", 1, DAY, "05:00")
    assert grid.dates() == [f"2024-01-30T{h:02d}:00:00" for h in (0, 5, 10, 15, 20)]
    # The day ends with its last full second.
    assert table(grid)[-1] == ("Alpha river (5)", [1, 0, 0, 0, 0])


def test_defaults_follow_now(model):
    now = datetime(2024, 2, 6, 10)
    assert grids.day_grid(model, "north", 1, now=now).dates() == [f"2024-{d}" for d in (
        "01-30", "01-31", "02-01", "02-02", "02-03", "02-04", "02-05")]
    assert grids.intraday_grid(model, "north", 1, now=now).dates()[-1] == "2024-02-06T21:00:00"
    assert grids.year_grid(model, "north", 1, now=now).dates()[0] == "2024-01-01"


def test_needed_arguments(model):
    with pytest.raises(ValueError):
        grids.day_grid(model, "", 1, FIRST, LAST)
    with pytest.raises(ValueError):
        grids.year_grid(model, "north", None, 2024)
    with pytest.raises(ValueError):
        grids.run_grid(model, FIRST, LAST, match="week")


@pytest.mark.parametrize("large", [False, True])
def test_networks(model, large, request):
    if large:
        request.getfixturevalue("nothing_fits")
    assert table(grids.network_grid(model, 1, FIRST, LAST)) == [
        ("North (1)", [2, 2, 0, 1]), ("South of al (2)", [1, 0, 0, 0]), ("None (3)", [0, 0, 0, 0])]


def test_areas(model_of):
    model = model_of(
        areas_pluvio=[(2, "Upper basin of all", True, True), (1, "Low", True, True), (3, "Off", False, True),
                      (4, "Dark", True, False)],
        series_areal=[(1, 1, 7, 1, 1, 1), (2, 2, 7, 1, 1, 1), (3, 2, 7, 2, 2, 1), (4, 3, 7, 1, 1, 1),
                      (5, 4, 7, 1, 1, 1), (6, 1, 8, 1, 1, 1), (7, 1, 7, None, 1, 1)],
        observaciones_areal=[(1, DAY), (2, DAY), (3, DAY), (4, DAY), (6, DAY), (7, DAY)])
    rows = [("Low (1)", [1, 0, 0, 0]), ("Upper basin (2)", [2, 0, 0, 0]), ("Upper basin (2)", [2, 0, 0, 0])]
    # A series without a variable is left out even when any variable is asked for.
    assert table(grids.area_grid(model, 7, FIRST, LAST)) == rows
    assert table(grids.area_grid(model, 7, FIRST, LAST, var_id=2)) == [("Upper basin (2)", [1, 0, 0, 0])]
    assert table(grids.area_grid(model, 7, FIRST, LAST, proc_id=2)) == [("Upper basin (2)", [1, 0, 0, 0])]
    assert grids.area_grid(model, 7, FIRST, LAST).names == "areas"


def test_runs(model_of):
    model = model_of(
        calibrados=[(2, "Two", 1, 5, True), (11, "Eleven of many", 1, 6, False), (3, "No runs", 1, 5, True),
                    (4, "No model", 1, None, True)],
        corridas=[(1, 2, DAY), (2, 2, DAY + timedelta(hours=12)), (3, 11, DAY), (4, 11, DAY), (5, 4, DAY),
                  (6, 2, datetime(2023, 1, 1))])
    assert table(grids.run_grid(model, FIRST, LAST)) == [
        ("0002 - Two", [1, 0, 0, 0]), ("0011 - Eleven of m", [2, 0, 0, 0])]
    assert table(grids.run_grid(model, FIRST, LAST, match="day", use_id=False)) == [
        ("Two", [2, 0, 0, 0]), ("Eleven of m", [2, 0, 0, 0])]
    assert table(grids.run_grid(model, FIRST, LAST, model_id=6)) == [("0011 - Eleven of m", [2, 0, 0, 0])]


def test_grid_days_are_a_matrix_of_one_day_steps(model):
    grid = grids.network_grid(model, 1, FIRST, LAST).cells()
    matrix = matrices.network_matrix(model, FIRST, "2024-02-02T23:59:59.000001", "1 day", {"var_id": 1})
    # The matrix also counts stations that the grid leaves out.
    assert sum(r.n for r in matrix.collect()) == sum(r.n for r in grid.collect()) + 3
    assert {(r.x, r.y) for r in grid.collect()} == {(r.x, r.y) for r in matrix.collect()}


def test_document(model):
    grid = day_grid(model)
    found = json.loads(render.document_json(grid).first().cells)
    assert list(found) == ["dates", "estaciones", "cells"]
    assert found["dates"] == ["2024-01-30", "2024-01-31", "2024-02-01", "2024-02-02"]
    assert found["estaciones"] == ["Bee (3)", "Bee (3)", None, "Alpha river (5)"]
    assert [c[:2] for c in found["cells"]] == [[x, y] for x in range(4) for y in range(4)]
    assert [0, 3, 2] in found["cells"] and sum(c[2] for c in found["cells"]) == 7
    lines = render.document_lines(grid).orderBy("section", "y").collect()
    spread = json.loads("".join(r.line for r in lines))
    assert {**spread, "cells": sorted(spread["cells"])} == found


def test_documents_of_any_size_come_in_the_same_pieces(model, nothing_fits):
    grid = day_grid(model)
    whole = json.loads(render.document_json(grid).first().cells)
    pieces = [json.loads(r.cells) for r in render.document_json(grid, 3).orderBy("piece").collect()]
    assert [len(p["estaciones"]) for p in pieces] == [3, 1]
    assert sum((p["estaciones"] for p in pieces), []) == whole["estaciones"]
    assert sorted(sum((p["cells"] for p in pieces), [])) == sorted(whole["cells"])


def test_documents_without_rows_or_days(model):
    nobody = grids.day_grid(model, "none", 1, FIRST, LAST)
    assert json.loads(render.document_json(nobody).first().cells) == {
        "dates": ["2024-01-30", "2024-01-31", "2024-02-01", "2024-02-02"], "estaciones": None, "cells": None}
    never = grids.day_grid(model, "north", 1, LAST, FIRST)
    found = json.loads(render.document_json(never).first().cells)
    assert found["dates"] is None and found["cells"] is None and len(found["estaciones"]) == 4
    assert never.cells().count() == 0
