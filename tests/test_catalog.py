import pytest

from tallygrid.operators import catalog


@pytest.fixture
def model(model_of):
    return model_of(
        redes=[(2, "south", "South"), (1, "north", "North")], var=[(1, "h", "Level"), (2, "q", "Flow")],
        procedimiento=[(2, "estimated"), (1, "measured")], unidades=[(1, "metre", "m")],
        fuentes=[(7, "Radar")], calibrados_grupos=[(20, "B"), (10, "A")],
        series_rast=[(2, 4, 7, 1, 1, 1), (1, 4, 7, 2, 1, 1), (3, 4, 99, 1, 1, 1)],
        series=[(1, 5, 1, 1, 1)], series_areal=[(1, 8, 7, 2, 2, 1)], areas_pluvio=[(8, "Basin", True, True)],
        estaciones=[(5, 1, None, "Five", "north", True, True)])


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def test_all_in_order(model):
    assert rows(catalog.networks(model)) == [(1, "north", "North"), (2, "south", "South")]
    assert rows(catalog.variables(model)) == [(1, "h", "Level"), (2, "q", "Flow")]
    assert rows(catalog.procedures(model)) == [(1, "measured"), (2, "estimated")]
    assert rows(catalog.units(model)) == [(1, "metre")]
    assert rows(catalog.sources(model)) == [(7, "Radar")]
    assert rows(catalog.calibration_groups(model)) == [(10, "A"), (20, "B")]
    # A series with an unknown source has no name.
    assert rows(catalog.raster_series(model)) == [(1, "q/Radar"), (2, "h/Radar")]


def test_by_id_or_code(model):
    assert rows(catalog.networks(model, "2")) == rows(catalog.networks(model, "south")) == [(2, "south", "South")]
    assert rows(catalog.variables(model, 2)) == rows(catalog.variables(model, "q")) == [(2, "q", "Flow")]
    assert rows(catalog.networks(model, "")) == rows(catalog.networks(model))
    assert rows(catalog.calibration_groups(model, "20 ")) == [(20, "B")]
    assert rows(catalog.raster_series(model, 2)) == [(2, "h/Radar")]
    assert rows(catalog.networks(model, "east")) == []


@pytest.mark.parametrize("lookup, value", [
    (catalog.networks, "a b"), (catalog.networks, "a'"), (catalog.variables, "a;"), (catalog.procedures, "measured"),
    (catalog.units, "m"), (catalog.sources, "Radar"), (catalog.raster_series, "h"), (catalog.calibration_groups, "x"),
])
def test_refused(model, lookup, value):
    with pytest.raises(ValueError):
        lookup(model, value)


def test_labels(model):
    assert [r.label for r in catalog.picker_label(catalog.networks(model), "tabla_id").collect()] == [
        "North(north[1])", "South(south[2])"]
    assert [r.label for r in catalog.picker_label(catalog.sources(model)).collect()] == ["Radar (7)"]


def test_named_series(model):
    found = {(r.tipo, r.id): r for r in catalog.named_series(model).collect()}
    assert len(found) == 5
    point, areal, raster = found["puntual", 1], found["areal", 1], found["raster", 3]
    assert (point.estacion_nombre, point.fuentes_nombre, point.proc_nombre, point.var_var) == ("Five", None, "measured", "h")
    assert (areal.area_id, areal.estacion_nombre, areal.fuentes_nombre, areal.proc_nombre) == (8, "Basin", "Radar", "estimated")
    assert (raster.escena_id, raster.fuentes_nombre, raster.unit_abrev) == (4, None, "m")
