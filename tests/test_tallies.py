"""Stored tallies by day and bitmaps of stations against direct answers."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallygrid.functions.axis import Axis
from tallygrid.operators import grids, matrices, vectors
from tallygrid.operators.hits import split
from tallygrid.plans.tallies import DayTallies, months_of
from tallygrid.sources.model import Model

START, DAY = datetime(2023, 12, 20), timedelta(days=1)


def whole(frame):
    return sorted(map(repr, frame.collect()))


@pytest.fixture
def model(model_of):
    rng = random.Random(4)
    stations = [(i, 100 + i, f"e{i}", f"S{i}", ["n", "s", "w"][i % 3], True, True) for i in range(30)]
    stations.append((40_000, 1, "x", "Far", "n", True, True))
    series = [(10 * s[0] + v, s[0], v, 1 + v % 2, 1 + s[0] % 2) for s in stations for v in (1, 2)]
    facts = [(i, rng.choice(series)[0], START + rng.random() * 60 * DAY) for i in range(1500)]
    facts += [(9000 + i, 11, START + i * DAY) for i in range(60)] + [(9100, 11, START + 20 * DAY - timedelta(microseconds=1))]
    areal = [(i, 1, 1, 1, 1, 1) for i in range(4)]
    return model_of(
        redes=[(1, "n", "North"), (2, "s", "South"), (3, "w", "West")], estaciones=stations, series=series, observaciones=facts,
        series_areal=areal, areas_pluvio=[(1, "A", True, True)],
        observaciones_areal=[(rng.randrange(4), START + rng.random() * 60 * DAY) for _ in range(300)])


@pytest.fixture
def stored(spark, model, tmp_path):
    store = DayTallies(spark, str(tmp_path))
    store.append(model, date(2023, 12, 22), date(2024, 1, 5), ("puntual", "areal"))
    store.append(model, date(2024, 1, 3), date(2024, 1, 20), ("puntual", "areal"))
    store.append(model, date(2024, 2, 3), date(2024, 2, 9), ("puntual", "areal"))
    return store


@pytest.mark.parametrize("start, end, dt", [
    ("2023-12-20", "2024-02-20", "1 day"), ("2023-12-21 05:30:00", "2024-02-10", "7 days"), ("2023-12-31", "2024-02-18", "1 month"),
    ("2024-01-01", "2024-01-10", "3 hours"), ("2024-01-02 12:00:00", "2024-01-18 13:00:00", "3 days"), ("2024-01-01", "2024-01-15", "2 days"),
    ("2024-01-31 10:00:00", "2024-02-18", "1 month"), ("2023-12-01", "2024-01-04 07:00:00", "1 year"),
])
def test_answers_are_those_of_the_observations(model, stored, start, end, dt):
    by_day = stored.model(model)
    for ask in (
            lambda m: vectors.obs_density(m, start, end, dt, {"var_id": 1}),
            lambda m: vectors.areal_density(m, start, end, dt, {"var_id": 1}),
            lambda m: vectors.station_density(m, start, end, dt, {"tabla_id": ["n", "s"], "unit_id": 1}),
            lambda m: vectors.station_density(m, start, end, dt, {"estacion_id": 1, "proc_id": 2}),
            lambda m: matrices.network_matrix(m, start, end, dt, {"var_id": 1}, "estaciones")):
        assert whole(ask(by_day)) == whole(ask(model))


def test_grids(model, stored):
    by_day = stored.model(model)
    for ask in (
            lambda m: grids.day_grid(m, "n", 1, "2023-12-25", "2024-01-25", proc_id=2), lambda m: grids.year_grid(m, "s", 2, 2024),
            lambda m: grids.intraday_grid(m, "n", 1, "2024-01-05", proc_id=2), lambda m: grids.network_grid(m, 2, "2024-01-01", "2024-01-09"),
            lambda m: grids.area_grid(m, 1, "2024-01-01", "2024-01-31")):
        assert whole(ask(by_day).cells()) == whole(ask(model).cells())


def test_stored_days_read_no_observations_but_at_the_ends(spark, model, stored):
    def without_middle(name):
        frame = model._load(name)
        return frame.where("timestart < '2023-12-22' or timestart >= '2024-01-20'") if name == "observaciones" else frame

    rest = stored.model(Model(spark, without_middle))
    for ask in (lambda m: vectors.obs_density(m, "2023-12-20", "2024-01-25", "1 day", {"var_id": 1}),
                lambda m: vectors.station_density(m, "2023-12-20", "2024-01-25", "1 day", {"var_id": 1})):
        assert whole(ask(rest)) == whole(ask(model))
    inside = vectors.obs_density(stored.model(model), "2024-01-01", "2024-01-06", "1 day", {"var_id": 1})
    assert "timestart" not in inside._jdf.queryExecution().optimizedPlan().toString()


def test_days_counted_again_take_effect(spark, model_of, model, stored):
    more = Model(spark, lambda name: model._load(name).unionByName(
        model._load(name).limit(0) if name != "observaciones" else spark.createDataFrame(
            [(7, 11, datetime(2024, 1, 4, 3))], model._load(name).schema)))
    assert whole(vectors.obs_density(stored.model(more), "2024-01-01", "2024-01-10", "1 day", {"var_id": 1})) == whole(
        vectors.obs_density(model, "2024-01-01", "2024-01-10", "1 day", {"var_id": 1}))
    before = stored.versions.parts()
    stored.append(more, date(2024, 1, 4), date(2024, 1, 5), ("puntual",))
    assert whole(vectors.obs_density(stored.model(more), "2024-01-01", "2024-01-10", "1 day", {"var_id": 1})) == whole(
        vectors.obs_density(more, "2024-01-01", "2024-01-10", "1 day", {"var_id": 1}))
    # Only the month of that day was written again, and only for the kind asked for.
    changed = {name for name, path in stored.versions.parts().items() if before.get(name) != path}
    assert changed == {"observaciones/2024-01-01_2024-01-20", "estaciones/2024-01-01_2024-01-20"}


def test_gaps_within_a_month_are_refused(model, stored):
    with pytest.raises(ValueError):
        stored.append(model, date(2024, 2, 12), date(2024, 2, 14), ("puntual",))
    stored.append(model, date(2024, 2, 9), date(2024, 2, 14), ("puntual",))
    assert (date(2024, 2, 3), date(2024, 2, 14)) in stored.spans("observaciones")


def test_days_without_observations_are_stored(spark, model, tmp_path):
    store = DayTallies(spark, str(tmp_path))
    store.append(model, date(2020, 1, 30), date(2020, 3, 2))
    assert store.spans("observaciones") == months_of(date(2020, 1, 30), date(2020, 3, 2))
    found = vectors.obs_density(store.model(model), "2020-01-30", "2020-02-10", "1 day", {"var_id": 1})
    assert found.agg(F.sum("n")).first()[0] == 0


def test_splitting():
    axis = Axis.of(datetime(2024, 1, 1), datetime(2024, 1, 9), "1 day")
    stored = [(date(2024, 1, 2), date(2024, 1, 5)), (date(2024, 1, 5), date(2024, 1, 7))]
    spans, ranges = split(axis, datetime(2024, 1, 1, 6), datetime(2024, 1, 6, 23, 59, 59), True, stored)
    assert spans == [(date(2024, 1, 2), date(2024, 1, 6))]
    assert ranges == [(datetime(2024, 1, 1, 6), datetime(2024, 1, 2), False),
                      (datetime(2024, 1, 6), datetime(2024, 1, 6, 23, 59, 59), True)]
    assert split(axis, datetime(2024, 1, 7), datetime(2024, 1, 9), False, stored) is None
    assert split(Axis.of(axis.start, axis.end, "6 hours"), axis.start, axis.end, False, stored) is None
