from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallygrid.operators import matrices, vectors
from tallygrid.operators.tally import maximum
from tallygrid.sources.model import parquet_model

TICK = timedelta(microseconds=1)
START, END = datetime(2024, 1, 1), datetime(2024, 1, 4)
NETWORKS = [(1, "north", "North"), (2, "south", "South"), (3, "empty", "Empty")]
STATIONS = [
    (10, 110, None, "Ten", "north", True, True), (11, 111, None, "Eleven", "north", True, True),
    (20, 120, None, "Twenty", "south", True, True), (30, 130, None, "Lost", "nowhere", True, True),
]
# 1 and 2 share a station; 5 has no known network and 6 no known station.
SERIES = [(1, 10, 1, 1, 1), (2, 10, 1, 2, 1), (3, 11, 1, 1, 2), (4, 20, 1, 1, 1), (5, 30, 1, 1, 1), (6, 99, 1, 1, 1),
          (7, 20, 2, 1, 1)]
OBSERVED = [
    (1, START), (1, START - TICK), (1, START + timedelta(days=1) - TICK), (1, START + timedelta(days=1)),
    (2, START + timedelta(hours=5)), (3, END - TICK), (3, END), (4, START + timedelta(hours=7)), (4, END - TICK),
    (5, START), (6, START), (7, START), (8, START),
]


@pytest.fixture
def model(model_of):
    return model_of(redes=NETWORKS, estaciones=STATIONS, series=SERIES,
                    observaciones=[(i, *row) for i, row in enumerate(OBSERVED)])


def counts(rows):
    return [r.n for r in rows.collect()]


def check(model):
    one = {"var_id": 1}
    # The last bucket starts at the end, so nothing can fall into it.
    assert counts(vectors.obs_density(model, START, END, "1 day", one)) == [4, 1, 2, 0]
    assert counts(vectors.station_density(model, START, END, "1 day", one)) == [2, 1, 2, 0]
    # A bucket that straddles the end is partial.
    assert counts(vectors.obs_density(model, START, END, "2 days", one)) == [5, 2]
    assert counts(vectors.obs_density(model, START, END, "1 month", one)) == [7]
    assert counts(vectors.obs_density(model, START, END, "1 day", {"tabla_id": "south"})) == [2, 0, 1, 0]
    assert counts(vectors.obs_density(model, START, END, "1 day", {"estacion_id": 10, "proc_id": 2})) == [1, 0, 0, 0]
    assert counts(vectors.obs_density(model, START, END, "1 day", {"unit_id": [1, "2x"]})) == [5, 1, 2, 0]
    assert counts(vectors.obs_density(model, START, END, "1 day", {"tabla_id": "empty"})) == [0, 0, 0, 0]


def test_small_series_tables(model):
    check(model)


def test_large_series_tables(model, nothing_fits):
    check(model)


def test_rows_come_in_order(model):
    rows = vectors.obs_density(model, START, END, "6 hours", {"var_id": 1}).collect()
    assert [r.x for r in rows] == list(range(1, 14))
    assert rows[1].t == START + timedelta(hours=6)


def test_guards(model):
    with pytest.raises(ValueError):
        vectors.obs_density(model, START, END, "1 day", {})
    with pytest.raises(ValueError):
        vectors.obs_density(model, START, END, "1 day", {"var_id": 0})
    with pytest.raises(ValueError):
        vectors.obs_density(model, START, END, "", {"var_id": 1})
    with pytest.raises(ValueError):
        vectors.obs_density(model, "someday", END, "1 day", {"var_id": 1})
    with pytest.raises(ValueError):
        vectors.obs_density(model, START, END, "1 day", {"var_id": "x", "proc_id": 1})


def test_default_period(model):
    rows = vectors.obs_density(model, filter={"var_id": 1}, now=datetime(2024, 1, 15, 9)).collect()
    assert (rows[0].t, rows[-1].t, len(rows)) == (datetime(2023, 12, 15), datetime(2024, 1, 15), 32)
    assert sum(r.n for r in rows) == 9


def test_other_kinds(model_of):
    model = model_of(
        series_areal=[(1, 5, 7, 1, 1, 1), (2, 5, 8, 1, 1, 1)], observaciones_areal=[(1, START), (2, START), (3, START)],
        series_rast=[(1, 4, 7, 1, 1, 1), (2, 4, 8, 2, 1, 1)], observaciones_rast=[(1, START), (2, START), (2, END)])
    assert counts(vectors.areal_density(model, START, END, "1 day", {"fuentes_id": 7})) == [1, 0, 0, 0]
    assert counts(vectors.areal_density(model, START, END, "1 day", {"area_id": 5})) == [2, 0, 0, 0]
    assert counts(vectors.raster_density(model, START, END, "1 day", {"series_id": 2})) == [1, 0, 0, 0]
    assert counts(vectors.raster_density(model, START, END, "1 day", {"escena_id": 4})) == [2, 0, 0, 0]


def test_shapes(model):
    rows = vectors.obs_density(model, START, END, "1 day", {"var_id": 1})
    days = [START + timedelta(days=i) for i in range(4)]
    assert vectors.as_arrays(rows).columns == ["values"]
    found = vectors.as_arrays(rows, include_timestamps=True).collect()[0]
    assert (found["values"], found["timestamps"]) == ([4, 1, 2, 0], days)
    tuples = vectors.as_tuples(rows).collect()[0].tuples
    assert [(t.x, t.t, t["count"]) for t in tuples] == list(zip([1, 2, 3, 4], days, [4, 1, 2, 0]))


@pytest.mark.parametrize("large", [False, True])
def test_matrix_rows_are_vectors(model, large, request):
    if large:
        request.getfixturevalue("nothing_fits")
    for count, one in (("registros", vectors.obs_density), ("estaciones", vectors.station_density)):
        cells = matrices.network_matrix(model, START, END, "1 day", {"var_id": 1}, count)
        rows = cells.orderBy("y", "x").collect()
        assert [r.label for r in rows[::4]] == ["North", "South", "Empty"]
        for i, (_, code, _) in enumerate(NETWORKS):
            assert [r.n for r in rows[4 * i:4 * i + 4]] == counts(
                one(model, START, END, "1 day", {"var_id": 1, "tabla_id": code}))
    assert rows[1].hour == "2024-01-02T00"
    busiest = maximum(matrices.network_matrix(model, START, END, "1 day", {"var_id": 1}))
    assert busiest.collect()[0].max == 3


def test_maximum_of_nothing(model_of):
    cells = matrices.network_matrix(model_of(), START, END, "1 day")
    assert cells.count() == 0 and maximum(cells).collect()[0].max == 0


def test_day_column_prunes_partitions(spark, tmp_path, model):
    for name in ("redes", "estaciones", "series"):
        model.table(name).write.parquet(str(tmp_path / name))
    facts = model.table("observaciones").withColumn("fecha", F.to_date("timestart"))
    facts.write.partitionBy("fecha").parquet(str(tmp_path / "observaciones"))
    stored = parquet_model(spark, str(tmp_path), day_column="fecha")
    rows = vectors.obs_density(stored, START, END, "1 day", {"var_id": 1})
    assert counts(rows) == [4, 1, 2, 0]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fecha" in plan and "GreaterThanOrEqual(timestart,2024-01-01T00:00)" in plan


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_zoned_columns_still_reach_the_scan(spark, setting, tmp_path, model, zone):
    for name in ("redes", "estaciones", "series"):
        model.table(name).write.parquet(str(tmp_path / name))
    with setting(**{"spark.sql.session.timeZone": zone}):
        facts = model.table("observaciones").selectExpr("id", "series_id", "cast(timestart as timestamp) timestart")
        facts.write.parquet(str(tmp_path / "observaciones"))
        rows = vectors.obs_density(parquet_model(spark, str(tmp_path), zone=zone), START, END, "1 day", {"var_id": 1})
        assert counts(rows) == [4, 1, 2, 0]
        assert "PushedFilters: [IsNotNull(timestart), GreaterThanOrEqual(timestart,2023-12-30" in (
            rows._jdf.queryExecution().executedPlan().toString())


def test_a_busy_series_shrinks_before_the_join(model, nothing_fits):
    plan = vectors.obs_density(model, START, END, "1 day", {"var_id": 1})._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join Inner, (series_id")
    assert "Aggregate [series_id" in plan[join:]
