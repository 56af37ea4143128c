from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tallygrid.operators import forecasts, vectors
from tallygrid.plans import requests
from tallygrid.plans.coverage import refresh_coverage, write_coverage
from tallygrid.sources.model import Model, parquet_model, wall_clock

AT = datetime(2024, 7, 1, 12, 30, 0, 250000)
FORECASTS = {
    "series": [(1, 5, 1, 1, 1), (2, 5, 1, 1, 1)], "estaciones": [(5, 1005, "x", "Five", "north", True, True)],
    "corridas": [(11, 1, AT), (12, 1, AT)], "pronosticos": [(11, 1, AT), (11, 2, AT), (12, 1, AT)],
}


@pytest.mark.parametrize("session_zone", ["UTC", "America/Argentina/Buenos_Aires", "Pacific/Kiritimati"])
def test_zoned_columns_do_not_depend_on_the_sessions_zone(spark, setting, session_zone):
    zoned = spark.createDataFrame([(AT.replace(tzinfo=timezone.utc),)], "t timestamp")
    with setting(**{"spark.sql.session.timeZone": session_zone}):
        made = zoned.select(wall_clock(F.col("t"), "UTC").alias("u"), wall_clock(F.col("t"), "America/New_York").alias("n"))
        assert tuple(made.first()) == (AT, AT.replace(hour=8))


def test_tables_are_listed_once(spark, tmp_path):
    spark.createDataFrame([(1, "n", "N")], "id bigint, tabla_id string, nombre string").write.parquet(str(tmp_path / "redes"))
    model = parquet_model(spark, str(tmp_path))
    assert model._load("redes") is model._load("redes") and model.table("redes").count() == 1


def stored(spark, model, directory) -> Model:
    frame = spark.read.parquet(directory)
    return Model(spark, lambda name: frame if name == forecasts.COVERAGE else model._load(name),
                 stored_views={forecasts.COVERAGE})


def test_coverage_is_kept_and_refreshed_by_run(spark, model_of, tmp_path):
    def listed(model):
        return sorted(map(str, forecasts.coverage(model).select("series_id", "cor_id", "count").collect()))

    before = model_of(**FORECASTS)
    write_coverage(before, str(tmp_path / "a"))
    assert listed(stored(spark, before, str(tmp_path / "a"))) == listed(before)
    after = model_of(**{**FORECASTS, "pronosticos": [*FORECASTS["pronosticos"], (12, 1, AT), (12, 2, AT)]})
    runs = spark.createDataFrame([(12,)], "cor_id bigint")
    refresh_coverage(after, spark.read.parquet(str(tmp_path / "a")), runs, str(tmp_path / "b"))
    assert listed(stored(spark, after, str(tmp_path / "b"))) == listed(after) != listed(before)


def test_requests(model_of):
    model = model_of(**FORECASTS, redes=[(1, "north", "North")], observaciones=[(1, 1, AT), (2, 2, AT)])
    query = {"timestart": "2024-07-01", "timeend": "2024-07-02", "dt": "1 day", "var_id": "1", "proc_id": ""}
    rows = requests.observed(model, query).collect()
    assert [r.n for r in rows] == [2, 0]
    assert [r.n for r in requests.observed(model, {**query, "count": "estaciones"}).collect()] == [1, 0]
    assert requests.observed(model, {**query, "shape": "tuples"}).columns == vectors.as_tuples(
        vectors.obs_density(model, "2024-07-01", "2024-07-02", "1 day", {"var_id": 1})).columns
    for bad in ({"shape": "cube"}, {"tipo": "areal", "count": "estaciones"}):
        with pytest.raises(ValueError):
            requests.observed(model, {**query, **bad})
