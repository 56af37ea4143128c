"""Every registered query against its SQL, as the driver compares them, on the smallest scale."""

import pytest

import __spark_entry__ as entry
from compare import check, database
from tallygrid.checks import oracles, queries

DIRECTORY = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries.queries(), oracles.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return database(DIRECTORY)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, connection, name):
    frame = QUERIES[name](spark, DIRECTORY)
    assert check(frame, connection, ORACLES[name]) == ""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert node not in plan


LARGE = (
    "obs_density_unaligned", "station_density_1d", "areal_density_1m_jan31", "prono_density_point",
    "run_density_1m_raster", "matrix_network_stations", "matrix_calibration_series_areal", "grid_day_station_name",
    "grid_day_area", "grid_day_runs_model", "report_set_yearly", "calibrations_series_point", "panel_month",
)


@pytest.mark.parametrize("name", LARGE)
def test_the_way_for_large_tables_gives_the_same(spark, connection, nothing_fits, name):
    assert check(QUERIES[name](spark, DIRECTORY), connection, ORACLES[name]) == ""
