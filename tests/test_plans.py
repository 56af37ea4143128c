"""What the plans of the registered queries must and must not contain."""

import re

import pytest

from tallygrid.checks.queries import queries
from tallygrid.functions.sizing import ensure_checkpoint_dir

DIRECTORY = "/root/testdata/sf0.001"
QUERIES = queries()


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def scans(text: str, table: str) -> list[str]:
    return [line for line in text.splitlines() if f"/{table}.parquet" in line]


@pytest.mark.parametrize("name, table, pushed", [
    ("obs_density_1d", "events", ["GreaterThanOrEqual(ts,2024-01-01T00:00)", "LessThan(ts,2024-01-31T00:00)"]),
    ("areal_density_1m", "lineitem", ["GreaterThanOrEqual(l_shipdate,1996-01-01T00:00)", "LessThan(l_shipdate,1997-01-01T00:00)"]),
    ("grid_day_station_ext", "events", ["GreaterThanOrEqual(ts,2024-01-01T00:00)", "LessThanOrEqual(ts,2024-01-15T23:59:59)"]),
    ("report_set_monthly", "events", ["GreaterThanOrEqual(ts,2023-12-01T00:00)", "LessThanOrEqual(ts,2024-02-29T23:59:59)"]),
])
def test_ranges_are_pushed_to_the_scan(spark, setting, name, table, pushed):
    with setting(**{"spark.sql.maxMetadataStringLength": "5000"}):
        found = scans(plan(QUERIES[name](spark, DIRECTORY)), table)
    assert any(all(p in scan for p in pushed) for scan in found)


def test_only_needed_columns_are_read(spark):
    for scan in scans(plan(QUERIES["obs_density_1d"](spark, DIRECTORY)), "events"):
        read = re.search(r"ReadSchema: struct<(.*)>", scan).group(1)
        assert {c.split(":")[0] for c in read.split(",")} <= {"ts", "user_id", "event_type"}


def test_small_series_tables_leave_one_shuffle_of_facts(spark):
    text = plan(QUERIES["obs_density_1d"](spark, DIRECTORY))
    counted = text[:text.index("GreaterThanOrEqual(ts")]
    # On the way from the fact scan to the result: a partial count, one exchange, and broadcast joins only.
    assert "partial_count" in counted and "SortMergeJoin" not in counted
    assert counted.count("Exchange hashpartitioning") <= 2


def test_checkpoints_go_where_the_session_says(spark):
    ensure_checkpoint_dir(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert named.rstrip("/") in spark.sparkContext.getCheckpointDir()


@pytest.mark.parametrize("name", [
    "matrix_calibration_values", "matrix_calibration_runs", "matrix_calibration_series_point",
    "matrix_calibration_series_areal",
])
def test_calibration_matrices_read_the_forecasts_once(spark, setting, name):
    # Without adaptive execution the plan says beforehand which exchanges are used again.
    with setting(**{"spark.sql.adaptive.enabled": "false"}):
        text = plan(QUERIES[name](spark, DIRECTORY))
    forecasts = [scan for scan in scans(text, "lineitem") if "l_linenumber" in scan]
    assert len(forecasts) == 1


@pytest.mark.parametrize("name", ["matrix_calibration_series_areal", "grid_day_area", "grid_day_station_ext"])
def test_numbering_starts_no_job(spark, nothing_fits, name):
    tracker = spark.sparkContext.statusTracker()
    group = f"planning {name}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        frame = QUERIES[name](spark, DIRECTORY)
        text = plan(frame)
        assert list(tracker.getJobIdsForGroup(group)) == []
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert "ExistingRDD" not in text and "CartesianProduct" not in text
