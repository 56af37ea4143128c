from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallygrid.functions.predicates import (
    NOT_NULL, Spec, build, clean_filter, integer, number, per_table, require_any, trunc_span, truthy,
)

ROWS = [
    (1, "Alpha", True, datetime(1998, 8, 5, 12), 1.5, "1 day", (0.0, 0.0)),
    (2, "beta", False, datetime(2000, 12, 31, 23, 59, 59), 2.5, "24:00:00", (0.0005, 0.0005)),
    (3, "alphabet", None, datetime(2001, 1, 1), 3.5, "1 month", (0.0, 0.001)),
    (12, None, True, None, None, "30 days", (1.0, 1.0)),
]
SCHEMA = ("id long, name string, flag boolean, at timestamp_ntz, value double, step string, "
          "place struct<lon: double, lat: double>")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


CASES = [
    ("name", Spec("regex_string"), "^ALPHA", [1, 3]),
    ("name", Spec("string"), "beta", [2]),
    ("name", Spec("string"), ["beta", None, "", "Alpha"], [1, 2]),
    ("name", Spec("string", case_insensitive=True), "ALPHA", [1]),
    ("name", Spec("string", case_insensitive=True), ["BETA", "alpha"], [1, 2]),
    ("name", Spec("string"), "", []),
    ("name", Spec("string"), NOT_NULL, [1, 2, 3]),
    ("flag", Spec("boolean"), "Verdadero", [1, 12]),
    ("flag", Spec("boolean"), "no", [2]),
    ("flag", Spec("boolean"), True, [1, 12]),
    ("flag", Spec("boolean_only_true"), "si", [1, 12]),
    ("flag", Spec("boolean_only_false"), "false", [2]),
    ("place", Spec("geometry"), (0.0, 0.0), [1, 2]),
    ("at", Spec("date"), "2001-01-01", [3]),
    ("at", Spec("timestamp"), datetime(1998, 8, 5, 12), [1]),
    ("at", Spec("date", trunc="century"), "1950-01-01", [1, 2]),
    ("at", Spec("date", trunc="millennium"), "2500-01-01", [3]),
    ("at", Spec("date", trunc="decade"), "2009-01-01", [2, 3]),
    ("at", Spec("date", trunc="second"), "2000-12-31T23:59:59.5", [2]),
    ("at", Spec("timestart"), "2000-12-31T23:59:59", [2, 3]),
    ("at", Spec("timeend"), "2000-12-31T23:59:59", [1, 2]),
    ("at", Spec("greater_or_equal_date"), "2001-01-01T00:00:00Z", [3]),
    ("at", Spec("smaller_or_equal_date"), "1998-08-05T12:00:00Z", [1]),
    ("value", Spec("numeric_interval"), ["1.5m", "2.5"], [1, 2]),
    ("value", Spec("numeric_interval"), "3.5", [3]),
    ("value", Spec("numeric_min"), 2.5, [2, 3]),
    ("value", Spec("numeric_max"), "2.5 m", [1, 2]),
    ("id", Spec("integer"), "12abc", [12]),
    ("id", Spec("integer"), ["2", "x", 3.7, None], [2, 3]),
    ("id", Spec("integer"), 0, []),
    ("value", Spec("number"), "2.5e0", [2]),
    ("value", Spec("float"), ["x", 1.5, ".35e1"], [1, 3]),
    ("step", Spec("interval"), "1 day", [1, 2]),
    ("step", Spec("interval"), "1 month", [3, 12]),
    ("id", Spec(), 3, [3]),
    ("id", Spec(), [1, 12], [1, 12]),
]


@pytest.mark.parametrize("key, spec, value, expected", CASES, ids=[f"{c[0]}-{c[1].type}-{i}" for i, c in enumerate(CASES)])
def test_condition(rows, key, spec, value, expected):
    found = per_table({key: spec}, {key: value})[""]
    assert sorted(r.id for r in rows.where(found).collect()) == expected


def test_no_condition():
    assert per_table({"flag": Spec("boolean_only_true"), "id": Spec("integer")}, {"flag": "no", "id": None, "z": 1}) == {}
    assert per_table({"flag": Spec("boolean_only_false")}, {"flag": "yes"}) == {}


def test_errors_are_collected():
    specs = {"a": Spec("integer"), "b": Spec("string", required=True), "c": Spec("string"), "d": Spec("float"),
             "e": Spec("numeric_interval"), "f": Spec("date"), "g": Spec("string"), "h": Spec("geometry"),
             "i": Spec("date", trunc="fortnight"), "j": Spec("string")}
    values = {"a": "x", "c": "o'clock", "d": ["y"], "e": [1], "f": "never", "g": [None, ""], "h": "here",
              "i": "2024-01-01", "j": ["fine", "a;b"]}
    with pytest.raises(ValueError) as caught:
        per_table(specs, values)
    assert len(str(caught.value).splitlines()) == 1 + len(specs)


def test_tables_and_columns(rows):
    specs = {"one": Spec("integer", "left", "id"), "two": Spec("float", column="value"), "name": Spec("string", "left")}
    values = {"one": [1, 2], "two": 2.5, "name": NOT_NULL}
    assert sorted(per_table(specs, values, "right")) == ["left", "right"]
    joined = rows.alias("left").join(rows.alias("right"), F.col("left.id") == F.col("right.id"))
    assert [r[0] for r in joined.where(build(specs, values, "right")).select("left.id").collect()] == [2]


def test_lenient_numbers():
    assert [integer(v) for v in ("12abc", " -3", "4.9", "x", True, 7)] == [12, -3, 4, None, None, 7]
    assert [number(v) for v in ("1.5m", ".5", "-2e2x", "x", False)] == [1.5, 0.5, -200.0, None, None]
    assert truthy("Si") and truthy(1) and not truthy("") and not truthy("no")


def test_request_filters():
    query = {"timestart": "a", "timeend": "b", "dt": "1 day", "var_id": "1", "x": "", "y": None}
    assert clean_filter(query) == {"var_id": "1"}
    assert clean_filter(query, keep_range=True) == {"timestart": "a", "timeend": "b", "var_id": "1"}


def test_a_zero_is_no_filter_for_the_guard():
    with pytest.raises(ValueError):
        require_any({"id": Spec("integer")}, {"id": 0, "other": 5})
    require_any({"id": Spec("integer")}, {"id": 3})


def test_trunc_spans():
    at = datetime(2024, 5, 15, 13, 14, 15, 123456)
    expected = {
        "microseconds": datetime(2024, 5, 15, 13, 14, 15, 123457),
        "milliseconds": datetime(2024, 5, 15, 13, 14, 15, 124000),
        "second": datetime(2024, 5, 15, 13, 14, 16), "minute": datetime(2024, 5, 15, 13, 15),
        "hour": datetime(2024, 5, 15, 14), "day": datetime(2024, 5, 16), "week": datetime(2024, 5, 20),
        "month": datetime(2024, 6, 1), "quarter": datetime(2024, 7, 1), "year": datetime(2025, 1, 1),
        "decade": datetime(2030, 1, 1), "century": datetime(2101, 1, 1), "millennium": datetime(3001, 1, 1),
    }
    for field, after in expected.items():
        first, found = trunc_span(field, at)
        assert found == after and first <= at < found
        assert trunc_span(field, first) == (first, found)
    assert trunc_span("week", at)[0] == datetime(2024, 5, 13)
    assert trunc_span("century", datetime(2000, 1, 1))[0] == datetime(1901, 1, 1)


def test_ranges_reach_the_scan(spark, tmp_path, rows):
    rows.select("id", "at").write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    found = stored.where(per_table({"at": Spec("date", trunc="month")}, {"at": "1998-08-20"})[""])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(at,1998-08-01T00:00)" in plan and "LessThan(at,1998-09-01T00:00)" in plan


@pytest.mark.parametrize("made, value, same", [
    ("make_dt_interval(1, 3)", "1 day 03:00:00", True), ("make_dt_interval(1, 3)", "03:00", False),
    ("make_dt_interval(0, 0, 0, 1.5)", "00:00:01", False), ("make_ym_interval(0, 2)", "2 months", True),
    ("make_ym_interval(1, 0)", "12 months", True), ("make_ym_interval(0, -2)", "2 months", False),
    ("-make_dt_interval(1)", "1 day", False), ("'-1 day'", "1 day", False), ("'1 day 03:00'", "27 hours", True),
    ("'some day'", "0 seconds", None), ("''", "0 seconds", None), ("cast(null as string)", "1 day", None),
    ("'1 month'", "30 days", True), ("'2 weeks 1 min'", "14 days 00:01", True),
])
def test_intervals_of_any_kind(spark, made, value, same):
    condition = per_table({"i": Spec("interval")}, {"i": value})[""]
    assert spark.sql(f"SELECT {made} i").select(condition.alias("c")).first().c is same
