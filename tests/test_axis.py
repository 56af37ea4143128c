from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallygrid.functions.axis import Axis, add_months
from tallygrid.functions.steps import INTRADAY_STEPS, VECTOR_STEPS, Step, parse_interval, parse_step

SECOND = timedelta(seconds=1)


@pytest.mark.parametrize("text, months, seconds", [
    ("1 day", 0, 86400), ("2 days", 0, 172800), ("3 hours", 0, 10800), ("03:00", 0, 10800), ("00:15", 0, 900),
    ("03:00:00", 0, 10800), ("1 month", 1, 0), ("6 months", 6, 0), ("1 year", 12, 0), ("14 day", 0, 1209600),
    ("1 week", 0, 604800), ("1 day 03:00:00", 0, 97200), ("15 minutes", 0, 900), ("1 mon", 1, 0),
])
def test_steps(text, months, seconds):
    assert parse_step(text) == Step(months, seconds)


def test_offered_steps():
    assert all(parse_step(text) for text in VECTOR_STEPS + INTRADAY_STEPS)
    assert (INTRADAY_STEPS[0], INTRADAY_STEPS[-1], len(INTRADAY_STEPS)) == ("00:15", "12:00", 48)


@pytest.mark.parametrize("text", ["", None, "0 days", "1 month 1 day", "-1 day", "a day", "day", "1 parsec", "00:00"])
def test_bad_steps(text):
    with pytest.raises(ValueError):
        parse_step(text)


def test_interval_may_mix_units():
    assert parse_interval("1 month 2 days") == (1, 172800)


def instants(axis):
    return [axis.instant(i) for i in range(axis.size)]


def test_axis_includes_its_end():
    axis = Axis.of(datetime(2024, 1, 1), datetime(2024, 1, 3), "1 day")
    assert instants(axis) == [datetime(2024, 1, d) for d in (1, 2, 3)]
    assert axis.stop == datetime(2024, 1, 4)


def test_months_step_from_the_instant_before():
    axis = Axis.of(datetime(1996, 1, 31), datetime(1996, 5, 31), "1 month")
    assert instants(axis) == [datetime(1996, 1, 31)] + [datetime(1996, m, 29) for m in (2, 3, 4, 5)]


def test_end_before_start_is_empty(spark):
    axis = Axis.of(datetime(2024, 1, 2), datetime(2024, 1, 1), "1 month")
    assert axis.size == 0 and axis.frame(spark).count() == 0


def brute_bucket(axis, ts):
    found = [i + 1 for i in range(axis.size) if axis.instant(i) <= ts < axis.instant(i + 1)]
    assert len(found) == 1
    return found[0]


AXES = [
    Axis.of(datetime(2024, 1, 2, 5, 30), datetime(2024, 1, 31), "7 days"),
    Axis.of(datetime(2024, 3, 9, 22), datetime(2024, 3, 11, 2), "00:15"),
    Axis.of(datetime(1996, 1, 31), datetime(1998, 1, 1), "1 month"),
    Axis.of(datetime(1996, 1, 30, 7, 15), datetime(1998, 1, 1), "1 month"),
    Axis.of(datetime(1995, 1, 29, 12), datetime(2001, 1, 1), "3 months"),
    Axis.of(datetime(1996, 1, 15, 6), datetime(1999, 1, 1), "2 months"),
    Axis.of(datetime(1996, 2, 29), datetime(2005, 1, 1), "1 year"),
    Axis(datetime(2024, 1, 1), datetime(2024, 1, 3, 23, 59, 59), Step(seconds=18000), cycle=86400),
    Axis(datetime(2024, 1, 1), datetime(2024, 1, 3, 23, 59, 59), Step(seconds=10800), cycle=86400),
]


@pytest.mark.parametrize("axis", AXES, ids=range(len(AXES)))
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_bucket_of_an_instant_is_its_interval(spark, setting, axis, zone):
    tick = timedelta(microseconds=1)
    span = axis.stop - axis.start
    probes = {axis.start + span * k / 97 for k in range(97)}
    for i in range(axis.size):
        probes |= {axis.instant(i), axis.instant(i) + tick, axis.instant(i + 1) - tick}
    probes = sorted(p for p in probes if axis.start <= p < axis.stop)
    with setting(**{"spark.sql.session.timeZone": zone}):
        frame = spark.createDataFrame([(p,) for p in probes], "ts timestamp_ntz")
        rows = frame.select("ts", axis.bucket(F.col("ts")).alias("x")).collect()
        assert {r.ts: r.x for r in rows} == {p: brute_bucket(axis, p) for p in probes}
        assert [(r.x, r.t) for r in axis.frame(spark).orderBy("x").collect()] == list(enumerate(instants(axis), 1))


def test_cycle_starts_again_every_day():
    axis = AXES[-2]
    assert axis.size == 15
    assert [t.hour for t in instants(axis)] == [0, 5, 10, 15, 20] * 3


@settings(max_examples=200, deadline=None)
@given(st.datetimes(datetime(1950, 1, 1), datetime(2050, 1, 1)), st.integers(1, 14), st.integers(0, 4000))
def test_month_axes_have_no_gaps(start, months, days):
    axis = Axis(start, start + timedelta(days=days), Step(months=months))
    found = instants(axis)
    assert found[0] == start and all(a < b for a, b in zip(found, found[1:]))
    assert all(b == add_months(a, months) for a, b in zip(found, found[1:]))
    assert found[-1] <= axis.end < axis.stop
