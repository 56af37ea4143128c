from datetime import date, datetime

import pytest

from tallygrid.functions import periods

NOW = datetime(2024, 3, 31, 15, 20)


def test_instants():
    assert periods.instant("2024-01-02") == datetime(2024, 1, 2)
    assert periods.instant("2024-01-02T03:04:05Z") == datetime(2024, 1, 2, 3, 4, 5)
    assert periods.instant("2024-01-02T00:00:00-03:00") == datetime(2024, 1, 2, 3)
    assert periods.instant(date(2024, 1, 2)) == datetime(2024, 1, 2)
    with pytest.raises(ValueError):
        periods.instant("tomorrow")


def test_bounds():
    assert periods.month_bounds("2024-02") == (datetime(2024, 2, 1), datetime(2024, 2, 29, 23, 59, 59))
    assert periods.year_bounds("2023") == (datetime(2023, 1, 1), datetime(2023, 12, 31, 23, 59, 59))
    assert periods.day_bounds("2024-05-06T07:08") == (datetime(2024, 5, 6), datetime(2024, 5, 6, 23, 59, 59))
    with pytest.raises(ValueError):
        periods.month_bounds("2024-13")


def test_defaults():
    assert periods.default_period("grid", NOW) == (datetime(2024, 3, 24), datetime(2024, 3, 30, 23, 59, 59))
    assert periods.default_period("day", NOW) == (datetime(2024, 3, 31), datetime(2024, 3, 31, 23, 59, 59))
    assert periods.default_period("year", NOW)[0] == datetime(2024, 1, 1)
    assert periods.default_period("vector", NOW) == (datetime(2024, 2, 29), NOW)
    assert periods.default_period("forecast", NOW) == (datetime(2024, 2, 29), datetime(2024, 4, 14, 15, 20))
    with pytest.raises(ValueError):
        periods.default_period("week", NOW)


def test_given_bounds_replace_defaults():
    assert periods.vector_bounds(None, "2024-03-05", "vector", NOW) == (datetime(2024, 2, 29), datetime(2024, 3, 5))
    assert periods.vector_bounds("2024-03-05", None, "forecast", NOW)[1] == datetime(2024, 4, 14, 15, 20)
