from __future__ import annotations

import os
import sys
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
import pytest
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallygrid.session import session  # noqa: E402
from tallygrid.sources.model import Model  # noqa: E402
from tallygrid.sources.schema import SCHEMAS  # noqa: E402

THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


@pytest.fixture(scope="session")
def spark():
    found = session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "3", "spark.default.parallelism": "2", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()


@pytest.fixture
def setting(spark):
    """Set session options for the length of a block."""

    @contextmanager
    def change(**options):
        named = {key.replace("__", "."): value for key, value in options.items()}
        before = {key: spark.conf.get(key, None) for key in named}
        for key, value in named.items():
            spark.conf.set(key, value)
        try:
            yield
        finally:
            for key, value in before.items():
                spark.conf.unset(key) if value is None else spark.conf.set(key, value)

    return change


@pytest.fixture
def nothing_fits(setting):
    """No table counts as small, so every operator takes its way for large ones."""
    with setting(**{THRESHOLD: "-1"}):
        yield


@pytest.fixture
def model_of(spark):
    """A model over rows given as tuples, in the order of the declared columns; tables not given are empty."""

    def build(_extra=None, stored_views=(), day_column=None, **tables) -> Model:
        @cache
        def load(name):
            schema = T.StructType(list(SCHEMAS[name]) + list((_extra or {}).get(name, [])))
            rows = [dict(zip(schema.names, row)) for row in tables.get(name, [])]
            # An Arrow table becomes a local relation, whose size is known, unlike that of a list of rows.
            return spark.createDataFrame(pa.Table.from_pylist(rows, to_arrow_schema(schema)), schema)

        return Model(spark, load, stored_views=stored_views, day_column=day_column)

    return build
