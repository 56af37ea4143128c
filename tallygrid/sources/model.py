"""A model hands out the logical tables of one source."""

from __future__ import annotations

from collections.abc import Callable, Collection
from datetime import datetime, timedelta
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.axis import ntz
from .schema import OPTIONAL, QUALIFIER, SCHEMAS


# More than two time zones can differ by.
ZONES_APART = timedelta(days=2)


def wall_clock(zoned: Column, zone: str) -> Column:
    """The zone-less time that clocks of a zone show at an instant; the session's zone plays no part."""
    seconds = (F.unix_micros(zoned) / F.lit(1_000_000).cast("decimal(18,0)")).cast("decimal(18,6)")
    zero = F.lit(0)
    utc = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, seconds)
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


class Model:
    """Logical tables by name.

    ``load`` returns the stored frame of a table. ``stored_views`` names the coverage views that the source stores; the
    others are computed. ``day_column`` names a date column by which the fact tables are partitioned, so that ranges
    also prune partitions. Columns stored with a time zone become the wall-clock time of ``zone``, whatever the session's.
    """

    def __init__(self, spark: SparkSession, load: Callable[[str], DataFrame],
                 stored_views: Collection[str] = (), day_column: str | None = None, zone: str = "UTC"):
        self.spark = spark
        self.zone = zone
        self._load = load
        self.stored_views = frozenset(stored_views)
        self.day_column = day_column
        # Observations counted by day (``plans/tallies.py``), where they are kept.
        self.tallies = None

    def table(self, name: str) -> DataFrame:
        """The declared columns, in the declared types."""
        return self._declared(name, self._load(name))

    def _declared(self, name: str, frame: DataFrame) -> DataFrame:
        types = dict(frame.dtypes)
        declared = {field.name: field.dataType for field in SCHEMAS[name]}
        if {c: t.simpleString() for c, t in declared.items()} == types:
            return frame
        columns = []
        for column, kind in declared.items():
            if column not in types and column in OPTIONAL:
                columns.append(F.lit(None).cast(kind).alias(column))
            elif types.get(column) == "timestamp" and kind.simpleString() == "timestamp_ntz":
                columns.append(wall_clock(F.col(column), self.zone).alias(column))
            else:
                columns.append(F.col(column).cast(kind).alias(column))
        extra = [c for c in (self.day_column, QUALIFIER) if c in types and c not in declared]
        return frame.select(*columns, *extra)

    def between(self, name: str, low: datetime, high: datetime, closed: bool = False,
                column: str = "timestart") -> DataFrame:
        """Fact rows in ``[low, high)``, or in ``[low, high]`` when closed."""
        facts, time = self._load(name), F.col(column)
        if dict(facts.dtypes)[column] == "timestamp":
            # A range on the converted column would not reach the scan; a wider one on the stored column does.
            first, last = (ntz(t).cast("timestamp") for t in (low - ZONES_APART, high + ZONES_APART))
            facts = facts.where((time >= first) & (time <= last))
        facts = self._declared(name, facts)
        facts = facts.where((time >= ntz(low)) & ((time <= ntz(high)) if closed else (time < ntz(high))))
        if self.day_column and self.day_column in facts.columns:
            facts = facts.where(F.col(self.day_column).between(F.lit(low.date()), F.lit(high.date())))
        return facts


def parquet_model(spark: SparkSession, directory: str, **options) -> Model:
    """Tables stored as parquet, one folder or file for each under its own name. Each is listed once for the model's life;
    a new model sees files added since."""
    return Model(spark, cache(lambda name: spark.read.parquet(f"{directory}/{name}")), **options)


def catalog_model(spark: SparkSession, database: str, **options) -> Model:
    """Tables of a database in the session catalog."""
    return Model(spark, cache(lambda name: spark.table(f"`{database}`.`{name}`")), **options)


def jdbc_model(spark: SparkSession, url: str, properties: dict[str, str] | None = None,
               splits: dict[str, dict[str, str]] | None = None, **options) -> Model:
    """Tables of a relational database. ``splits`` gives the partitioned-read options of the big tables
    (``partitionColumn``, ``lowerBound``, ``upperBound``, ``numPartitions``); filters are pushed to the database."""
    properties = {"preferTimestampNTZ": "true", **(properties or {})}

    def load(name: str) -> DataFrame:
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
        return reader.options(**{**properties, **(splits or {}).get(name, {})}).load()

    return Model(spark, load, **options)
