"""Observations counted by series and day, and the stations seen each day, kept as tables.

Both are parts of one set (``versions.py``), a part holding some days of one month. Days are appended as they close; days
counted again replace their part. A request takes the days that are stored, lie wholly within its range and have no edge of
a bucket inside from the tables, and all else, as the cut-off days at its ends, from the observations: the answer is the same.

Stations of a day are bitmaps of their ids, one for each network, variable, procedure, unit and 32,768 ids. Bitmaps of days
or networks are joined by OR, so the distinct stations of any coarser step or union come from one table by day, which counts
cannot give.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime, time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.axis import add_months
from ..operators.hits import STATIONS, Span, point_members, stations_seen
from ..sources.model import Model
from ..sources.schema import KINDS
from .versions import Versions

COUNTS_SCHEMA = "series_id bigint, day date, n bigint"
SEEN_SCHEMA = "day date, tabla_id string, var_id bigint, proc_id bigint, unit_id bigint, slot bigint, seen binary"


def months_of(first: date, after: date) -> list[Span]:
    """The days from first up to after, cut by month."""
    found = []
    while first < after:
        end = min(add_months(datetime.combine(first.replace(day=1), time()), 1).date(), after)
        found.append((first, end))
        first = end
    return found


class DayTallies:
    """The stored tallies in a directory."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.versions = spark, Versions(spark, directory)

    def _parts(self, table: str) -> dict[Span, str]:
        found = {}
        for name, path in self.versions.parts().items():
            of, _, days = name.partition("/")
            if of == table:
                found[tuple(date.fromisoformat(day) for day in days.split("_"))] = path
        return found

    def spans(self, table: str) -> list[Span]:
        """The days stored of a table of observations, or of ``STATIONS``."""
        return sorted(self._parts(table))

    def counts(self, table: str, spans: Iterable[Span]) -> DataFrame:
        """(series_id, day, n) of the days of some spans."""
        return self._days(table, list(spans), COUNTS_SCHEMA)

    def stations(self, spans: Iterable[Span]) -> DataFrame:
        """(day, tabla_id, var_id, proc_id, unit_id, slot, seen) of the days of some spans."""
        return self._days(STATIONS, list(spans), SEEN_SCHEMA)

    def _days(self, table: str, spans: list[Span], schema: str) -> DataFrame:
        paths = [path for (first, after), path in self._parts(table).items() if any(a < after and first < b for a, b in spans)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        inside = [(F.col("day") >= F.lit(first)) & (F.col("day") < F.lit(after)) for first, after in spans]
        return self.spark.read.schema(schema).parquet(*paths).where(reduce(lambda a, b: a | b, inside))

    def append(self, model: Model, first: date, after: date, kinds: Iterable[str] = tuple(KINDS)) -> None:
        """Count the days from first up to after as ``model`` has them now; other stored days stay as they are. They must meet
        the stored days of their month, so that a part has no gap. Point observations give the stations as well."""
        number, changed = self.versions.number(), {}
        low, high = (datetime.combine(day, time()) for day in (first, after))
        for kind in (KINDS[tipo] for tipo in kinds):
            facts = model.between(kind.observations, low, high)
            counted = facts.groupBy("series_id", F.to_date("timestart").alias("day")).agg(F.count(F.lit(1)).alias("n"))
            changed |= self._merged(kind.observations, counted, first, after, ["day", "series_id"], COUNTS_SCHEMA)
            if kind.tipo == "puntual":
                members = point_members(model.table("series"), model, {}).select(
                    "series_id", "estacion_id", "tabla_id", "var_id", "proc_id", "unit_id")
                changed |= self._merged(STATIONS, stations_seen(counted.join(members, "series_id"), "day"), first, after, ["day"], SEEN_SCHEMA)
        self.versions.publish(changed, number)

    def _merged(self, table: str, rows: DataFrame, first: date, after: date, order: list[str], schema: str) -> dict:
        """Parts with the rows of the days from first up to after, and what is stored of other days of their months."""
        known, changed, kept, spans = self._parts(table), {}, [], []
        for low, high in months_of(first, after):
            month = [(a, b) for a, b in known if (a.year, a.month) == (low.year, low.month)]
            if any(b < low or high < a for a, b in month):
                raise ValueError(f"days of {table} between those stored and {low} to {high} are missing")
            changed |= {f"{table}/{a}_{b}": None for a, b in month}
            kept += [span for a, b in month for span in ((a, min(b, low)), (max(a, high), b)) if span[0] < span[1]]
            spans.append((min([low, *[a for a, _ in month]]), max([high, *[b for _, b in month]])))
        columns = [column.split()[0] for column in schema.split(", ")]
        rows = rows.select(*columns)
        if kept:
            rows = rows.unionByName(self._days(table, kept, schema))
        part = reduce(lambda other, span: F.when(
            (F.col("day") >= F.lit(span[0])) & (F.col("day") < F.lit(span[1])), F.lit(f"{span[0]}_{span[1]}")).otherwise(other),
            spans, F.lit(None).cast("string"))
        folder = self.versions.folder()
        rows.withColumn("part", part).repartition("part", "day").sortWithinPartitions("part", *order).write.partitionBy(
            "part").parquet(f"{self.versions.directory}/{folder}")
        written = {name.removeprefix("part="): f"{folder}/{name}" for name in self.versions.partitions(folder)}
        # Days without any row are stored as well: as a folder without files.
        return changed | {f"{table}/{a}_{b}": written.get(f"{a}_{b}") or self._empty(folder, schema) for a, b in spans}

    def _empty(self, folder: str, schema: str) -> str:
        place = f"{folder}/none"
        self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.versions.directory}/{place}")
        return place

    def model(self, model: Model) -> Model:
        """The model with these tallies."""
        found = Model(self.spark, model._load, model.stored_views, model.day_column, model.zone)
        found.tallies = self
        return found
