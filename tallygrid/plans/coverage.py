"""Forecast coverage kept as tables and kept up by run, so that requests do not aggregate all forecasts again.

Coverage lies in buckets of ``cor_id``, the newest run of each calibration in a table of its own; both are parts of one set
(``versions.py``). A refresh counts the forecasts of the given runs only, writes the buckets that hold them anew, and lets them
take effect together with the newest runs.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from ..functions.sizing import broadcast_if
from ..operators.forecasts import COVERAGE, LAST_COVERAGE, coverage
from ..sources.model import Model
from ..sources.schema import SCHEMAS
from .versions import Versions

BUCKETS = 64
NEWEST = "newest"
NEWEST_SCHEMA = T.StructType([
    field for field in SCHEMAS[LAST_COVERAGE] if field.name in ("cor_id", "cal_id", "cal_grupo_id", "forecast_date")])


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("cor_id"), F.lit(buckets)).cast("int")


def _name(buckets: int, bucket: int) -> str:
    return f"bucket={bucket}of{buckets}"


def _newest(model: Model, runs: DataFrame) -> DataFrame:
    """(cor_id, cal_id, cal_grupo_id, forecast_date): the newest of the given rows of ``corridas`` for each calibration."""
    newest = runs.groupBy("cal_id").agg(F.max(F.struct("date", "id")).alias("run"))
    groups = model.table("calibrados").select(F.col("id").alias("cal_id"), F.col("grupo_id").alias("cal_grupo_id"))
    return newest.join(groups, "cal_id").select(
        F.col("run.id").alias("cor_id"), "cal_id", "cal_grupo_id", F.col("run.date").alias("forecast_date"))


class CoverageStore:
    """The stored coverage in a directory."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.versions = spark, Versions(spark, directory)

    def buckets(self) -> int:
        """How many there are, by the names of the parts."""
        return next(int(name.split("of")[1]) for name in self.versions.parts() if name != NEWEST)

    def coverage(self, buckets: Collection[int] | None = None) -> DataFrame:
        """The coverage of all runs, or of those of some buckets."""
        found = self.versions.parts()
        wanted = [path for name, path in found.items()
                  if name != NEWEST and (buckets is None or int(name.split("=")[1].split("of")[0]) in buckets)]
        return self._read(wanted, SCHEMAS[COVERAGE])

    def newest(self) -> DataFrame:
        path = self.versions.parts().get(NEWEST)
        return self._read([path] if path else [], NEWEST_SCHEMA)

    def last_coverage(self) -> DataFrame:
        """The coverage of the newest run of each calibration."""
        return self.coverage().join(broadcast_if(self.newest(), self.newest()), "cor_id").select(*SCHEMAS[LAST_COVERAGE].names)

    def _read(self, paths: list[str], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, model: Model, buckets: int = BUCKETS) -> None:
        """The coverage of all forecasts and the newest runs, instead of what is stored."""
        after = self.versions.number()
        parts = self._written(coverage(model), buckets)
        parts |= {_name(buckets, i): parts.get(_name(buckets, i)) for i in range(buckets)}
        parts[NEWEST] = self._written_newest(_newest(model, model.table("corridas")))
        self.versions.publish(parts, after, replace=True)

    def refresh(self, model: Model, runs: DataFrame) -> list[int]:
        """Take over the forecasts of the given runs, a frame with ``cor_id``, as ``model`` has them now; runs that it no longer
        has go. Returns the buckets written anew."""
        after, buckets = self.versions.number(), self.buckets()
        # Computed once: the executors keep it until all that asks for it is written.
        listed = runs.select("cor_id").distinct().persist(StorageLevel.MEMORY_AND_DISK)
        try:
            # At most a row for each bucket.
            touched = sorted(row[0] for row in listed.select(_bucket(buckets)).distinct().collect())
            # Its size is known now.
            changed = broadcast_if(listed, listed)
            kept = self.coverage(touched).join(changed, "cor_id", "left_anti")
            parts = self._written(coverage(model, runs=changed).unionByName(kept), buckets)
            changes = {_name(buckets, i): parts.get(_name(buckets, i)) for i in touched}
            changes[NEWEST] = self._written_newest(self._newest_after(model, changed))
        finally:
            listed.unpersist()
        self.versions.publish(changes, after)
        return touched

    def _newest_after(self, model: Model, changed: DataFrame) -> DataFrame:
        """The newest runs after the given ones have changed. A stored maximum stays unless its own run has changed: then all
        runs of its calibration are looked at, of others only the changed ones."""
        stored, runs = self.newest(), model.table("corridas").withColumnRenamed("id", "cor_id")
        open_ = stored.join(changed, "cor_id", "left_semi").select("cal_id")
        again = runs.join(broadcast_if(open_, stored), "cal_id", "left_semi")
        fresh = runs.join(changed, "cor_id", "left_semi")
        whole = again.unionByName(fresh).distinct().select(F.col("cor_id").alias("id"), "cal_id", "date")
        found = _newest(model, whole).unionByName(stored.join(changed, "cor_id", "left_anti"))
        # Two rows at most for a calibration: the stored one and the best of the changed.
        best = Window.partitionBy("cal_id").orderBy(F.desc("forecast_date"), F.desc("cor_id"))
        return found.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")

    def _written(self, rows: DataFrame, buckets: int) -> dict[str, str]:
        """The place of each bucket that has rows."""
        folder = self.versions.folder()
        bucket = F.concat(_bucket(buckets).cast("string"), F.lit(f"of{buckets}"))
        # Not a task for each bucket, however large: adaptive execution joins small pieces and cuts large ones.
        pieces = -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // buckets)
        piece = F.pmod(F.xxhash64("series_table", "cor_id", "series_id"), F.lit(pieces))
        placed = rows.withColumns({"bucket": bucket, "piece": piece}).hint("rebalance", "bucket", "piece").drop("piece")
        placed.sortWithinPartitions("bucket", "series_table", "cor_id", "series_id").write.partitionBy("bucket").parquet(
            f"{self.versions.directory}/{folder}")
        return {name: f"{folder}/{name}" for name in self.versions.partitions(folder)}

    def _written_newest(self, rows: DataFrame) -> str:
        folder = self.versions.folder()
        rows.select(*NEWEST_SCHEMA.names).write.parquet(f"{self.versions.directory}/{folder}")
        return folder

    def model(self, model: Model) -> Model:
        """The model with both views of forecast coverage read from here."""
        views = {COVERAGE: self.coverage, LAST_COVERAGE: self.last_coverage}
        return Model(
            self.spark, lambda name: views[name]() if name in views else model._load(name), stored_views=tuple(views),
            day_column=model.day_column, zone=model.zone)


def write_coverage(model: Model, directory: str) -> None:
    """The coverage of all forecasts as parquet, one folder for each series table.

    A model whose source has it under ``series_prono_date_range`` names this in ``stored_views``.
    """
    _written(coverage(model), directory)


def refresh_coverage(model: Model, stored: DataFrame, runs: DataFrame, directory: str) -> None:
    """A coverage with the given runs, a frame with ``cor_id``, counted anew from ``model``; that of other runs is taken
    over from ``stored``. It goes to another folder than that of ``stored``, so readers of the old one are not disturbed and
    a failed refresh leaves it whole. It rewrites all; a ``CoverageStore`` only what has changed."""
    changed = broadcast_if(runs.select("cor_id").distinct(), runs)
    kept = stored.join(changed, "cor_id", "left_anti")
    _written(coverage(model, runs=changed).unionByName(kept), directory)


def _written(rows: DataFrame, directory: str) -> None:
    placed = rows.repartition("series_table", F.pmod(F.xxhash64("cor_id"), F.lit(16)))
    placed.sortWithinPartitions("series_table", "cor_id", "series_id").write.mode("errorifexists").partitionBy(
        "series_table").parquet(directory)
