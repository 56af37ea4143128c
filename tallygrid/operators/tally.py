"""Counting shared by vectors, matrices and grids: facts to buckets, buckets to zero-filled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.axis import ROWS_PER_TASK, Axis
from ..functions.sizing import fits

# Ranges that a large frame is cut into to number it.
RANGES = 255


def where(frame: DataFrame, condition: Column | None) -> DataFrame:
    return frame if condition is None else frame.where(condition)


def count_members(facts: DataFrame, members: DataFrame, keys: list[str], bound: DataFrame) -> DataFrame:
    """(keys…, x, n): facts ``(series_id, x)``, or ``(series_id, x, n)`` counted in part before, counted by attributes of
    their series.

    ``members`` holds one row or more for each series and ``bound`` limits its rows. Members of proven small size, by
    the size of what bounds them, are broadcast, so that facts are dropped and counted in the scan stage. Otherwise the
    facts shrink first to one row for each series and bucket, combined before the shuffle, so that neither a busy series
    nor the fact table is ever moved for the join; where a filter leaves few series of a large table, Spark's run-time
    Bloom filter of their ids drops the facts of others in the scan stage. Nothing is counted while the plan is made.
    """
    many = F.sum("n") if "n" in facts.columns else F.count(F.lit(1))
    if fits(bound):
        joined = facts.join(F.broadcast(members), "series_id")
        return joined.groupBy(*keys, "x").agg(many.alias("n"))
    reduced = facts.groupBy("series_id", "x").agg(many.alias("n"))
    return reduced.join(members, "series_id").groupBy(*keys, "x").agg(F.sum("n").alias("n"))


def vector(spark: SparkSession, axis: Axis, counts: DataFrame) -> DataFrame:
    """(x, t, n) in order of x: counts ``(x, n)`` laid on the axis, 0 where there are none."""
    frame = axis.frame(spark)
    small = axis.size < ROWS_PER_TASK
    # There is at most one count for each bucket, so the axis bounds the broadcast.
    filled = frame.join(F.broadcast(counts) if small else counts, "x", "left").select(
        "x", "t", F.coalesce("n", F.lit(0)).alias("n"))
    # A short axis is one partition.
    return filled.sortWithinPartitions("x") if small else filled.orderBy("x")


def zero_filled(hits: Column, size: int) -> Column:
    """An array of ``size`` counts from an array of ``(x, n)`` sorted by x; a null array gives zeros."""
    zero = F.lit(0).cast("bigint")

    def with_gap(hit: Column, i: Column) -> Column:
        before = F.coalesce(F.get(hits, i - 1)["x"], F.lit(0))
        gap = (hit["x"] - before - 1).cast("int")
        return F.concat(F.array_repeat(zero, gap), F.array(hit["n"]))

    tail = F.lit(size) - F.element_at(hits, -1)["x"].cast("int")
    filled = F.concat(F.flatten(F.transform(hits, with_gap)), F.array_repeat(zero, tail))
    return F.when(hits.isNull(), F.array_repeat(zero, size)).otherwise(filled)


def fill_rows(entities: DataFrame, counts: DataFrame, key: list[str], axis: Axis) -> DataFrame:
    """The entities with ``values``, their counts along the axis; counts are ``(key…, x, n)``.

    A list holds at most one element for each bucket of the axis. Entities are joined once each, not once per cell.
    """
    lists = counts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("x", "n"))).alias("hits"))
    return entities.join(lists, key, "left").withColumn("values", zero_filled(F.col("hits"), axis.size)).drop("hits")


def cells(rows: DataFrame, axis: Axis, *columns: str) -> DataFrame:
    """(x, y, t, columns…, n), one row for each entity and bucket, with x and y from 0."""
    opened = rows.select("y", *columns, F.posexplode("values").alias("pos", "n"))
    x = F.col("pos").cast("bigint")
    return opened.select(x.alias("x"), "y", axis.at(x + 1).alias("t"), *columns, "n")


def numbered(frame: DataFrame, keys: list[Column], bound: DataFrame) -> DataFrame:
    """The frame with ``y``, its 0-based position in the order of the keys, nulls last, which no two rows share. ``bound``
    limits its rows.

    A frame of proven small size is numbered by one window. A larger one is cut into ranges between the keys of a sketch,
    those ``RANGES`` of the least hashes, which are as good as drawn at random; sizes of the ranges, a row each, turn
    positions within them into overall ones. All is one plan, so nothing runs before it is asked for. Sketch, sizes and
    rows come from one exchange of whole rows: their columns are kept in one, for the three to have the same.
    """
    if fits(bound):
        order = Window.orderBy(*[key.asc_nulls_last() for key in keys])
        return frame.withColumn("y", F.row_number().over(order).cast("bigint") - 1)
    key = F.struct(*[c for i, k in enumerate(keys) for c in (k.isNull().alias(f"no_{i}"), k.alias(f"key_{i}"))])
    packed = frame.select(F.array(F.struct(key.alias("key"), F.struct("*").alias("row"))).alias("item"))

    def part(name: str) -> Column:
        # Not a plain access, which the optimizer would carry out below the exchange.
        return F.get(F.transform("item", lambda item: item[name]), F.lit(0))

    dealt = packed.repartition(F.xxhash64(part("key")))
    drawn = dealt.select(part("key").alias("key")).orderBy(F.xxhash64("key")).limit(RANGES)
    sketch = drawn.agg(F.array_sort(F.collect_list("key")).alias("keys"))
    ranged = dealt.withColumn("key", part("key")).withColumn("drawn", sketch.scalar())
    # Never null, so that the join adds no condition.
    at = F.coalesce(F.size(F.filter("drawn", lambda drawn_key: drawn_key <= F.col("key"))), F.lit(0))
    ranged = ranged.withColumn("range", at).drop("drawn")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("size")).select(
        "range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("range").orderBy("key")).cast("bigint") - 1
    placed = ranged.join(F.broadcast(offsets), "range").select(part("row").alias("row"), (F.col("before") + within).alias("y"))
    return placed.select("row.*", "y")


def maximum(rows: DataFrame) -> DataFrame:
    """(max): the largest count of cells or vectors, 0 without any."""
    return rows.agg(F.coalesce(F.max("n"), F.lit(0)).alias("max"))
