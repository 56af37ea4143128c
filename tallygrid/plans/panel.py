"""Configured panels: chosen pairs of network and variable by month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.axis import Axis
from ..functions.labels import hour_label
from ..functions.periods import vector_bounds
from ..operators.hits import hits, point_members
from ..operators.tally import cells, count_members, fill_rows
from ..sources.model import Model

Pair = tuple[int, int, str]


def _pairs(model: Model, pairs: Sequence[Pair]) -> DataFrame:
    """(y, red_id, var_id, label) of the configured pairs, in their order."""
    items = [F.struct(F.lit(i).cast("bigint").alias("y"), F.lit(network).cast("bigint").alias("red_id"),
                      F.lit(variable).cast("bigint").alias("var_id"), F.lit(label).alias("label"))
             for i, (network, variable, label) in enumerate(pairs)]
    return model.spark.range(0, 1, 1, 1).select(F.inline(F.array(*items)))


def panel(model: Model, pairs: Sequence[Pair], start=None, end=None, dt="1 month", now=None) -> DataFrame:
    """(x, y, t, red_id, var_id, label, n, hour): the observations of each pair by month."""
    start, end = vector_bounds(start, end, "vector", now)
    axis = Axis.of(start, end, dt)
    series = model.table("series").where(F.col("var_id").isin(sorted({variable for _, variable, _ in pairs})))
    wanted = F.broadcast(_pairs(model, pairs).select("red_id", "var_id").distinct())
    chosen = point_members(series, model, {}).join(wanted, ["red_id", "var_id"], "left_semi")
    facts = hits(model, "observaciones", axis, axis.start, min(end, axis.stop))
    key = ["red_id", "var_id"]
    counts = count_members(facts, chosen.select("series_id", *key), key, series)
    rows = fill_rows(_pairs(model, pairs), counts, key, axis)
    return cells(rows, axis, *key, "label").withColumn("hour", hour_label(F.col("t")))
