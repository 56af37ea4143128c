"""Connected components of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def labelled(links: DataFrame) -> DataFrame:
    """``(node, label)`` of every node of the links ``(a, b)``; the label is the smallest node of the component.

    Two star steps take turns, each of which keeps the components. The large step hangs a node's larger neighbours below
    the smallest of node and neighbours; the small step does so with the node itself and its smaller neighbours. When a
    round changes nothing, every node hangs on the smallest of its component. A node's neighbours are never gathered:
    their minimum is a partial aggregate, and the join with it is split where it is skewed.
    """
    links = checkpointed(links.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        links = checkpointed(_small(_large(links)))
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    ends = links.select("u", "v")
    return ends.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        ends.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _large(links: DataFrame) -> DataFrame:
    both = links.select(F.col("u").alias("x"), F.col("v").alias("y")).union(
        links.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    # A node's larger neighbours are the upper ends of links whose lower end it is.
    return links.withColumnRenamed("v", "x").join(least, "x").select("u", F.col("m").alias("v")).filter(
        "u <> v").distinct()


def _small(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    own = least.select("u", F.col("m").alias("v"))
    moved = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.union(moved).distinct()
