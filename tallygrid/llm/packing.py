"""Sharding by vector bin packing: bytes, tokens and rows of the shards are balanced together.

Rows of equal text are a group, which goes to one shard. Groups are gathered by hash into ``BUNDLES`` bundles, and groups
that hold more than ``1 / (shards * HEAVY)`` of the bytes, tokens or rows are items of their own, cut by id into pieces of
no more than about that size: a group with a third of all rows cannot be in one shard of forty. The items are few whatever
the corpus holds, at most ``BUNDLES`` and six for each ``shards * HEAVY``; one row each, they are packed on the driver:
largest first, each into the shard whose residual capacity has the greatest dot product with the item's sizes. Slots are
offsets of the items and row numbers within one, so no task gets a whole shard.

Defined results: a null text has 16 bytes, no words, a checksum of 0 and is a group with the empty text; rows of equal id
are rows of their own; a null ``doc_id`` is placed like any other; no rows give no rows; other columns of the input play no
part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, split_words

SHARDS = 40
ROW_BYTES = 16
BUNDLES = 8192
HEAVY = 64
MEASURES = ("bytes", "tokens", "rows")


def _measured(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    return {
        "bytes": F.octet_length(text).cast("long") + ROW_BYTES, "tokens": F.size(split_words(text)).cast("long"),
        "crc": F.crc32(text.cast("binary")), "group": F.xxhash64(F.crc32(text.cast("binary")), text)}


def _piece(pieces: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("piece"), "doc_id"), pieces).cast("int")


def _heavy(sizes: DataFrame, shards: int) -> DataFrame:
    """``(group, pieces)`` of groups above the limit; at most three for each ``shards * HEAVY``."""
    groups = sizes.groupBy("group").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    groups = checkpointed(groups)
    whole = groups.agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES]).first()
    parts = [F.col(m) * (shards * HEAVY) / F.lit(max(1, int(whole[m]))) for m in MEASURES]
    return groups.withColumn("share", F.greatest(*parts)).filter("share > 1").filter("rows > 1").select(
        "group", F.ceil("share").cast("long").alias("pieces"))


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item, given their sizes, a row of numbers each.

    Sizes and capacities are in shares of the mean shard. An item goes where the dot product of its sizes and the residual
    capacity is highest; of equal shards the first is taken.
    """
    totals = np.maximum(items.sum(axis=0), 1)
    sizes = items * shards / totals
    left = np.ones((shards, items.shape[1]))
    order = np.lexsort((np.arange(len(items)), -sizes.max(axis=1)))
    placed = np.zeros(len(items), np.int64)
    for item in order:
        shard = int(np.argmax(left @ sizes[item]))
        placed[item] = shard
        left[shard] -= sizes[item]
    return placed


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``(row, doc_id, bytes, tokens, crc, shard, slot)``: ``row`` holds the columns of the input; ``slot`` counts the rows
    of a shard from 0."""
    measured = docs.select(F.struct("*").alias("row"), "doc_id", "text").select(
        "row", "doc_id", *[value.alias(name) for name, value in _measured(F.col("text")).items()])
    sizes = checkpointed(measured.drop("row"))
    heavy = F.broadcast(_heavy(sizes, shards))
    ends = F.when(F.col("pieces").isNotNull(), F.xxhash64("group", _piece(F.col("pieces")))).otherwise(
        F.pmod("group", F.lit(BUNDLES)))

    def in_items(frame):
        return frame.join(heavy, "group", "left").withColumn(
            "own", F.col("pieces").isNotNull()).withColumn("item", ends).drop("pieces")

    items = in_items(sizes).groupBy("own", "item").agg(
        F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    rows = items.orderBy("own", "item").collect()
    matrix = np.array([[r[m] for m in MEASURES] for r in rows], dtype=np.float64).reshape(-1, len(MEASURES))
    filled, places = [0] * shards, []
    for row, at in zip(rows, pack(matrix, shards).tolist()):
        places.append((row["own"], row["item"], at, filled[at]))
        filled[at] += row["rows"]
    placed = F.broadcast(docs.sparkSession.createDataFrame(places, "own boolean, item bigint, shard int, offset bigint"))
    numbered = Window.partitionBy("own", "item").orderBy("doc_id", "crc", "bytes")
    return in_items(measured).join(placed, ["own", "item"]).withColumn(
        "slot", F.col("offset") + F.row_number().over(numbered) - 1).select(
        "row", "doc_id", "bytes", "tokens", "crc", "shard", "slot")


def digest(docs: DataFrame) -> DataFrame:
    return shard(docs.select("doc_id", "text")).select(
        "doc_id", F.col("bytes").alias("size"), F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def placed(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``(doc_id, source, size, tokens, shard, slot)`` of documents."""
    return shard(docs.select("doc_id", "source", "text"), shards).select(
        "doc_id", "row.source", F.col("bytes").alias("size"), "tokens", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """One folder ``shard_number=…`` for each shard, whose rows are in order of their slots within each file. Columns of
    the input that have the names of the places give way to them."""
    names = [c for c in docs.columns if c.lower() not in ("shard_number", "shard_slot")]
    rows = shard(docs, shards).select(
        *[F.col("row").getField(c).alias(c) for c in names], F.col("shard").alias("shard_number"), F.col("slot").alias("shard_slot"))
    rows.repartition("shard_number", F.pmod("shard_slot", F.lit(8))).sortWithinPartitions(
        "shard_number", "shard_slot").write.partitionBy("shard_number").parquet(path)
