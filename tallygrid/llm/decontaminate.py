"""Benchmark decontamination: windows of benchmark words, held as a hash table by every task, are looked up at each word
of each document.

The table is a constant of nested arrays addressed by the window's hash, which Spark broadcasts with the tasks' code. An
entry found by its 64-bit hash is verified by a digest of its words. A table holds ``TABLE_ENTRIES`` pairs of window and
item, on average; a larger benchmark is cut by window hash into blocks, which are looked up one after another in the same
pass, and the hits so far are checkpointed after each ``BLOCKS_AT_ONCE`` of them. Documents are not shuffled, whatever
they hold.

Defined results: null and empty texts have no words, no hits and the digest of no items; a null ``item_id`` stands as
empty text; repeated rows are judged one by one, and items of equal id count once; an empty benchmark hits nothing; other
columns of either input play no part. Texts have no length limit.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_WORD, checkpointed, covered, kept_rows, lower_ascii, split_words, with_window_hashes

WINDOW = 10
TABLE_ENTRIES = 50_000
SLOTS_PER_ENTRY = 6
BLOCKS_AT_ONCE = 8
ENTRY = ("length", "hash", "digest", "items")
ENTRY_TYPE = "length:int,hash:bigint,digest:string,items:array<string>"
HITS = "array<struct<first:int,after:int,items:array<string>>>"


def words_of(text: Column) -> Column:
    return split_words(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD)


def _hashes(words: Column | str) -> Column:
    return F.transform(words, lambda word: F.xxhash64(word))


def _digest(words: Column) -> Column:
    return F.md5(F.array_join(words, " "))


def _columns(lengths) -> dict[int, str]:
    return {length: f"_rolled_{length}" for length in lengths}


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(length, hash, digest, items)``: each window once, with the ids of the items that hold it. An item shorter than
    the window is one window."""
    step = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words"))
    step = step.filter(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(window)))
    step = with_window_hashes(step.withColumn("_hashes", _hashes("words")), "_hashes", _columns(range(1, window + 1)))
    rolled = F.coalesce(*[F.when(F.col("length") == n, F.col(c)) for n, c in _columns(range(1, window + 1)).items()])
    step = step.select("item", "words", "length", F.posexplode(rolled).alias("first", "hash"))
    digest = _digest(F.slice("words", F.col("first") + 1, F.col("length")))
    return step.groupBy("length", "hash", digest.alias("digest")).agg(F.collect_set("item").alias("items"))


def _slot(hash_: Column, size: int) -> Column:
    # Not the lower bits, which choose the block.
    return F.pmod(F.shiftrightunsigned(hash_, 20), F.lit(size)).cast("int")


def _table(windows: DataFrame, size: int) -> Column:
    """A hash table in one constant: element ``_slot(hash)`` is the array of the entries there, or null."""
    slots: list[list | None] = [None] * size
    for row in windows.select(_slot(F.col("hash"), size).alias("slot"), *ENTRY).collect():
        slots[row["slot"]] = [*(slots[row["slot"]] or []), {name: row[name] for name in ENTRY}]
    return F.from_json(F.lit(json.dumps({"slots": slots})), f"slots array<array<struct<{ENTRY_TYPE}>>>")["slots"]


def _lookup(table: Column, size: int, length: int) -> Column:
    """The verified hits of windows of one length."""

    def at(h):
        return F.get(table, _slot(h, size))

    def probe(h, i):
        return F.when(F.exists(at(h), lambda e: e["hash"] == h), F.struct(i.alias("i"), h.alias("h")))

    def verify(p):
        digest = _digest(F.slice(F.col("words"), p["i"] + 1, length))
        right = F.filter(at(p["h"]), lambda e: (e["length"] == length) & (e["digest"] == digest))
        return F.when(F.size(right) > 0, F.struct(
            p["i"].alias("first"), (p["i"] + length).alias("after"), F.get(right, F.lit(0))["items"].alias("items")))

    near = F.filter(F.transform(F.col(_columns([length])[length]), probe), lambda p: p.isNotNull())
    # The words are named outside the function too: the optimizer then leaves their making where it is.
    hits = F.filter(F.transform(near, verify), lambda hit: hit.isNotNull())
    return F.when(F.size("words") >= length, hits).otherwise(F.array().cast(HITS))


def with_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, entries: int = TABLE_ENTRIES) -> DataFrame:
    """``(row, words, hits)``: ``row`` holds the columns of the input, ``hits`` are structs of ``first`` and ``after``,
    positions of words, and ``items``."""
    windows = windows_of(benchmark, window)
    # At most ``window`` rows.
    lengths = {r["length"]: r["n"] for r in windows.groupBy("length").agg(F.sum(F.size("items")).alias("n")).collect()}
    blocks = -(-sum(lengths.values()) // entries)
    size = SLOTS_PER_ENTRY * -(-sum(lengths.values()) // max(blocks, 1)) + 1
    step = docs.select(F.struct("*").alias("row"), words_of(F.col("text")).alias("words"))
    step = with_window_hashes(step.withColumn("_hashes", _hashes("words")), "_hashes", _columns(lengths))
    hits = [F.array().cast(HITS)]
    for block in range(blocks):
        if block and block % BLOCKS_AT_ONCE == 0:
            step = checkpointed(step.withColumn("_hits", F.concat(*hits)))
            hits = [F.col("_hits")]
        table = _table(windows.filter(F.pmod(F.col("hash"), F.lit(blocks)) == block), size)
        hits += [_lookup(table, size, length) for length in sorted(lengths)]
    return step.select("row", "words", F.concat(*hits).alias("hits"))


def judge(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``with_hits`` and ``n_words``, ``n_hit``, ``items``, ``contaminated``."""
    step = with_hits(docs, benchmark, **options)
    spans = F.transform("hits", lambda hit: F.struct(hit["first"].alias("first"), hit["after"].alias("after")))
    step = step.withColumns({
        "n_words": F.size("words").cast("long"), "n_hit": covered(spans),
        "items": F.sort_array(F.array_distinct(F.flatten(F.transform("hits", lambda hit: hit["items"]))))})
    return step.withColumn("contaminated", F.col("n_hit") > 0)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text"), benchmark).select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without any hit, all columns as they were."""
    return kept_rows(judge(docs, benchmark).withColumn("kept", ~F.col("contaminated")))


def without_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(row, words)`` with the hit words taken out: normalised words, not the text as it was written."""
    step = with_hits(docs, benchmark)
    reach = F.transform("hits", lambda hit: F.struct(hit["first"].alias("first"), hit["after"].alias("after")))
    left = F.filter("words", lambda word, i: ~F.exists(reach, lambda s: (s["first"] <= i) & (i < s["after"])))
    return step.select("row", left.alias("words"))
