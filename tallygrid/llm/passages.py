"""Substring dedup by difference-cover anchors: passages that stand earlier in the corpus are taken out.

A window is ``window`` consecutive words of one document. Hashing all of them would shuffle a row for each word. Positions
are looked at modulo a period instead, and only those in a difference cover are anchors: any two positions have some
offset below the period at which both are in the cover. So when two windows are equal, they share an anchor of
``window - period + 1`` words at one offset, wherever they stand, and a window none of whose anchors is found twice is the
only one of its kind.

1. Rows of equal text: all but the first lose all their windows, without any further search.
2. Anchors are counted by hash. What goes back to a document are its anchors found once, of which there is one row each,
   so no hash, however frequent, is ever joined; all others of the document are repeated.
3. Each repeated anchor is extended to the windows that hold it. The first place of each distinct window, a partial
   aggregate, goes back to the document that owns it, again one row each. What a document does not own, it loses.
4. The windows of a document that others own, merged to spans of words, are what it loses.

Document order is that of ``doc_id``, nulls last; rows of equal id are in order of a digest of id and text. Rows are joined by
id and digest, windows are told apart by 96 bits. A task holds one document and its lists, nothing of a group.

Defined results: null and empty texts and those of fewer words than a window lose nothing; rows alike in id and text are
one document, so that each keeps what the first keeps; no rows give no rows; other columns play no part and may have any
name. Texts have no length limit.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

# Tasks get this module's functions with the job; executors need not have the library installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 20
# Perfect difference covers by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
# Words of an anchor at the least, where the window allows it.
LEAST_ANCHOR = 8
# Bytes of text whose words are hashed at once, and texts that are put together at once.
CHUNK, SLICE = 1 << 20, 500
SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("after", T.IntegerType())]))
ARROW_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))
# What tells rows apart and puts them in order.
PLACE = ("missing", "id", "key")


def period_of(window: int) -> int:
    """The longest period that leaves anchors of ``LEAST_ANCHOR`` words, or of at least two thirds of a short window."""
    least = min(LEAST_ANCHOR, -(-2 * window // 3))
    return max(p for p in COVERS if window - p + 1 >= least)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each pair, in order."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def rolled(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each so many consecutive elements; those of 2, 4, 8 … are pairs of half as many."""
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    power, known = 1, {1: hashes}
    while 2 * power <= length:
        known[2 * power] = mix(known[power][:-power], known[power][power:])
        power *= 2
    found, done = None, 0
    for part in sorted((p for p in known if p & length), reverse=True):
        found = known[part] if found is None else mix(found[:len(known[part]) - done], known[part][done:])
        done += part
    return found[:len(hashes) - length + 1]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def anchor_places(n: int, window: int) -> np.ndarray:
    """The positions of the anchors of a document of so many words, in order."""
    period = period_of(window)
    if n < window:
        return np.zeros(0, np.int64)
    last = n - (window - period + 1)
    places = (np.arange(last // period + 1)[:, None] * period + np.array(COVERS[period])).ravel()
    return places[places <= last]


def windows_at(repeated: np.ndarray, n: int, window: int) -> np.ndarray:
    """The starts of the windows that hold a repeated anchor."""
    marks = np.zeros(n + 1, np.int32)
    np.add.at(marks, np.maximum(repeated - (period_of(window) - 1), 0), 1)
    np.add.at(marks, repeated + 1, -1)
    starts = np.flatnonzero(np.cumsum(marks) > 0)
    return starts[starts <= n - window]


def spans_of(starts: np.ndarray, window: int) -> list[dict]:
    """The words covered by the windows, as spans."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > window)
    first, last = starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)]
    return [{"first": int(a), "after": int(b) + window} for a, b in zip(first, last)]


def _chunks(texts: pa.Array) -> Iterator[tuple[list[int], np.ndarray]]:
    """Lengths in words and the hashes of all words of consecutive texts of about a chunk."""
    held, size = [], 0
    for text in texts:
        held.append(words_of(text.as_py()))
        size += sum(map(len, held[-1]))
        if size >= CHUNK:
            yield [len(w) for w in held], word_hashes([w for words in held for w in words])
            held, size = [], 0
    if held:
        yield [len(w) for w in held], word_hashes([w for words in held for w in words])


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _anchors(window: int):
    width = window - period_of(window) + 1

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, done = batch.column("id"), batch.column("key"), 0
            for lengths, hashes in _chunks(batch.column("text")):
                found, lists, start = rolled(hashes, width), [], 0
                for n in lengths:
                    lists.append(found[anchor_places(n, window) + start])
                    start += n
                offsets = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                values = pa.array(np.concatenate(lists).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*[names.slice(done, len(lists)) for names in (ids, keys)],
                     pa.ListArray.from_arrays(pa.array(offsets), values)], ["id", "key", "anchors"])
                done += len(lists)

    return made


def _candidates(window: int):
    """Of each row its removed spans where they are known, or else its repeated anchors."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            spans, repeated = [], []
            for text, once, first in zip(batch.column("row").field("text"), batch.column("once"), batch.column("first")):
                n = len(words_of(text.as_py()))
                places = anchor_places(n, window)
                again = np.ones(len(places), bool)
                if first.as_py() and once.is_valid:
                    again[once.values.to_numpy()] = False
                open_ = bool(first.as_py() and again.any())
                spans.append(None if open_ else [{"first": 0, "after": n}] if n >= window and not first.as_py() else [])
                repeated.append(places[again] if open_ else None)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name) for name in ("row", *PLACE)], pa.array(spans, ARROW_SPANS),
                 pa.array(repeated, pa.list_(pa.int32()))], ["row", *PLACE, "spans", "repeated"])

    return made


def _windows(window: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, rows = [], []
            for row in range(batch.num_rows):
                hashes = word_hashes(words_of(batch.column("text")[row].as_py()))
                starts = windows_at(batch.column("repeated")[row].values.to_numpy(), len(hashes), window)
                one = rolled(hashes, window)[starts]
                other = rolled(mix(hashes, hashes >> np.uint64(7)), window)[starts] >> np.uint64(32)
                held.append((one, other, starts))
                rows.append(np.full(len(starts), row))
                if sum(map(len, rows)) >= CHUNK // 8 or row == batch.num_rows - 1:
                    one, other, starts = (np.concatenate(parts) for parts in zip(*held))
                    again = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(one.view(np.int64)), pa.array(other.astype(np.uint32).view(np.int32)),
                         *[batch.column(name).take(again) for name in PLACE], pa.array(starts.astype(np.int32))],
                        ["one", "other", *PLACE, "start"])
                    held, rows = [], []

    return made


def _lost(window: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            found = []
            for text, repeated, owned in zip(batch.column("row").field("text"), batch.column("repeated"), batch.column("owned")):
                starts = windows_at(repeated.values.to_numpy(), len(words_of(text.as_py())), window)
                kept = owned.values.to_numpy() if owned.is_valid else np.zeros(0, np.int32)
                found.append(spans_of(np.setdiff1d(starts, kept), window))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, ARROW_SPANS)], ["row", "spans"])

    return made


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _sliced(batches):
        counts, lost, kept = [], [], []
        for text, spans in zip(batch.column("row").field("text"), batch.column("spans")):
            words, left, done = words_of(text.as_py()), [], 0
            for span in spans.as_py() or ():
                left += words[done:span["first"]]
                done = span["after"]
            left += words[done:]
            counts.append(len(words))
            lost.append(len(words) - len(left))
            kept.append(b" ".join(left).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("spans"), pa.array(counts, pa.int64()), pa.array(lost, pa.int64()),
             pa.array(kept, pa.string())], ["row", "spans", "n_words", "n_removed", "kept"])


def _identity() -> dict[str, Column]:
    """What tells rows apart and puts them in order: the id, nulls last, and 64 bits of a digest of id and text."""
    digest = F.md5(F.concat(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))
    return {
        "missing": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0).cast("long")),
        "key": F.conv(F.substring(digest, 1, 16), 16, -10).cast("long")}


def _schema(rows: DataFrame, columns: list[str], **others: T.DataType) -> T.StructType:
    return T.StructType([*[rows.schema[name] for name in columns], *[T.StructField(name, kind) for name, kind in others.items()]])


def _stored(frame: DataFrame, name: str) -> DataFrame:
    """The rows as a table. The shuffles that made them are no longer needed; Spark deletes their files when the driver's
    garbage is collected, which may be long after. The first collection frees the plan, the next one its shuffles."""
    table = written(frame, name)
    for _ in range(2):
        frame.sparkSession._jvm.System.gc()
        time.sleep(0.5)
    return table


def with_lost_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(row, spans)``: ``row`` holds the columns of the input, ``spans`` are the words that the row loses.

    Texts are shuffled twice: to meet their own anchors, and, where some of these are repeated, to meet their own windows.
    """
    rows = docs.select(F.struct("*").alias("row"), *[value.alias(name) for name, value in _identity().items()])
    text, place = F.col("row.text"), F.min(F.struct(*PLACE)).alias("at")
    firsts = rows.groupBy(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")).agg(place)
    anchors = rows.select("id", "key", text.alias("text")).mapInArrow(
        _anchors(window), "id bigint, key bigint, anchors array<bigint>")
    once = anchors.select("id", "key", F.posexplode("anchors").alias("at", "hash")).groupBy("hash").agg(
        F.count(F.lit(1)).alias("n"), *[F.min(name).alias(name) for name in ("id", "key", "at")]).filter("n = 1")
    known = once.select("id", "key", "at").union(firsts.select("at.id", "at.key", F.lit(None).cast("int"))).groupBy(
        "id", "key").agg(F.collect_list("at").alias("once"), (F.count("*") > F.count("at")).alias("first"))
    known = _stored(known, "anchors")
    judged = rows.join(known, ["id", "key"], "left").select(
        "row", *PLACE, "once", F.coalesce("first", F.lit(False)).alias("first")).mapInArrow(
        _candidates(window), _schema(rows, ["row", *PLACE], spans=SPANS, repeated=T.ArrayType(T.IntegerType())))
    judged = _stored(judged, "passages")
    open_ = judged.filter("repeated is not null")
    owners = open_.select(*PLACE, "row.text", "repeated").mapInArrow(
        _windows(window), "one bigint, other int, missing boolean, id bigint, key bigint, start int").groupBy(
        "one", "other").agg(F.min(F.struct(*PLACE, "start")).alias("at"))
    owned = owners.select("at.id", "at.key", "at.start").groupBy("id", "key").agg(F.collect_list("start").alias("owned"))
    lost = open_.select("row", "id", "key", "repeated").join(owned, ["id", "key"], "left").mapInArrow(
        _lost(window), _schema(rows, ["row"], spans=SPANS))
    return judged.filter("repeated is null").select("row", "spans").union(lost)


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(row, spans, n_words, n_removed, kept)``: ``row`` holds the columns of the input, ``spans`` are the words lost and
    ``kept`` the words left, joined by single blanks."""
    found = with_lost_spans(docs, window)
    return found.mapInArrow(_kept, _schema(
        found, ["row", "spans"], n_words=T.LongType(), n_removed=T.LongType(), kept=T.StringType()))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows with what is left of their texts, all other columns as they were. Rows of which nothing is left stay, with
    an empty text; a text that loses nothing keeps its white space."""
    found = deduplicated(docs, window)
    return found.select(*[
        F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text")).alias(c) if c == "text"
        else F.col("row").getField(c).alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    return deduplicated(docs.select("doc_id", "text")).select(
        "row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
