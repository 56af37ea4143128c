"""What the operators of this package share: words, tables and checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _class(codes) -> str:
    # Characters one by one: Java looks them up in one table, while ranges are tried in turn.
    return "[" + "".join(f"\\x{code:02X}" for code in codes) + "]+"


# Separators between words: white space, or all of ASCII but digits and small letters.
SPACE = _class([0x20, *range(0x09, 0x0E)])
NOT_WORD = _class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; other letters stay. Texts of ASCII alone take the faster function."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def split_words(text: Column, separators: str = SPACE) -> Column:
    """The words between runs of separators; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda word: word != "")


def indices(count: Column) -> Column:
    """0 … count-1, or an empty array."""
    return F.when(count > 0, F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1)).otherwise(
        F.array().cast("array<int>"))


def with_window_hashes(frame: DataFrame, hashes: str, lengths: dict[int, str]) -> DataFrame:
    """Add, for each length, the column with one hash for each so many consecutive elements, given a column with the
    hashes of the elements.

    Hashes of 2, 4, 8 … elements are pairs of those of half as many. Each is a column of its own, used more than once,
    so that the optimizer makes it once.
    """
    def pair(left, right, shift):
        return F.zip_with(left, F.slice(right, shift + 1, F.size(right)), lambda a, b: F.xxhash64(a, b))

    kept, power, known = frame.columns, 1, {1: hashes}
    while 2 * power <= max(lengths, default=1):
        known[2 * power] = f"_windows_{2 * power}"
        frame = frame.withColumn(known[2 * power], pair(F.col(known[power]), F.col(known[power]), power))
        power *= 2
    outputs = {}
    for length, output in lengths.items():
        rolled, done = None, 0
        for part in (p for p in sorted(known, reverse=True) if p & length):
            rolled = pair(rolled, F.col(known[part]), done) if done else F.col(known[part])
            done += part
        outputs[output] = F.slice(rolled, 1, F.greatest(F.size(hashes) - (length - 1), F.lit(0)))
    return frame.select(*kept, *[rolled.alias(name) for name, rolled in outputs.items()])


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda sum_, n: sum_ + n)


def covered(spans: Column) -> Column:
    """How many positions lie in any of the ``(first, after)`` spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    return F.aggregate(
        F.sort_array(spans), start,
        lambda acc, span: F.struct(
            (acc["n"] + F.greatest(span["after"] - F.greatest(span["first"], acc["reach"]), F.lit(0))).alias("n"),
            F.greatest(acc["reach"], span["after"]).alias("reach")),
        lambda acc: acc["n"].cast("long"))


def kept_rows(judged: DataFrame) -> DataFrame:
    """The columns in ``row`` where ``kept`` is true. A generator, unlike a filter, is not moved below the expressions
    that it depends on, which would then run twice."""
    return judged.select(F.explode(F.when(F.col("kept"), F.array("row"))).alias("row")).select("row.*")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; a local session without one gets its own, which
    goes when Python ends."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="llm-shared-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    context.setCheckpointDir(own)
    return own


def checkpointed(frame: DataFrame) -> DataFrame:
    """The rows written to the shared folder, from which lost executors' work is read again."""
    context, folder = frame.sparkSession.sparkContext, shared_folder(frame.sparkSession)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return frame.checkpoint(eager=True)


def written(frame: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}.parquet"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
