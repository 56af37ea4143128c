"""Mixing sources to target weights: documents in a random order by source, cut where the source's budget ends.

The order is that of a hash of id and text. The place of the cut is looked for by the leading digits of the hash: sums by
the first of them give the range in which a source's budget ends, sums within it by more of them a narrower one, and sums
by the whole hash the key at the cut. Ranges hold sums, never documents, so no task gets a whole source or the rows of one id,
and documents are not shuffled: their keys are only compared with that at the cut. A rerun finds the same order. Budgets above
a source's words repeat the source: whole epochs first, then the part of one.

Defined results: a null or empty text has size 0, is never taken and counts for its source; a null source is one source,
the last; rows alike in id, source and text are alike in the result, but where the cut falls among them: these are numbered,
and the first of them are taken; sources without words get budget 0; no rows give no rows; other columns of the input play
no part. Texts have no length limit.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, checkpointed, split_words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
# Leading digits of the key by which the cut is looked for: 4,096 ranges in each range before, then whole keys.
WIDTHS = (3, 6, 32)
# One row for each source, of about 100 bytes: up to so many sources are broadcast.
FEW_SOURCES = 50_000
# Parts of a source in a join by source where there are more.
PART_DIGITS = 2
SEED = "mix-1"
DEALT = ("source_size", "target", "epochs")


def size_of(text: Column) -> Column:
    return F.size(split_words(text, SPACE)).cast("long")


def keyed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``(row, doc_id, source, size, key)``."""
    key = F.md5(F.concat_ws(
        "|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))))
    return docs.select(F.struct("*").alias("row"), "doc_id", "source", size_of(F.col("text")).alias("size"), key.alias("key"))


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, source_size, target)`` of ``(source, source_size)``.

    ``share`` of all words is dealt by weight. A source takes ``most`` times its words at the utmost, and what it can't
    take is dealt to the others in the same way. In order of limit by weight, the sources that stop at their limit come
    first; one does so when what is left, after those before it, gives its weight its limit or more. Running sums over the
    sources, of which there is one row each, say for which.
    """
    ranked = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank"), F.lit(len(weights))) + 1)
    step = sources.withColumn("rank", F.row_number().over(ranked) - 1).withColumn("weight", weight)
    step = step.withColumn("limit", F.col("source_size") * most)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    step = step.withColumns({
        "words": F.sum("source_size").over(every) * share, "weights": F.sum("weight").over(every),
        "words_before": F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
        "weights_before": F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    rate = (F.col("words") - F.col("words_before")) / (F.col("weights") - F.col("weights_before"))
    step = step.withColumn("rate", rate).withColumn("full", F.col("limit") <= F.col("rate") * F.col("weight"))
    # The rate of the first source that does not stop at its limit holds for all that do not.
    step = step.withColumn("open_rate", F.first(F.when(~F.col("full"), F.col("rate")), ignorenulls=True).over(
        filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.col("open_rate") * F.col("weight"))
    return step.select("source", "source_size", target.alias("target"))


def _ended(sums: DataFrame) -> DataFrame:
    """Of ``(source, prefix, words, rows)`` and the columns of cuts: the prefix at which each source's budget ends."""
    reached = F.sum("words").over(
        Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = sums.withColumn("reached", reached).filter(
        (F.col("rest") < F.col("reached")) & (F.col("rest") >= F.col("reached") - F.col("words")))
    rest = F.col("rest") - F.col("reached") + F.col("words")
    return ends.select("source", *DEALT, rest.alias("rest"), "prefix", "rows")


def _first_range(sizes: DataFrame, cuts: DataFrame) -> DataFrame:
    """``cuts`` with the range of a source in which its budget ends. At most ``16 ** WIDTHS[0]`` rows of a source are joined."""
    sums = sizes.groupBy("source", F.substring("key", 1, WIDTHS[0]).alias("prefix")).agg(
        F.sum("size").alias("words"), F.count("*").alias("rows"))
    sums = sums.alias("a").join(cuts.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    return _ended(sums.select("a.source", "prefix", "words", "rows", *DEALT, "rest"))


def _narrower(sizes: DataFrame, cuts: DataFrame, before: int, width: int) -> DataFrame:
    """The same for ranges within those of ``before`` digits. One row for each of them goes through the window."""
    inside = sizes.alias("a").join(cuts.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (
        F.substring("a.key", 1, before) == F.col("b.prefix")))
    sums = inside.groupBy(F.col("b.source"), F.substring("a.key", 1, width).alias("prefix")).agg(
        F.sum("a.size").alias("words"), F.count("*").alias("rows"),
        *[F.first(F.col(f"b.{c}")).alias(c) for c in (*DEALT, "rest")])
    return _ended(sums)


def cuts_of(sizes: DataFrame, **options) -> DataFrame:
    """``(source, source_size, target, epochs, rest, prefix, rows)`` for each source of ``(source, key, size)``: documents
    with a key below ``prefix`` are taken once more than ``epochs``, the ``rows`` with that key have ``rest`` words to
    give. A source without words has no prefix."""
    dealt = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), **options)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(F.lit(0)).cast("long")
    dealt = dealt.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    cuts = _first_range(sizes, dealt.filter("source_size > 0"))
    for before, width in pairwise(WIDTHS):
        cuts = _narrower(sizes, cuts, before, width)
    silent = dealt.filter("source_size = 0").withColumns(
        {"prefix": F.lit(None).cast("string"), "rows": F.lit(0).cast("long")})
    return cuts.unionByName(silent)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``(row, doc_id, size, source_size, target, taken)``: ``row`` holds the columns of the input, ``taken`` is how many
    words of the document the mix takes, repeats counted; the document at the cut gives its first words."""
    rows = keyed(docs)
    cuts = checkpointed(cuts_of(checkpointed(rows.select("source", "key", "size")), **options))
    told = cuts.agg(F.count("*").alias("sources"), F.coalesce(F.max("rows"), F.lit(0)).alias("alike")).first()
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    if told["sources"] <= FEW_SOURCES:
        step = rows.alias("a").join(F.broadcast(cuts).alias("b"), same)
    else:
        # Each source in 16 ** PART_DIGITS parts, so that a large one is not joined in one task.
        digits = [f"{i:0{PART_DIGITS}x}" for i in range(16 ** PART_DIGITS)]
        parts = cuts.withColumn("part", F.explode(F.array(*[F.lit(d) for d in digits])))
        step = rows.alias("a").join(parts.alias("b"), same & (F.substring("a.key", 1, PART_DIGITS) == F.col("b.part")))
    step = step.select("row", "doc_id", "size", "key", "b.source", "source_size", "target", "epochs", "rest", "prefix", "rows")

    def taken(frame, before):
        part = F.when(F.col("key") < F.col("prefix"), F.col("size")).when(
            F.col("key") == F.col("prefix"), F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - before)))
        part = F.coalesce(part, F.lit(0).cast("long"))
        return frame.select(
            "row", "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))

    if told["alike"] <= 1:
        return taken(step, F.lit(0).cast("long"))
    cut_among_alike = F.coalesce((F.col("key") == F.col("prefix")) & (F.col("rows") > 1), F.lit(False))
    numbered = Window.partitionBy("source").orderBy("key")
    alike = step.filter(cut_among_alike).withColumn("place", F.row_number().over(numbered) - 1)
    return taken(step.filter(~cut_among_alike), F.lit(0).cast("long")).unionByName(
        taken(alike, F.col("place") * F.col("size")))


def digest(docs: DataFrame) -> DataFrame:
    return mixed(docs.select("doc_id", "source", "text")).drop("row").withColumn("target", F.round("target", 6))


def take(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, all columns as they were. The document at the cut of its
    source is taken whole when half of it or more fits in, and documents without
    words are left out."""
    step = mixed(docs, **options)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5)).otherwise(
        F.lit(0)).cast("int")
    return step.select(F.explode(F.array_repeat("row", times)).alias("row")).select("row.*")
