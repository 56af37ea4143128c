"""Quality rules, line first: rules judge each line, failing lines go, and a document that loses too much text goes.

Defined results: a null or empty text has no words and fails the base rules, as does any text of fewer than 50 words;
repeated rows are judged one by one; no rows give no rows; other columns of the input play no part. Texts have no length
limit: all work is linear in the text but for one sort of its repeated windows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, covered, kept_rows, split_words, total, with_window_hashes

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
WINDOW = 3
# A document is rejected when its failing lines hold more than this share of its word characters.
MAX_LOST_PERCENT = 40

# Words that mark boilerplate lines.
BOILERPLATE = (
    "accept all cookies", "all rights reserved", "back to top", "click here", "cookie policy", "enable javascript",
    "javascript is disabled", "lorem ipsum", "privacy policy", "read more", "sign in", "sign up", "skip to content",
    "subscribe to our newsletter", "terms of service", "terms of use",
)
SYMBOLS = r"[#*$%&|<>]"
# Punctuation of menus and noise, and the characters for each of which a line must have one to fail.
SIGNS = r"[\x7C\xB7\xBB]|[#*$%&<>=~^!?]{2,}"
CHARACTERS_PER_SIGN = 20
SHORT_LINE = 80
LONG_LINE = 80
LEAST_CAPITALS = 20
# Ends of sentences and clauses in the scripts that have such signs, and letters of those that have none.
SENTENCE_ENDS = (
    r"[.!?:;\u2026\u037E\u0589\u055C\u055E\u061B\u061D-\u061F\u06D4\u0700-\u0702\u07F9\u0964\u0965\u0F0D\u0F0E\u104A\u104B"
    r"\u1362\u1366-\u1368\u166E\u1735\u1736\u17D4\u17D5\u1803\u1809\u1944\u1945\u1AA8-\u1AAB\u1B5A\u1B5B\u1B5E\u1B5F\u1C3B\u1C3C"
    r"\u1C7E\u1C7F\u203C\u203D\u2047-\u2049\u3002\uA4FF\uA60E\uA60F\uA6F3\uA6F7\uA876\uA877\uA8CE\uA8CF\uA92F\uA9C8\uA9C9"
    r"\uAA5D-\uAA5F\uAAF0\uAAF1\uABEB\uFE52\uFE56\uFE57\uFF01\uFF0E\uFF1A\uFF1B\uFF1F\uFF61\x{11047}\x{11048}\x{11141}-\x{11143}"
    r"\p{IsThai}\p{IsLao}]")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def line_failures(line: Column) -> dict[str, Column]:
    """The rules that a line may fail, by name; lines of prose fail none.

    ``signs``: bars and dots of menus, or runs of other signs between the words. ``shouting``: capitals
    without any small letter, when most letters are capitals. ``unended``: a long line without any sentence end, of whatever
    script; Thai and Lao write none. ``boilerplate``: a short line with a
    phrase of web page furniture.
    """
    size = F.char_length(line)
    return {
        "signs": _count(line, SIGNS) * CHARACTERS_PER_SIGN >= F.greatest(size, F.lit(1)),
        "shouting": (size >= LEAST_CAPITALS) & ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}")
        & (2 * _count(line, r"\p{Lu}") > _count(line, r"\p{L}")),
        "unended": (size >= LONG_LINE) & ~line.rlike(SENTENCE_ENDS),
        "boilerplate": (size <= SHORT_LINE) & reduce(
            lambda a, b: a | b, [F.lower(line).contains(phrase) for phrase in BOILERPLATE]),
    }


def fails(line: Column) -> Column:
    return reduce(lambda a, b: a | b, line_failures(line).values())


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def clean_text(text: Column) -> Column:
    """The text without its failing lines."""
    return F.array_join(F.filter(lines_of(text), lambda line: ~fails(line)), "\n")


def _characters(text: Column) -> Column:
    """Code points in words."""
    return F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")).cast("long")


def _in_runs(keys: str, width: Column) -> Column:
    """Positions, held in the low bits of sorted keys, whose other bits equal a neighbour's."""
    def alike(key, after):
        return F.when(
            F.call_function("shiftrightunsigned", key.bitwiseXOR(after), width) == 0, F.array(key, after))

    pairs = F.zip_with(keys, F.slice(keys, 2, F.size(keys)), alike)
    low = F.call_function("shiftleft", F.lit(1).cast("long"), width) - 1
    return F.transform(
        F.array_distinct(F.flatten(F.filter(pairs, lambda pair: pair.isNotNull()))),
        lambda key: key.bitwiseAND(low).cast("int"))


def with_repeated_words(frame: DataFrame, words: str, output: str) -> DataFrame:
    """Add how many words lie in windows of three that the text holds twice or more.

    Windows are compared by 64 bits. Most texts repeat none, which a set shows. Else the hashes are sorted with their
    positions in the low bits, twice: by their lower bits, and what is still equal by their upper bits.
    """
    step = frame.withColumn("_h", F.transform(words, lambda word: F.xxhash64(word)))
    step = with_window_hashes(step, "_h", {WINDOW: "_g"})
    step = step.withColumn("_twice", F.size("_g") > F.size(F.array_distinct("_g")))
    step = step.withColumn("_width", F.ceil(F.log2(F.size("_g") + 2)).cast("int"))
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_width")) - 1
    none = F.array().cast("array<bigint>")

    def keyed(upper: bool):
        def key(h, i):
            head = h.bitwiseAND(F.bitwise_not(low)) if upper else F.call_function("shiftleft", h, F.col("_width"))
            return head.bitwiseOR(i.cast("long"))

        return key

    step = step.withColumn("_a", F.when(F.col("_twice"), F.sort_array(F.transform("_g", keyed(False)))).otherwise(none))
    step = step.withColumn("_p", _in_runs("_a", F.col("_width")))
    upper = keyed(True)
    # Named twice, so that the optimizer does not move the making of _g into the function of each element.
    step = step.withColumn("_b", F.when(F.size("_g") > 0, F.sort_array(
        F.transform("_p", lambda p: upper(F.get(F.col("_g"), p), p)))).otherwise(none))
    step = step.withColumn("_q", _in_runs("_b", F.col("_width")))
    spans = F.transform("_q", lambda p: F.struct(p.alias("first"), (p + WINDOW).alias("after")))
    return step.withColumn(output, covered(spans)).select(*frame.columns, output)


def judge(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, base_failed,
    kept)``: ``row`` holds the columns of the input."""
    step = docs.select(F.struct("*").alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    step = step.withColumn("_words", split_words(F.col("text")))
    step = step.withColumn("n_words", F.size("_words").cast("long"))
    step = step.withColumn("word_chars", total(F.transform("_words", F.char_length)))
    step = with_repeated_words(step, "_words", "n_repeat_words").drop("_words")
    step = step.withColumn("_lines", F.filter(lines_of(F.col("text")), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    failing = F.filter("_lines", fails)
    step = step.withColumns({
        "n_symbols": _count(F.col("text"), SYMBOLS).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "lost_chars": total(F.transform(failing, _characters)),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    lost = 100 * F.col("lost_chars") > MAX_LOST_PERCENT * F.col("word_chars")
    return step.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~lost).drop("_lines")


def digest(docs: DataFrame) -> DataFrame:
    """Counts and verdict of each row."""
    return judge(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed",
        "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of kept documents, whose failing lines are gone from ``text`` and from the count ``n_chars`` where there
    is one; the other columns are as they were."""
    kept = kept_rows(judge(docs))
    # A text without failing lines stays as it is.
    text = clean_text(F.col("text"))
    size = {name: F.char_length(text).cast(kind) for name, kind in kept.dtypes if name == "n_chars"}
    return kept.withColumns({"text": text, **size})
