"""URL filters: rules of host and path, and a list of URLs behind a blocked Bloom filter.

The list is put into a Bloom filter of blocks of eight 32-bit words, in which a URL sets one bit of each word of one
block. It has at most ``MAX_BLOCKS`` blocks, 32 bytes each, so it may be broadcast whatever the list's length: a longer
list lets more URLs through to the exact join, which decides. The join meets each listed URL once.

Defined results: a null URL or one without ``://`` has empty host and path, fits no rule, is never listed and is allowed;
repeated rows are judged one by one; an empty list blocks nothing; other columns of the input play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

# Fixed values: (verdict, host, path); a rule fits its host and all hosts below, and paths that start with its path.
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
# Query parameters that name no content, and labels of host names that listed URLs have.
TRACKING = ("fbclid", "gclid", "ref", "utm_[a-z]+")
LISTED_LABELS = ("casino", "spam")
# The odd multipliers of split-block Bloom filters, one for each word of a block.
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
BITS_PER_URL = 16
MAX_BLOCKS = 1 << 16


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``, or empty text."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.coalesce(lower_ascii(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column) -> Column:
    """``(verdict, rule)`` of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, name, prefix in sorted(RULES, key=lambda rule: len(rule[1] + rule[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(name + prefix).alias("rule"))).otherwise(
            found)
    return found


def canonical(url: Column) -> Column:
    """Host without ``www.`` or ``m.`` and default port, path without a last slash, and the other parameters in order;
    scheme and fragment are left out. Null where there is no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(?:80|443)$", ""), r"^(?:www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    named = F.filter(F.split(query, "&"), lambda part: (part != "") & ~part.rlike(rf"^(?:{'|'.join(TRACKING)})(?:=|$)"))
    return F.when(host != "", F.concat(host, path, F.when(F.size(named) > 0, F.concat(
        F.lit("?"), F.array_join(F.sort_array(named), "&"))).otherwise(F.lit(""))))


def listed_pages(pages: DataFrame) -> DataFrame:
    """``(canonical)``, each once: the URLs of the table whose host has a label that starts with a listed word."""
    labels = "|".join(LISTED_LABELS)
    return pages.filter(host_of(F.col("url")).rlike(rf"(?:^|\.)(?:{labels})")).select(
        canonical(F.col("url")).alias("canonical")).distinct()


def _block(hash_: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(hash_, 32), F.lit(blocks)).cast("int")


def _bits(hash_: Column) -> list[Column]:
    """The bit that a URL sets in each word of its block."""
    low = hash_.bitwiseAND(F.lit(0x7FFFFFFF))
    places = [F.shiftrightunsigned((low * F.lit(salt)).bitwiseAND(F.lit(0xFFFFFFFF)), 27) for salt in SALTS]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int")) for place in places]


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """``(block, w0 … w7)`` of the blocks that are not empty."""
    hash_ = F.xxhash64("canonical")
    named = listed.select(_block(hash_, blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(hash_))])
    return named.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(len(SALTS))])


def judge(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """``(row, host, path, rule, rule_verdict, listed)``: ``row`` holds the columns of the input, ``listed`` says whether
    the canonical URL is in ``listed``, one row for each ``canonical``."""
    blocks = min(MAX_BLOCKS, max(1, -(-listed.count() * BITS_PER_URL // 256)))
    url = F.col("url")
    step = pages.select(F.struct("*").alias("row"), "url").select(
        "row", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical"))
    step = step.withColumn("fit", rule_of(F.col("host"), F.col("path"))).withColumn(
        "block", _block(F.xxhash64("canonical"), blocks))
    step = step.join(F.broadcast(bloom_filter(listed, blocks)), "block", "left")
    set_ = [F.col(f"w{i}").bitwiseAND(bit) != 0 for i, bit in enumerate(_bits(F.xxhash64("canonical")))]
    maybe = F.col("canonical").isNotNull()
    for bit in set_:
        maybe = maybe & F.coalesce(bit, F.lit(False))
    step = step.withColumn("maybe", maybe).select("row", "host", "path", "fit", "canonical", "maybe")
    passed = step.filter("maybe").join(listed.withColumn("listed", F.lit(True)), "canonical", "left")
    both = passed.select("row", "host", "path", "fit", F.coalesce("listed", F.lit(False)).alias("listed")).union(
        step.filter("not maybe").select("row", "host", "path", "fit", F.lit(False).alias("listed")))
    return both.select(
        "row", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("rule_verdict"), "listed")


def digest(pages: DataFrame) -> DataFrame:
    """Each page's verdict: its rule's, else block where its URL is listed."""
    judged = judge(pages.select("page_id", "url"), listed_pages(pages))
    own = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        "row.page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "listed")
