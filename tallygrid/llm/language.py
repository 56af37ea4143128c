"""Language by Bayesian fusion of evidence: the text, the language its markup declares, the suffix of its address, and what
its host and domain mostly hold.

The text's likelihoods come from a model of hashed byte trigrams, fitted on about ``TRAINING_ROWS`` labelled documents,
the same number for each language as far as there are so many, chosen by a hash of id and text. The model's languages are
the ``MAX_LANGUAGES`` most frequent labels; items of other languages are judged among these. Everything else is counted over all items: posteriors by text alone are summed by declared
language, suffix, host and domain. The prior of a host leans on that of its domain, which leans on that of all items; an
item's own share is left out of its host's counts. A host may hold any part of the items: sums by host are partial
aggregates, and the join with them is split where it is skewed.

Defined results: null and empty texts are judged by the other evidence, and without any by the prior of all; an unknown or
missing declaration, a missing address and a missing host are no evidence; repeated rows are judged one by one; without
labelled documents the language is null; no rows give no rows; other columns of the input play no part.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .url_filter import host_of

# Tasks get this module's functions with the job; executors need not have the library installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TRAINING_ROWS = 20_000
MAX_LANGUAGES = 200
BUCKET_BITS = 14
# Trigrams of a text depend on each other: the mean of their likelihoods counts as so many at most.
TRIGRAMS_THAT_COUNT = 60
HOST_STRENGTH, DOMAIN_STRENGTH, SUFFIX_STRENGTH, DECLARED_STRENGTH = 5.0, 20.0, 20.0, 2.0
CHUNK = 1 << 20


def trigrams(text: bytes) -> Iterator[np.ndarray]:
    """The buckets of the trigrams of the bytes, in pieces of bounded size."""
    for at in range(0, max(len(text) - 2, 0), CHUNK):
        b = np.frombuffer(text[at:at + CHUNK + 2], np.uint8).astype(np.uint32)
        mixed = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
        yield mixed >> np.uint32(32 - BUCKET_BITS)


def visible_text(html: str) -> str:
    """What stands between tags, outside scripts, styles and comments; one pass over the page."""
    out, skipped, comment = [], "", False
    for piece in html.split("<"):
        if comment:
            head, sep, tail = piece.partition("-->")
            if sep:
                comment = False
                out.append(tail)
            continue
        if piece.startswith("!--"):
            head, sep, tail = piece[3:].partition("-->")
            comment = not sep
            out.append(tail)
            continue
        tag, _, tail = piece.partition(">")
        name = re.match(r"/?[A-Za-z]*", tag).group().lower()
        if skipped:
            if name == "/" + skipped:
                skipped = ""
                out.append(tail)
        elif name in ("script", "style"):
            skipped = name
        else:
            out.append(tail)
    return " ".join(out)


def _counts(languages: list[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {language: np.zeros(1 << BUCKET_BITS, np.int64) for language in languages}
        for batch in batches:
            for language, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                for part in trigrams((text or "").lower().encode()):
                    totals[language] += np.bincount(part, minlength=1 << BUCKET_BITS)
        for place, language in enumerate(languages):
            used = np.flatnonzero(totals[language])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(used), place)), pa.array(used), pa.array(totals[language][used])],
                ["place", "bucket", "n"])

    return count


def fit(labelled: DataFrame, rows: int = TRAINING_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, the ``MAX_LANGUAGES`` most frequent at most, and the log likelihood of each bucket in each."""
    by_language = labelled.filter("lang is not null").groupBy("lang").count()
    known = by_language.orderBy(F.col("count").desc(), "lang").limit(MAX_LANGUAGES).collect()
    languages = sorted(r["lang"] for r in known)
    if not languages:
        return [], np.zeros((0, 1 << BUCKET_BITS), np.float32)
    # Each language has its share of the rows, or all that it has, so a rare one is learned as well.
    shares = F.create_map(*[F.lit(x) for r in known for x in (r["lang"], r["count"])])
    chosen = labelled.filter(F.col("lang").isin(languages)).filter(
        F.pmod(F.xxhash64(F.lit("train"), "doc_id", "text"), F.element_at(shares, F.col("lang"))) < rows // len(languages))
    counted = chosen.select("lang", "text").mapInArrow(_counts(languages), "place bigint, bucket bigint, n bigint")
    table = np.full((len(languages), 1 << BUCKET_BITS), 0.5)
    for row in counted.groupBy("place", "bucket").agg(F.sum("n").alias("n")).collect():
        table[row["place"], row["bucket"]] += row["n"]
    return languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def _likelihoods(table: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for markup, text in zip(batch.column("markup").to_pylist(), batch.column("text").to_pylist()):
                body, sums, n = (visible_text(text or "") if markup else text or "").lower().encode(), 0.0, 0
                for part in trigrams(body):
                    n += len(part)
                    counts = np.bincount(part, minlength=1 << BUCKET_BITS)
                    used = np.flatnonzero(counts)
                    sums = sums + table[:, used].astype(np.float64) @ counts[used]
                logs = sums / n * min(n, TRIGRAMS_THAT_COUNT) if n else np.zeros(len(table))
                found.append((logs - logs.max()).tolist())
            names = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name) for name in names], pa.array(found, pa.list_(pa.float64()))], [*names, "logs"])

    return score


def _normal(logs: Column) -> Column:
    """Probabilities in proportion to the exponentials."""
    raised = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def evidence_of_pages(pages: DataFrame) -> DataFrame:
    """``(doc_id, page_id, text, markup, host, domain, suffix, declared)`` of pages."""
    html = F.coalesce("html", F.lit(""))
    declared = F.lower(F.regexp_extract(html, r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1))
    host = F.regexp_replace(host_of(F.col("url")), r":[0-9]*$", "")
    return pages.select(
        F.lit(None).cast("long").alias("doc_id"), "page_id", html.alias("text"), F.lit(True).alias("markup"),
        host.alias("host"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"),
        F.regexp_extract(host, r"\.([^.]+)$", 1).alias("suffix"), declared.alias("declared"))


def evidence_of_documents(docs: DataFrame) -> DataFrame:
    """The same of documents, whose source stands for the host; they declare nothing and have no address."""
    none = F.lit("")
    source = F.coalesce(F.concat(F.lit("source "), F.col("source")), none)
    return docs.select(
        "doc_id", F.lit(None).cast("long").alias("page_id"), F.coalesce("text", none).alias("text"),
        F.lit(False).alias("markup"), source.alias("host"), none.alias("domain"), none.alias("suffix"),
        none.alias("declared"))


def identify(items: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """``(doc_id, page_id, host, declared, by_text, language, probability)``."""
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in items.dtypes if name != "text")
    if not languages:
        nothing = F.lit(None).cast("string")
        return items.select("doc_id", "page_id", "host", "declared", nothing.alias("by_text"), nothing.alias("language"),
                            F.lit(None).cast("double").alias("probability"))
    known = F.when(F.col("declared").isin(languages), F.col("declared")).otherwise(F.lit(""))
    step = items.mapInArrow(_likelihoods(table), f"{kinds}, logs array<double>").withColumn("known", known)
    step = checkpointed(step.withColumn("own", _normal(F.col("logs"))))
    every = range(len(languages))

    def sums(frame, keys, column, output):
        parts = frame.groupBy(*keys).agg(*[F.sum(F.get(column, F.lit(i))).alias(f"_{i}") for i in every])
        return parts.select(*keys, F.array(*[F.col(f"_{i}") for i in every]).alias(output))

    hosts = sums(step, ["host", "domain", "suffix"], "own", "host_sum")
    domains = sums(hosts, ["domain", "suffix"], "host_sum", "domain_sum")
    suffixes = sums(domains, ["suffix"], "domain_sum", "suffix_sum")
    # One number for each language, and one row for each known one.
    whole = sums(suffixes, [], "suffix_sum", "all_sum").first()["all_sum"]
    all_sum = F.array(*[F.lit(float(n or 0)) for n in whole])
    declared = F.broadcast(sums(step, ["known"], "own", "declared_sum"))
    priors = hosts.join(domains, ["domain", "suffix"]).join(suffixes, "suffix").select(
        "host", "host_sum", "domain_sum", "suffix_sum")
    step = step.join(declared, "known").join(priors, "host").withColumn("all_sum", all_sum)

    def size(sums_):
        return F.aggregate(sums_, F.lit(0.0), lambda a, b: a + b)

    step = step.withColumns({
        "n_host": size("host_sum"), "n_domain": size("domain_sum"), "n_all": size("all_sum"),
        "n_suffix": size("suffix_sum"), "n_declared": size("declared_sum")})
    terms = []
    for i in every:
        own, all_ = F.get("own", F.lit(i)), F.get("all_sum", F.lit(i))
        base = (all_ + 1) / (F.col("n_all") + len(languages))
        domain = F.when(F.col("domain") == "", base).otherwise(
            (F.get("domain_sum", F.lit(i)) + DOMAIN_STRENGTH * base) / (F.col("n_domain") + DOMAIN_STRENGTH))
        others = F.greatest(F.get("host_sum", F.lit(i)) - own, F.lit(0.0))
        host = F.when(F.col("host") == "", base).otherwise(
            (others + HOST_STRENGTH * domain) / (F.greatest(F.col("n_host") - 1, F.lit(0.0)) + HOST_STRENGTH))

        def likelihood(part, n_part, strength):
            # Of the evidence given the language, against the evidence at large.
            return (part + strength * base) / (n_part + strength) / base

        suffix = F.when(F.col("suffix") == "", F.lit(1.0)).otherwise(
            likelihood(F.get("suffix_sum", F.lit(i)), F.col("n_suffix"), SUFFIX_STRENGTH))
        said = F.when(F.col("known") == "", F.lit(1.0)).otherwise(
            likelihood(F.greatest(F.get("declared_sum", F.lit(i)) - own, F.lit(0.0)), F.col("n_declared"), DECLARED_STRENGTH))
        terms.append(F.get("logs", F.lit(i)) + F.log(host) + F.log(suffix) + F.log(said))
    names = F.array(*[F.lit(language) for language in languages])
    step = step.withColumn("logs_all", F.array(*terms)).withColumn("posterior", _normal(F.col("logs_all")))

    def best(values):
        return F.get(names, F.array_position(values, F.array_max(values)).cast("int") - 1)

    return step.select(
        "doc_id", "page_id", "host", "declared", best(F.col("own")).alias("by_text"),
        best(F.col("posterior")).alias("language"), F.round(F.array_max("posterior"), 6).alias("probability"))


def digest(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """The language of every page and of every document."""
    languages, table = fit(docs.select("doc_id", "lang", "text"))
    items = evidence_of_pages(pages).unionByName(evidence_of_documents(docs))
    return identify(items, languages, table)
