"""Long tokens, tags and lists of spans, rare languages, and many rows of one id."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tallygrid.llm import language, pii, weak_labels

from . import plain

GOOD = "The river runs past the old mill and the children play near the water until the evening comes to the valley. "


def spans(spark, text):
    return pii.digest(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()


@pytest.mark.parametrize("size", [20, 200, 201, 1000, 5000])
def test_tokens_of_any_length(spark, size):
    token = ("Ab1c2D3e" * size)[:size]
    found = spans(spark, f"the api_key token: {token} was set")
    assert found.spans == f"secret:19:{19 + size}" and found.n_spans == 1


def test_many_spans_in_one_text(spark):
    def took(n):
        text = " ".join(f"a{i}@b{i}.example.org" for i in range(n))
        began = time.perf_counter()
        row = spans(spark, text)
        return time.perf_counter() - began, row, text

    took(10)
    short, _, _ = took(8_000)
    long, row, text = took(32_000)
    counts, digest, listed = plain.personal(text)
    assert row.n_email == counts[0] == 32_000 and row.base_sha256 == digest
    assert long < 8 * short


@pytest.mark.parametrize("n", [1, 255, 256, 257, 513])
def test_spans_at_the_edges_of_blocks(spark, n):
    text = "é " + " ".join(f"u{i}@x.de 4111 1111 1111 1111, 10.0.0.{i % 256}" for i in range(n))
    row = spans(spark, text)
    assert row.base_sha256 == plain.personal(text)[1]


@pytest.mark.parametrize("size", [0, 400, 600, 2000])
def test_language_declared_far_inside_the_tag(spark, size):
    html = f'<html class="{"x" * size}" lang="fr"><body>un deux</body></html><p lang="de">'
    frame = spark.createDataFrame([(1, "https://a.example/", html), (2, None, "<html><p lang='de'>")], "page_id bigint, url string, html string")
    assert [r.declared for r in language.evidence_of_pages(frame).orderBy("page_id").collect()] == ["fr", ""]


def test_a_rare_language_is_learned(spark):
    rng = random.Random(1)
    words = {"xx": "zork vlim quag brul".split(), "yy": "miala oreani utesi lapora".split()}
    rows = [(i, " ".join(rng.choice(words["yy" if i % 500 == 0 else "xx"]) for _ in range(30)), "yy" if i % 500 == 0 else "xx")
            for i in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    languages, table = language.fit(frame, 40)
    assert languages == ["xx", "yy"] and table.shape[0] == 2
    # Both have rows: a language without any would have the same likelihood everywhere.
    assert all(len(set(row.tolist())) > 3 for row in table)


@pytest.mark.parametrize("doc_id", [None, 7])
def test_many_rows_of_one_id(spark, doc_id):
    texts = F.concat(F.lit(GOOD * 3), F.lit("Line "), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, " !!! ### $$$ BUY").otherwise("."))
    frame = spark.range(60_000).select(F.lit(doc_id).cast("bigint").alias("doc_id"), texts.alias("text"))
    found = weak_labels.digest(frame)
    assert found.count() == 60_000
    low, high = found.agg(F.min("score"), F.max("score")).first()
    assert 0 <= low <= high <= 1
    same = weak_labels.digest(spark.range(30_000).select(F.lit(doc_id).cast("bigint").alias("doc_id"), F.lit(GOOD).alias("text")))
    assert same.select("score").distinct().count() == 1


def test_scores_agree_with_those_of_a_finished_fit(spark):
    """Votes and posteriors of few documents, recomputed plainly by the same equations."""
    rows = [(i, (GOOD * 4 if i % 2 else "BUY $$$ ### NOW !!! " * 20) + str(i)) for i in range(200)]
    voted = weak_labels.with_votes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    patterns = [r.pattern for r in voted.collect()]
    found = {r.pattern: r.posterior for r in weak_labels.posteriors(voted.select("pattern")).collect()}
    kinds = sorted(set(patterns))
    assert set(found) == set(kinds)
    good = {r.pattern for r in voted.where("doc_id % 2 = 1").collect()}
    assert min(found[p] for p in good) > max(found[p] for p in kinds if p not in good)
