"""Passages taken out, against a plain version that looks at all windows."""

import random

import pytest
from pyspark.sql import functions as F

from tallygrid.llm import passages
from tallygrid.llm.common import table

from . import plain

DIRECTORY = "/root/testdata/sf0.001"


def found(frame, window=20):
    return sorted((tuple(r) for r in passages.deduplicated(frame, window).select(
        "row.doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()), key=repr)


def test_given_table(spark):
    docs = table(spark, DIRECTORY, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in passages.digest(docs).collect()) == sorted(plain.passages(rows))


@pytest.mark.parametrize("window, words, longest", [(20, 2, 300), (5, 3, 200), (20, 1, 120), (3, 2, 60), (50, 2, 400), (1, 5, 20)])
def test_made_texts_of_few_words(spark, window, words, longest):
    rng = random.Random(window)
    shared = [f"w{rng.randrange(words)}" for _ in range(400)]
    rows = []
    for i in range(25):
        a = rng.randrange(300)
        own = [f"w{rng.randrange(words)}" for _ in range(rng.randrange(longest))]
        rows.append((i, " ".join([*own, *shared[a:a + rng.randrange(90)], f"x{rng.randrange(9)}", *shared[a + 10:a + 70]])))
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string"), window) == sorted(plain.passages(rows, window), key=repr)


def test_any_two_positions_share_an_anchor():
    for period, cover in passages.COVERS.items():
        for apart in range(period):
            assert any((d + apart) % period in cover for d in cover)
    for window in range(1, 80):
        period = passages.period_of(window)
        assert 1 <= window - period + 1 <= window


def test_odd_rows(spark):
    base = [f"w{i}" for i in range(60)]
    long = " ".join(f"v{i % 70_001}" for i in range(200_000))
    rows = [(None, " ".join(base), 1, "k"), (4, " ".join(base), 1, "k"), (4, "\t\n".join(base), 2, "k"), (4, " ".join(base), 1, "k"),
            (5, None, 3, None), (6, "", 3, None), (7, " ".join(base[:19]), 3, None), (8, " ".join(base[:20]), 3, None),
            (9, long, 3, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, id int, key string")
    left = {}
    for r in passages.without_repeats(frame).collect():
        left.setdefault((r.doc_id, r.id), []).append(len((r.text or "").split()))
    # Of the two texts with id 4 one is the first; its repeated row is the same document.
    first, second = left[4, 1], left[4, 2]
    assert (first, second) in (([60, 60], [0]), ([0, 0], [60]))
    assert left[None, 1] == [0] and left[7, 3] == [19] and left[8, 3] == [0] and left[5, 3] == left[6, 3] == [0]
    assert left[9, 3] == [70_001]
    assert passages.without_repeats(frame).columns == frame.columns
    assert passages.digest(frame.limit(0)).count() == 0
