"""The place of the cut against a plain running sum, with rows of one id and rows alike."""

import hashlib
from fractions import Fraction

import pytest

from tallygrid.llm import mixing

SCHEMA = "doc_id bigint, source string, text string, key string, size string"


def plain_parts(rows, dealt):
    """Words taken of each row, by a running sum in order of the key."""
    found, by_source = [], {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    for source, members in by_source.items():
        budget = int(dealt[source])
        whole = sum(len((r[2] or "").split()) for r in members)
        epochs, left = divmod(budget, whole) if whole else (0, 0)
        hashed = sorted((hashlib.md5(f"{mixing.SEED}|{'null' if r[0] is None else r[0]}|{r[2] or ''}".encode()).hexdigest(), r)
                        for r in members)
        for _, row in hashed:
            size = len((row[2] or "").split())
            part = min(size, left)
            left -= part
            found.append((row[0], size, whole, epochs * size + part))
    return sorted(map(repr, found))


def made():
    words = [f"w{i}" for i in range(40)]
    rows = [(7, "hot", " ".join(words[: 1 + i % 37]) + f" v{i}", "x", "y") for i in range(300)]
    rows += [(i, ("hot", "b", "c", None)[i % 4], " ".join(words[: i % 23]), None, "") for i in range(400)]
    rows += [(None, "b", None, None, None), (5, "empty", "", None, None), (6, "empty", None, None, None)]
    return rows


def taken(frame):
    return mixing.mixed(frame).select("doc_id", "size", "source_size", "taken")


@pytest.mark.parametrize("few", [mixing.FEW_SOURCES, 0])
def test_cuts_like_running_sums(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    rows = made()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    dealt = {r.source: Fraction(r.target) for r in mixing.targets(
        mixing.keyed(frame).groupBy("source").sum("size").withColumnRenamed("sum(size)", "source_size")).collect()}
    found = sorted(repr((r.doc_id, r.size, r.source_size, r.taken)) for r in taken(frame).collect())
    assert found == plain_parts(rows, dealt)


def test_cut_among_rows_alike(spark):
    rows = [(1, "a", "one two three four five", None, None)] * 90 + [(2, "b", "x", None, None)] * 10
    found = taken(spark.createDataFrame(rows, SCHEMA)).collect()
    by_source = {n: [r.taken for r in found if r.source_size == n] for n in (450, 10)}
    # 1.5 × 460 words: "b" stops at 20, "a" gets the 670 left: one epoch and 44 rows more.
    assert sum(by_source[10]) == 20 and sum(by_source[450]) == 670
    assert sorted(set(by_source[450])) == [5, 10] and by_source[450].count(10) == 44


def test_one_id_is_spread(spark):
    frame = spark.range(20_000).selectExpr("if(id % 3 = 0, 5, id) AS doc_id", "'s' AS source", "concat('word ', id) AS text")
    ranges = mixing.keyed(frame).filter("doc_id = 5").selectExpr("substr(key, 1, 2) AS r").groupBy("r").count().collect()
    assert len(ranges) == 256 and max(r["count"] for r in ranges) < 80


def test_no_text_is_shuffled(spark):
    frame = spark.createDataFrame(made(), SCHEMA)
    plan = mixing.take(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 0


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mixed(empty).collect() == [] and mixing.take(empty).columns == empty.columns
