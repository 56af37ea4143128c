"""The pipeline's stages against plain versions, each on its own input."""

import __spark_entry__ as entry
import corpus_pipeline
from tallygrid.llm.common import table, written

from . import plain

DIRECTORY = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DIRECTORY, "documents")
    columns = docs.columns
    items = [tuple(r) for r in table(spark, DIRECTORY, "benchmark").select("item_id", "text").collect()]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = before = docs.collect()
        docs = written(stage(spark, docs, DIRECTORY), name)
        after = docs.collect()
        ids = [r.doc_id for r in after]
        if name == "quality":
            failed = {r.doc_id for r in before if plain.line_rules(r.text)[-1]}
            assert not failed & set(ids) and len(ids) > len(before) / 2
        if name == "near_duplicates":
            rows = sorted((r.doc_id, r.text) for r in before)
            found = plain.components([plain.fingerprint(text) for _, text in rows])
            assert sorted(ids) == sorted(rows[i][0] for i in set(found))
        if name == "decontamination":
            assert sorted(ids) == sorted(r.doc_id for r in before if not plain.decontaminated(r.text, items)[-1])
        if name == "mixture":
            assert set(ids) <= {r.doc_id for r in before} and max(ids.count(i) for i in set(ids)) <= 2
        if name == "sharding":
            assert sorted(ids) == sorted(r.doc_id for r in before)
        else:
            assert docs.columns == columns
    assert after


def test_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1


def test_stages_of_odd_and_of_no_rows(spark):
    """Null and equal ids, null texts and sources, and columns named as those of the stages."""
    clean = "The river runs past the old mill, and the children play near the water until the evening comes. "
    texts = [None, "", clean * 6, clean * 6, *[f"{clean * 5} Number {i} adds a line of its own, as every house does." for i in range(9)]]
    rows = [(None if i % 3 == 0 else i // 2, text, None, [None, "a", "row"][i % 3], 1, "x", 2, 3, True)
            for i, text in enumerate(texts)]
    kinds = ("doc_id bigint, text string, lang string, source string, n_chars bigint, row string, size bigint, shard int, "
             "kept boolean")
    odd = spark.createDataFrame(rows, kinds)
    for docs in (odd, odd.limit(0)):
        left = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, DIRECTORY), name)
            assert docs.columns == odd.columns
            assert docs.count() <= (2 if name == "mixture" else 1) * left
            left = docs.count()
        assert written(corpus_pipeline.STAGES[-1][1](spark, docs, DIRECTORY), "sharding").count() == left


def test_run_gives_the_same_twice(spark):
    first, second = (sorted(map(repr, corpus_pipeline.run(spark, DIRECTORY).collect())) for _ in range(2))
    assert first and first == second
