"""The operators against plain versions, on hand-made texts and on the smallest tables."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallygrid.llm import (
    decontaminate, language, licences, line_rules, mixing, packing, pii, simhash, url_filter, weak_labels,
)
from tallygrid.llm.common import table

from . import plain

DIRECTORY = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, row string, shard int"
CLEAN = ("The river runs past the old mill and the children play near the water. " * 1
         + "Later in the day a cart brings flour to the town, and people talk about the weather before supper.\n"
         + "Nobody in the valley remembers when the bridge was built, but every family has a tale about the flood that "
         + "took the first one away many winters ago.")
ODD = [
    None, "", " \t\n", "a", "A b", "a b c", "same same same same same", "É Été ÉTÉ x", CLEAN, CLEAN, CLEAN + " once more",
    "x\n\nx\n x\ny", "mail A.b@c.de_f@g.hi me@x 1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 call +1 (017) 555-7713 or +49-30", "a+1(((" + "(" * 50,
    "𝒳 zoë@exämple.com 😀 a@b.co 4111111111111111", "9" * 40 + "." + "8" * 30, " | ".join(["menu"] * 70),
    " ".join(["LOUD!!"] * 60), "w" * 5000, " ".join(str(i) for i in range(3000)), "x@" * 200 + "y.z",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, text, None, [None, "b", "a", "ä"][i % 4], None, 7, "r", 1) for i, text in enumerate(ODD)]
    rows += [(None, CLEAN, "en", None, 1, 7, "r", 1), (8, CLEAN, None, "a", None, 7, "r", 1), (8, CLEAN, None, "a", None, 7, "r", 1)]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="module")
def given_docs(spark):
    return table(spark, DIRECTORY, "documents")


def both(frame, docs, of):
    """The rows of the frame, and what ``of`` says of each document's text, as sorted lists."""
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    order = lambda rows: sorted(rows, key=repr)
    return order(tuple(r) for r in frame.collect()), order((i, *of(text)) for i, text in texts)


def test_line_rules(docs, given_docs):
    for frame in (docs, given_docs):
        found = line_rules.digest(frame).drop("kept", "lost_chars")
        mine, theirs = both(found, frame, plain.line_rules)
        assert mine == theirs


def test_line_rules_keep_clean_and_drop_noise(spark):
    rows = [(1, CLEAN), (2, ODD[17]), (3, ODD[18]), (4, CLEAN + "\n" + "\n".join(["Home | About | Contact | Help"] * 12))]
    kept = {r.doc_id: r.kept for r in line_rules.digest(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False}


def test_cleaned_text_has_lost_its_bad_lines(spark):
    frame = spark.createDataFrame([("Good line of prose.\nHome | About | Help\nAnother line.",)], "text string")
    assert frame.select(line_rules.clean_text(F.col("text"))).first()[0] == "Good line of prose.\nAnother line."


def test_kept_rows_have_all_columns(docs):
    kept = line_rules.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {None, 8, 9, 10}


def test_decontamination(spark, docs, given_docs):
    items = [(1, CLEAN[20:200]), (2, "a b c"), (2, "menu menu"), (None, "été"), (5, ""), (6, None), (7, CLEAN[20:200]),
             (8, " ".join(str(i) for i in range(100, 140)))]
    made = spark.createDataFrame(items, "item_id bigint, text string")
    given_items = table(spark, DIRECTORY, "benchmark")
    for frame, bench in ((docs, made), (given_docs, given_items)):
        rows = [tuple(r) for r in bench.select("item_id", "text").collect()]
        mine, theirs = both(decontaminate.digest(frame, bench), frame, lambda text: plain.decontaminated(text, rows))
        assert mine == theirs
        assert any(row[-1] for row in mine)


def test_decontamination_in_blocks_gives_the_same(spark, docs, given_docs):
    bench = table(spark, DIRECTORY, "benchmark")
    whole = decontaminate.judge(given_docs, bench).select("row.doc_id", "n_hit", "items")
    parts = decontaminate.judge(given_docs, bench, entries=60).select("row.doc_id", "n_hit", "items")
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, parts.collect()))


def test_decontamination_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.digest(docs, none).filter("contaminated").count() == 0
    assert decontaminate.drop_contaminated(docs, none).count() == docs.count()


def test_words_of_hits_are_taken_out(spark):
    docs = spark.createDataFrame([(1, "one two three four")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "two three")], "item_id bigint, text string")
    assert decontaminate.without_spans(docs, bench).first().words == ["one", "four"]


def test_fingerprints_and_components(docs, given_docs):
    for frame in (docs.filter("doc_id is not null"), given_docs):
        rows = sorted((r.doc_id, r.text) for r in frame.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect())
        prints = [plain.fingerprint(text) for _, text in rows]
        expected = sorted((i, f"{p:016x}", rows[c][0]) for (i, _), p, c in zip(rows, prints, plain.components(prints)))
        assert sorted(tuple(r) for r in simhash.digest(frame).collect()) == expected


def points_near(seed, centres, n, flips):
    rng = random.Random(seed)
    found = set()
    for _ in range(centres):
        centre = rng.getrandbits(64)
        for _ in range(n):
            point = centre
            for _ in range(rng.randrange(flips + 1)):
                point ^= 1 << rng.randrange(64)
            found.add(point)
    return sorted(found)


@pytest.mark.parametrize("centres, n, flips", [(1, 300, 3), (40, 10, 4), (1, 400, 7), (300, 1, 0)])
def test_links_of_the_index_are_those_of_all_pairs(spark, centres, n, flips):
    points = points_near(centres + n, centres, n, flips)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    frame = spark.createDataFrame([(p,) for p in signed], "fingerprint bigint")
    from tallygrid.llm.components import labelled

    labels = {r.node: r.label for r in labelled(simhash.links_of(frame)).collect()}
    groups = {}
    for p, c in zip(signed, plain.components(points)):
        groups.setdefault(c, []).append(p)
    assert {p: min(g) for g in groups.values() if len(g) > 1 for p in g} == labels


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 5), st.integers(1, 60), st.integers(0, 6))
def test_tree_walk_finds_the_components(seed, centres, n, flips):
    points = points_near(seed, centres, n, flips)

    def rank(x):
        for shift in (32, 16, 8, 4, 2, 1):
            x ^= x >> shift
        return x

    ordered = sorted(points, key=rank)
    linked, roots = simhash.spanning_links(np.array(ordered, np.uint64), fanout=3, chunk=50)
    found = dict(zip(linked.tolist(), roots.tolist()))
    assert [found.get(i, i) for i in range(len(ordered))] == plain.components(ordered)


def test_long_chains_are_one_component(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1002, 1001), (5, 5)]
    from tallygrid.llm.components import labelled

    labels = {r.node: r.label for r in labelled(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert labels == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000, 1002: 1000}


def test_all_but_one_of_near_fingerprints_go(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    texts = [[rng.choice(words) for _ in range(300)] for _ in range(60)]
    near = [[*t[:k], "changed", *t[k + 1:]] for t in texts for k in [rng.randrange(300)]]
    rows = list(enumerate(" ".join(t) for t in texts + near + texts[:7]))
    found = plain.components([plain.fingerprint(text) for _, text in rows])
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == set(found) and 60 <= len(kept) < 120


def test_one_row_of_each_component_stays(docs):
    kept = simhash.one_of_each(docs)
    rows = kept.collect()
    assert kept.columns == docs.columns
    assert sum(r.text == CLEAN for r in rows) == 1 and sum((r.text or "").strip() == "" for r in rows) == 1
    assert min(r.doc_id for r in rows if r.text == CLEAN) == 8


def test_personal_data(docs, given_docs):
    for frame in (docs, given_docs):
        rows = pii.digest(frame).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
        mine, theirs = both(rows, frame, lambda text: (*plain.personal(text)[0], plain.personal(text)[1]))
        assert mine == theirs
    assert sum(r.n_email + r.n_card for r in pii.digest(docs).collect()) > 5


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("a@.-+ 0123456789_é", max_size=60), min_size=1, max_size=40))
def test_personal_data_of_any_text(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = pii.digest(frame).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    mine, theirs = both(rows, frame, lambda text: (*plain.personal(text)[0], plain.personal(text)[1]))
    assert mine == theirs


def test_added_kinds_need_checksum_or_context(spark):
    texts = ["pay to GB82 WEST 1234 5698 7654 32 now", "pay to GB83 WEST 1234 5698 7654 32 now", "ssn 123-45-6789",
             "part number 123-45-6789", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "sha1 04dbebab91ab85687d33eeaaf9ac699e"]
    found = [r.spans for r in pii.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()]
    assert [re.sub(":.*", "", f) for f in found] == ["iban", "", "ssn", "", "secret", ""]
    masked = pii.masked(spark.createDataFrame([(1, "to a@b.co now")], "doc_id bigint, text string")).first().text
    assert masked == "to [EMAIL] now"


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "http://example.com/en/2", "http://a.b.com",
            "http://x.net/es/", "http://net/fr/a", "http://xnet/fr/", "http://spam-x.org/a/?utm_source=1&b=2&a=1",
            "https://www.spam-x.org:443/a?a=1&b=2#z", "http://a.com?u=http://b.net/es/", "ftp://É.net/es"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.digest(pages).collect()}
    assert found == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"),
        4: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 5: ("example.com", "/en/2", "example.com/en/", "block"),
        6: ("a.b.com", "", None, "allow"), 7: ("x.net", "/es/", "net/es/", "block"), 8: ("net", "/fr/a", "net/fr/", "block"),
        9: ("xnet", "/fr/", None, "allow"), 10: ("spam-x.org", "/a/", None, "block"), 11: ("www.spam-x.org:443", "/a", None, "block"),
        12: ("a.com", "", None, "allow"), 13: ("É.net", "/es", None, "allow")}
    same = [url_filter.canonical(F.lit(urls[i])) for i in (10, 11)]
    assert len(set(pages.select(*[c.alias(str(i)) for i, c in enumerate(same)]).first())) == 1


def test_the_bloom_filter_passes_every_listed_url_and_few_others(spark):
    urls = spark.range(4000).select(F.concat(F.lit("h.org/"), "id").alias("canonical"))
    listed = urls.filter("canonical like '%7'")
    blocks = 400 * 16 // 256
    pages = urls.select(F.col("canonical").alias("page_id"), F.concat(F.lit("http://"), "canonical").alias("url"))
    judged = url_filter.judge(pages, listed)
    assert judged.filter("listed").count() == 400
    bloom = url_filter.bloom_filter(listed, blocks)
    hash_ = F.xxhash64("canonical")
    near = urls.select("canonical", url_filter._block(hash_, blocks).alias("block")).join(bloom, "block")
    for i, bit in enumerate(url_filter._bits(hash_)):
        near = near.filter(F.col(f"w{i}").bitwiseAND(bit) != 0)
    assert 400 <= near.count() < 500


def test_packing_laws(spark, docs, given_docs):
    for frame in (docs, given_docs, table(spark, "/root/testdata/sf0.01", "documents")):
        rows = packing.digest(frame).collect()
        texts = sorted((-1 if r.doc_id is None else r.doc_id, len((r.text or "").encode()) + 16, plain.crc32(r.text)) for r in frame.collect())
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in rows) == texts
        slots = {}
        for r in rows:
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
    sizes = np.bincount([r.shard for r in rows], weights=[r.size for r in rows], minlength=40)
    assert sizes.max() < 1.2 * sizes.mean() and sizes.min() > 0.8 * sizes.mean()


def test_packing_balances_three_measures_and_splits_a_hot_group(spark):
    rows = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot text")).otherwise(
            F.concat(F.lit("text "), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")), F.col("id").cast("string"))).alias("text"))
    found = packing.digest(rows).groupBy("shard").agg(F.sum("size"), F.sum("tokens"), F.count("*")).collect()
    for place in (1, 2, 3):
        sizes = [r[place] for r in found]
        assert len(sizes) == 40 and max(sizes) < 1.06 * sum(sizes) / 40


def test_shards_are_written_whole(docs, tmp_path):
    packing.write_shards(docs, str(tmp_path / "s"), 3)
    again = docs.sparkSession.read.parquet(str(tmp_path / "s"))
    assert again.count() == docs.count()


def plain_targets(sizes, share=1.5, most=2.0):
    weights = {s: [3, 1, 2][i % 3] for i, s in enumerate(sizes)}
    left, open_, found = share * sum(sizes.values()), list(sizes), {}
    while True:
        rate = left / sum(weights[s] for s in open_) if open_ else 0
        full = [s for s in open_ if rate * weights[s] > most * sizes[s]]
        if not full:
            return {**found, **{s: rate * weights[s] for s in open_}}
        for s in full:
            found[s] = most * sizes[s]
            left -= found[s]
            open_.remove(s)


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 20, None: 30}, {"a": 1, "b": 1000, "c": 5, "d": 7, "ä": 0, None: 40}, {"a": 0, "b": 0}, {"a": 5}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    expected = plain_targets(sizes)
    for row in mixing.targets(frame).collect():
        assert row.target == pytest.approx(expected[row.source])


def test_mixing(docs, given_docs):
    for frame in (docs, given_docs):
        rows = mixing.digest(frame).collect()
        assert rows and sorted(map(repr, rows)) == sorted(map(repr, mixing.digest(frame.repartition(5)).collect()))
        taken, targets = {}, {}
        for r in rows:
            key = (r.source_size, r.target)
            assert 0 <= r.taken <= 2 * r.size
            taken[key] = taken.get(key, 0) + r.taken
            targets[key] = r.target
        assert all(abs(taken[k] - targets[k]) < 1 + 1e-6 for k in taken)
        mixed = mixing.take(frame)
        assert mixed.columns == frame.columns and mixed.count() > 0


def test_visible_text():
    html = "<html lang=de><script>var a='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>Der <b>Hund</b></p> <!-- open"
    assert language.visible_text(html).split() == ["';", "Der", "Hund"] or language.visible_text(html).split() == ["Der", "Hund"]


def test_language_agrees_with_labels(spark):
    docs, pages = (table(spark, "/root/testdata/sf0.01", name) for name in ("documents", "pages"))
    found = language.digest(docs, pages)
    by_doc = found.filter("doc_id is not null").join(docs.select("doc_id", "lang"), "doc_id")
    right = by_doc.filter("language = lang").count() / docs.count()
    assert right > 0.95 and found.count() == docs.count() + pages.count()
    of_pages = found.filter("page_id is not null")
    assert of_pages.filter("language = declared").count() > 0.95 * pages.count()


def test_language_is_learned_apart_from_what_it_judges(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").filter("length(text) > 200")
    odd = F.pmod(F.xxhash64("text"), F.lit(2)) == 1
    languages, model = language.fit(docs.filter(odd))
    judged = language.identify(language.evidence_of_documents(docs.filter(~odd)), languages, model)
    joined = judged.join(docs.select("doc_id", "lang"), "doc_id")
    assert joined.filter("language = lang").count() > 0.95 * joined.count()


def test_language_evidence_beyond_the_text(spark):
    pages = [(i, f"http://a.example.de/{i}", "<html><body>und der die das ist nicht ein haus</body>") for i in range(30)]
    pages += [(50, "http://a.example.de/x", "<html><body></body>"), (51, None, None), (52, "", '<html lang="en-GB"> ')]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    docs = [(i, t, l, None) for i, (t, l) in enumerate([("und der die das ist nicht ein haus", "de"), ("the house is not of this town", "en")] * 5)]
    learned = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")
    found = {r.page_id: r.language for r in language.digest(learned, frame).filter("page_id is not null").collect()}
    assert found[50] == "de" and found[0] == "de" and found[51] in ("de", "en")


def test_language_without_labels_or_rows(spark, docs):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert language.digest(docs.filter("false"), pages).count() == 0
    unlabelled = docs.filter("lang is null")
    assert language.digest(unlabelled, pages).filter("language is not null").count() == 0


def test_licences(spark):
    texts = [None, "", CLEAN, "Words before. Released under the MIT License. Words after.", "Licensed under the Apache License, Version 2.0.",
             "Copyright (c) 2020 Somebody. All rights reserved.", "Licensed under CC BY-NC 4.0.\nAll rights reserved.",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
             "documentation files (the \"Software\"), to deal in the Software without restriction.\nThe above copyright notice and "
             "this permission notice shall be included in all copies or substantial portions of the Software.",
             "This work is licensed under the GNU General Public License, version 3.", "A license to laugh."]
    rows = licences.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [(r.licences, r["class"]) for r in rows] == [
        ("", "none"), ("", "none"), ("", "none"), ("MIT", "permissive"), ("Apache-2.0", "permissive"), ("proprietary", "restricted"),
        ("CC-BY-NC-4.0,proprietary", "restricted"), ("MIT", "permissive"), ("GPL-3.0", "copyleft"), ("", "none")]


def test_the_gate_lets_every_known_sentence_through():
    for texts in licences.SENTENCES.values():
        for text in texts:
            assert re.search(licences.GATE, text), text


def test_estimated_accuracies_find_the_truth():
    rng = np.random.default_rng(3)
    truth = rng.random(20000) < 0.8
    accuracy = [0.95, 0.8, 0.7, 0.9, 0.6]
    votes = np.array([np.where(rng.random(20000) < a, truth, ~truth) for a in accuracy]).T
    patterns = ["".join("1" if v else "0" for v in row) for row in votes]
    names, counts = np.unique(patterns, return_counts=True)
    p = dict(zip(names, weak_labels.estimate(list(names), counts.tolist())))
    guessed = np.array([p[x] > 0.5 for x in patterns])
    assert (guessed == truth).mean() > 0.94


def test_quality_scores_agree_with_labels(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", name) for name in ("documents", "labels"))
    joined = weak_labels.digest(docs).join(labels, "doc_id").collect()
    good = [r.kept for r in joined if r.quality == 1]
    bad = [r.kept for r in joined if r.quality == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.2


def test_odd_rows_have_results_everywhere(spark, docs):
    n = docs.count()
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html"))
    for found in (weak_labels.digest(docs), licences.digest(docs), packing.digest(docs), mixing.digest(docs), simhash.digest(docs)):
        assert found.count() == n
    assert url_filter.digest(pages).count() == n
    assert language.digest(docs, pages).count() == 2 * n
    empty = docs.filter("false")
    for found in (
            weak_labels.digest(empty), licences.digest(empty), packing.digest(empty), mixing.digest(empty), simhash.digest(empty),
            line_rules.digest(empty), pii.digest(empty), url_filter.digest(pages.filter("false"))):
        assert found.count() == 0
