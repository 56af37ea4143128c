"""Fill-in-the-middle: exact round trips and plain cuts."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallygrid.llm import fill_middle

TEXTS = st.text(alphabet=st.sampled_from("ab \n<>PSM😀é"), max_size=40)


def plain(doc_id, text):
    text = text or ""
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    if h4 % 100 < 20:
        return (doc_id, n, "spm", a, b - a, sha(f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"), sha(text))
    return (doc_id, n, "psm", a, b - a, sha(f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"), sha(text))


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(0, 10**6), st.sampled_from([fill_middle.CODE_POINT, fill_middle.LINE, fill_middle.WORD]))
def test_round_trip(text, doc_id, unit):
    cut = fill_middle.cut(text, doc_id, fill_middle.unit_pattern(unit))
    assert fill_middle.restored(cut.output, cut.form) == text
    if cut.form != "plain":
        assert cut.prefix + cut.middle + cut.suffix == text


def test_digest_against_plain_cuts(spark):
    texts = [None, "", "a", "\n", "é😀x" * 50, "with <S> inside", "<", "a<P", "x\r\ny" * 3000, "w " * 200_000]
    rows = [(i, text, "row") for i, text in enumerate(texts * 12)] + [(None, "no id", "row"), (3, "again", "row"), (3, "again", "row")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, output string")
    found = sorted((tuple(r) for r in fill_middle.digest(frame).collect()), key=repr)
    assert found == sorted((plain(i, text) for i, text, _ in rows), key=repr)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}
    assert fill_middle.digest(frame.limit(0)).count() == 0


@pytest.mark.parametrize("unit, ends", [(fill_middle.LINE, "\n"), (fill_middle.WORD, " ")])
def test_cuts_lie_between_units(spark, unit, ends):
    text = "one two\n" * 30
    frame = spark.createDataFrame([(i, text) for i in range(40)], "doc_id bigint, text string")
    cuts = [r for r in fill_middle.transformed(frame, unit).collect() if r.form != "plain"]
    assert cuts and all(r.prefix == "" or r.prefix[-1] in f"\n{ends}" for r in cuts)
    assert all(r.n == (30 if ends == "\n" else 60) for r in cuts)


def test_texts_that_are_not_of_units_stay():
    assert fill_middle.cut("abc", 5, fill_middle.unit_pattern("[ab]")).form == "plain"
