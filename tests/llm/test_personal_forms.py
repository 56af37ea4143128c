"""Cards within runs of digits, and keys of known forms."""

import re

from tallygrid.llm import pii

CARD = "4111 1111 1111 1111"


def found(spark, texts):
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    return {r.row.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in rows}


def plain_inner(text):
    """Each Luhn-valid number of a card's form within a longer run of digits."""
    spans = []
    for at in re.finditer(rf"(?<![0-9])(?=({pii.CARD_FORM})(?![0-9]))", text):
        start, end = at.start(1), at.end(1)
        digits = [int(d) for d in re.sub("[^0-9]", "", at.group(1))][::-1]
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits))
        longer = re.search(r"[0-9][ -]$", text[:start]) or re.match(r"[ -][0-9]", text[end:])
        if longer and total % 10 == 0:
            spans.append(("inner_card", start, end))
    return spans


def test_inner_cards(spark):
    texts = [
        f"{CARD} 123", f"pay by {CARD} 12/26 today", f"12 {CARD}", f"card 12-4111-1111-1111-1111-9 {CARD}", "4111111111111111 123",
        "é é 3782 822463 10005 77", f"order no {CARD} 123", f"{CARD}", "1234 5678 9012 3456 7", "1 22 333 " * 500,
        " ".join(["4111 1111 1111 1111"] * 30), "3" * 400, "", None, " ".join(f"{CARD} {i}, " for i in range(700))]
    rows = found(spark, texts)
    for i, text in enumerate(texts):
        inner = [s for s in rows[i] if s[0] == "inner_card"]
        assert inner == ([] if text and text.startswith("order no") else plain_inner(text or "")), text and text[:60]
    assert ("inner_card", 0, 19) in rows[0] and ("inner_card", 7, 26) in rows[1] and ("inner_card", 4, 21) in rows[5]
    assert rows[7] == [("card", 0, 19)] and sum(s[0] == "inner_card" for s in rows[14]) == 700


def test_keys_of_known_forms(spark):
    web_token = "eyJhbGciOi1.eyJzdWIiOiIx.c2lnbmF0dXJl_-9"
    keys = ["ghp_" + "aB3" * 12, "AKIA" + "Z9" * 8, "AIza" + "x" * 34 + "7", "xoxb-123456789012-abc", web_token]
    rows = found(spark, [f"see {key}, please" for key in keys] + ["AKIA is short", "eyJ1 . eyJ2 . x"])
    for i, key in enumerate(keys):
        assert ("key", 4, 4 + len(key)) in rows[i], key
    assert not rows[5] and not rows[6]
