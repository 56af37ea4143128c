"""Repair of conversations against dynamic programming over costs and audits."""

import random

import pytest

from tallygrid.llm import auction, conversations
from tallygrid.llm.common import table

from . import plain_turns

DIRECTORY = "/root/testdata/sf0.001"
COLUMNS = "conv_id bigint, turn bigint, role string, text string, text2 string, copies int"


def made(seed, n):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        conv = rng.choice([1, 1, 1, 2, 3, None, None, *range(10, 100)])
        rows.append((
            conv, rng.choice([None, *range(40 if conv != 1 else 900)]),
            rng.choice(["user", "assistant", "assistant", "user", "system", None, "tool", ""]),
            rng.choice(["Hi.", "No", "yes!", " ", None, "", f"text {rng.randrange(500)}?", f"t{rng.randrange(99)}"])))
    return rows + [(2, 5, "user", "same.")] * 300


def frame_of(spark, rows):
    return spark.createDataFrame([(*row, "x", 1) for row in rows], COLUMNS)


def digests(frame):
    return sorted((tuple(r) for r in conversations.digest(frame).collect()), key=repr)


def test_given_table(spark):
    given = table(spark, DIRECTORY, "conversations")
    rows = [tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()]
    assert digests(given) == sorted(plain_turns.repaired(rows), key=repr)


@pytest.mark.parametrize("part_rows, tables, partitions", [(256, 16, 3), (7, 2, 12)])
def test_made_conversations_whole_and_in_parts(spark, setting, monkeypatch, part_rows, tables, partitions):
    monkeypatch.setattr(conversations, "PART_ROWS", part_rows)
    monkeypatch.setattr(conversations, "TABLES", tables)
    rows = made(part_rows, 1500)
    with setting(spark__sql__shuffle__partitions=str(partitions), spark__sql__adaptive__coalescePartitions__enabled="false"):
        assert digests(frame_of(spark, rows)) == sorted(plain_turns.repaired(rows), key=repr)


def test_dropped_and_no_rows(spark):
    lost = next(i for i in range(1000) if not list(plain_turns.damaged([(i, 0, "user", "x")])))
    assert digests(frame_of(spark, [(lost, 0, "user", "x")])) == plain_turns.repaired([(lost, 0, "user", "x")])
    assert digests(frame_of(spark, [(1, 1, "a", "b")]).limit(0)) == []


def test_long_texts(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"{i} " + "long text. " * 60_000) for i in range(20)]
    assert digests(frame_of(spark, rows)) == plain_turns.repaired(rows)


def test_repaired_rows(spark, setting, monkeypatch):
    monkeypatch.setattr(conversations, "PART_ROWS", 9)
    rows = made(3, 900)
    ids = {row[0] for row in rows}
    with setting(spark__sql__shuffle__partitions="5", spark__sql__adaptive__coalescePartitions__enabled="false"):
        found = sorted(map(tuple, conversations.repair(frame_of(spark, rows)).collect()), key=repr)
    plain = []
    for conv in ids:
        own = sorted(((*r[:2], " " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in rows if r[0] == conv),
                     key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        lines = plain_turns.cheapest(own, plain_turns.faults(own))[2]
        plain += [(conv, i, *line.split(":", 1)) for i, line in enumerate(lines)]
    assert found == sorted(plain, key=repr)


def test_auction_against_all_paths():
    rng = random.Random(5)
    for _ in range(1500):
        letters = rng.choice(["suaoxSUAO", "uaua", "uuax", "usa", "uaUAx"])
        code = "".join(rng.choice(letters) for _ in range(rng.randrange(14)))
        rows = [(1, i, {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "x"}[c.lower()], f"{i}") for i, c in enumerate(code)]
        found = ["duplicate" if c == "x" else "truncated" if c.isupper() else "" for c in code]
        assert auction.solved(code) == plain_turns.cheapest(rows, found)[:2]


def test_tables_agree_with_whole_sequences():
    rng = random.Random(9)
    for n in (1, 63, 64, 65, 200):
        code = "".join(rng.choice("uauaxsoUA") for _ in range(n))
        prices = [auction.table_of(code[:n // 3]), auction.table_of(code[n // 3:])]
        assert auction.of_parts(prices, auction.ENDS).entries()[0] == auction.solved(code)[0]
