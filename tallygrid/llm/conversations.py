"""Conversation structure repair: the cheapest edits that turn a conversation into an optional system row and pairs of user
and assistant rows, found by the auction algorithm of ``auction.py``.

Rows are sorted by conversation and turn across partitions, so a conversation of any length may lie in many. Within a
partition they are read one after the other; a conversation that begins and ends inside one is solved there. Of others,
and of those above ``PART_ROWS`` rows or ``PART_BYTES`` of text, each part gives the table of its prices from state to
state; the parts' tables, one row each, are auctioned from the last to the first in blocks; each part is then traced for
the states it may begin in, and the parts' traces are put together in order. So no task holds more than one part of a
conversation. What one task must see of a whole one is a row for each part, since a digest of the repaired text is made
in order.

Rows alike in all columns are counted before they are sorted, and what was seen earlier is found by partial aggregates, so
that neither a long conversation nor one text repeated in it is gathered anywhere.

Defined results: a null role or text stands as one blank; rows of equal turn are in order of role and text, nulls of turn
come first; a null ``conv_id`` is a conversation of its own; rows alike in all columns are duplicates of the first; any
role is judged by its first character; conversations of which all rows are dropped have zeros, an empty audit and the digest of the empty
text; no rows give no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import auction
from .common import written

# Tasks get these modules' functions with the job; executors need not have the library installed.
cloudpickle.register_pickle_by_value(auction)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The pairs of initials that may follow each other, and what damages are drawn by.
LEGAL = ("su", "ua", "au")
DAMAGES = 20
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
PART_ROWS, PART_BYTES = 256, 4 << 20
# Copies of one row that are one row of a partition.
COPIES = 128
# Characters of a text by which rows of one turn and role are dealt to partitions.
DEALT_CHARS = 64
# Parts whose tables are auctioned at once.
TABLES = 16

COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high")
PART = ("missing boolean, conv bigint, part bigint, place bigint, whole boolean, "
        + ", ".join(f"{name} bigint" for name in COUNTS)
        + ", cost bigint, audit string, digest string, code string, head string, tail string, "
          "roles array<string>, texts array<string>")
RESULT = ("missing boolean, conv bigint, " + ", ".join(f"{name} bigint" for name in COUNTS)
          + ", cost bigint, audit string, digest string")
LINES = "audit string, roles array<string>, texts array<string>"


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copies)`` of all rows; those that are dropped have null role and text and no copies."""
    words = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    draw = F.pmod(F.crc32(F.concat(words[0], F.lit(":"), words[1]).cast("binary")), F.lit(DAMAGES))
    step = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        draw.alias("draw"))
    there = F.col("draw") != 0
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return step.select(
        "conv_id", F.when(there, F.col("turn")).alias("turn"),
        F.when(there, F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))).alias("role"),
        F.when(there, text).alias("text"),
        F.when(there, F.when(F.col("draw") == 3, 2).otherwise(1)).otherwise(0).cast("bigint").alias("copies"))


def _ordered(rows: DataFrame) -> DataFrame:
    """``(missing, conv, turn, role, text, copies, again)`` in order of conversation and turn over all partitions; of rows
    with many copies there are several, of which all but the first are ``again``, as those seen in an earlier turn."""
    keyed = rows.select(
        F.col("conv_id").isNull().alias("missing"), F.coalesce("conv_id", F.lit(0).cast("bigint")).alias("conv"), "turn",
        "role", "text", "copies")
    alike = keyed.groupBy("missing", "conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    # Texts of more than one turn, with the first of these.
    seen = keyed.filter("role is not null").groupBy("missing", "conv", "role", "text").agg(
        F.min("turn").alias("least"), F.max("turn").alias("most"),
        F.max(F.col("turn").isNull()).alias("unplaced")).filter("least <> most or unplaced and least is not null")
    found = alike.join(seen, ["missing", "conv", "role", "text"], "left").withColumn(
        "again", F.coalesce(F.col("turn").isNotNull() & (F.col("unplaced") | (F.col("turn") > F.col("least"))), F.lit(False)))
    pieces = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("copies") / COPIES), F.lit(1)).cast("bigint") - 1)
    found = found.withColumn("piece", F.explode(pieces)).withColumns({
        "copies": F.least(F.lit(COPIES), F.col("copies") - F.col("piece") * COPIES), "again": F.col("again") | (F.col("piece") > 0)})
    found = found.select("missing", "conv", "turn", "role", "text", "copies", "again", "piece")
    order = [F.col("missing"), F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first()]
    dealt = found.repartitionByRange(*order, F.left("text", F.lit(DEALT_CHARS)).asc_nulls_first(), "piece")
    return dealt.sortWithinPartitions(*order, F.col("text").asc_nulls_first(), "piece").drop("piece")


@dataclass
class Part:
    """Consecutive rows of a conversation."""

    missing: bool
    conv: int
    size: int = 0
    counts: dict = field(default_factory=lambda: {name: 0 for name in COUNTS} | {"low": None, "high": None})
    code: list = field(default_factory=list)
    head: str | None = None
    tail: str | None = None
    roles: list = field(default_factory=list)
    texts: list = field(default_factory=list)

    def add(self, turn, role, text, copies, again) -> None:
        counts, initial = self.counts, role[:1]
        if turn is not None:
            counts["turns"] += turn != counts["high"]
            counts["low"], counts["high"] = turn if counts["low"] is None else counts["low"], turn
        if self.tail is None:
            self.head = initial
        else:
            counts["illegal"] += self.tail + initial not in LEGAL
        counts["illegal"] += copies - 1
        self.tail = initial
        end = text.rstrip(BLANKS)[-1:]
        if not end:
            counts["blank"] += copies
            letters = "x" * copies
        elif again:
            counts["duplicate"] += copies
            letters = "x" * copies
        else:
            counts["duplicate"] += copies - 1
            letter = initial if initial in ("s", "u", "a") else "o"
            if end not in ENDS:
                counts["truncated"] += 1
                letter = letter.upper()
            letters = letter + "x" * (copies - 1)
            self.roles.append(role)
            self.texts.append(text)
            self.size += len(text)
        self.code.append(letters)

    def full(self) -> bool:
        return len(self.code) >= PART_ROWS or self.size >= PART_BYTES


def repaired(audit: str, code: str, roles: list, texts: list, entry: int = auction.START) -> tuple[list, list]:
    """Roles and texts of the rows that an audit leaves and puts in; ``roles`` and ``texts`` are of the rows that may stay."""
    found, rows, good, state = ([], []), iter(code), iter(zip(roles, texts)), entry
    for letter in audit:
        row = next(rows) if letter != "I" else None
        role, text = next(good) if row and row != "x" else (None, "")
        if letter == "D":
            continue
        follow = auction.NEXT[state]
        state = follow[row.lower()] if letter == "K" else auction.USER if auction.USER in follow.values() else auction.ASSISTANT
        found[0].append(role if letter == "K" else auction.ROLES[state])
        found[1].append(text)
    return found


def _line(roles: list, texts: list) -> str:
    return "\n".join(f"{role}:{text}" for role, text in zip(roles, texts))


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _records(rows: list[dict], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, kind)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"boolean": pa.bool_(), "bigint": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string()),
             "array<bigint>": pa.list_(pa.int64()), "int": pa.int32()}
    return pa.schema([(name, kinds[kind]) for name, kind in (column.split() for column in ddl.split(", "))])


def _parts(with_rows: bool):
    """Whole conversations solved, and parts of those that may go on elsewhere. With rows, whole ones keep their repaired
    rows, else only their digest."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, place, part, opened, held, kind = TaskContext.get().partitionId(), 0, None, True, [], _arrow(PART)

        def closed(more: bool) -> dict:
            """The part at hand as a row; ``more`` if its conversation may go on after it."""
            nonlocal place, opened
            whole, opened, place, code = not opened and not more, more, place + 1, "".join(part.code)
            row = {"missing": part.missing, "conv": part.conv, "part": number, "place": place, "whole": whole, **part.counts}
            if not whole:
                return row | {"code": code, "head": part.head, "tail": part.tail, "roles": part.roles, "texts": part.texts}
            cost, audit = auction.solved(code)
            roles, texts = repaired(audit, code, part.roles, part.texts)
            row |= {"cost": cost, "audit": audit, "digest": _digest(_line(roles, texts))}
            return row | ({"roles": roles, "texts": texts} if with_rows else {})

        for batch in batches:
            for missing, conv, turn, role, text, copies, again in zip(*[column.to_pylist() for column in batch.columns]):
                if part and (missing, conv) != (part.missing, part.conv):
                    held.append(closed(False))
                    part = None
                elif part and part.full():
                    held.append(closed(True))
                    part = None
                part = part or Part(missing, conv)
                if role is not None:
                    part.add(turn, role, text, copies, again)
                if len(held) >= PART_ROWS:
                    yield _records(held, kind)
                    held = []
        if part:
            held.append(closed(True))
        if held:
            yield _records(held, kind)

    return made


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tables = [auction.table_of(code.as_py()) for code in batch.column("code")]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(name) for name in ("missing", "conv", "part", "place")], pa.array(tables, pa.list_(pa.int64()))],
            ["missing", "conv", "part", "place", "table"])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part the prices of the states that it may end in, and of those that it may begin in. The parts of a
    conversation come from the last to the first."""
    kind = _arrow("part bigint, place bigint, exits array<bigint>, entries array<bigint>")
    conv, prices, block = None, auction.ENDS, []

    def auctioned() -> Iterator[pa.RecordBatch]:
        nonlocal prices
        lattice, rows = auction.of_parts([table for _, _, table in reversed(block)], prices), []
        for i, (part, place, _) in enumerate(block):
            entry = 4 * (len(block) - 1 - i)
            before = tuple(lattice.converge(entry + q) for q in auction.STATES)
            rows.append({"part": part, "place": place, "exits": prices, "entries": before})
            prices = before
        yield _records(rows, kind)

    for batch in batches:
        for missing, id_, part, place, table in zip(*[column.to_pylist() for column in batch.columns]):
            if block and ((missing, id_) != conv or len(block) == TABLES):
                yield from auctioned()
                block = []
            if (missing, id_) != conv:
                conv, prices = (missing, id_), auction.ENDS
            block.append((part, place, table))
    if block:
        yield from auctioned()


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part and each state that it may begin in: the state it ends in, the audit and the repaired rows."""
    kind = _arrow(TRACE)
    for batch in batches:
        for row in batch.to_pylist():
            shared = {name: row[name] for name in ("missing", "conv", "part", "place", *COUNTS, "head", "tail")}
            found = auction.traced(row["code"], tuple(row["exits"]), auction.STATES)
            rows = []
            for entry, trace in enumerate(found):
                if trace:
                    roles, texts = repaired(trace[0], row["code"], row["roles"], row["texts"], entry)
                    rows.append(shared | {
                        "entry": entry, "ends": trace[1], "cost": row["entries"][entry], "audit": trace[0], "roles": roles,
                        "texts": texts})
            yield _records(rows, kind)


TRACE = ("missing boolean, conv bigint, part bigint, place bigint, " + ", ".join(f"{name} bigint" for name in COUNTS)
         + ", head string, tail string, entry int, ends int, cost bigint, audit string, roles array<string>, texts array<string>")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The results of conversations whose parts' traces come in order."""
    kind, held, now, state, last, audit, hashed, any_ = _arrow(RESULT), [], None, 0, None, [], None, False

    def done() -> None:
        held.append(now | {"audit": "".join(audit), "digest": hashed.hexdigest()})

    for batch in batches:
        for row in batch.to_pylist():
            if now is None or (row["missing"], row["conv"]) != (now["missing"], now["conv"]):
                if now:
                    done()
                now = {name: row[name] for name in ("missing", "conv")} | {name: 0 for name in COUNTS}
                now |= {"low": None, "high": None, "cost": row["cost"]}
                state, place, last, audit, hashed, any_ = auction.START, None, None, [], hashlib.sha256(), False
            if (row["part"], row["place"]) == place or row["entry"] != state:
                continue
            place, state = (row["part"], row["place"]), row["ends"]
            for name in ("blank", "duplicate", "truncated", "illegal"):
                now[name] += row[name]
            if row["head"] is not None:
                now["illegal"] += last is not None and last + row["head"] not in LEGAL
                last = row["tail"]
            if row["low"] is not None:
                now["turns"] += row["turns"] - (row["low"] == now["high"])
                now["low"], now["high"] = row["low"] if now["low"] is None else now["low"], row["high"]
            audit.append(row["audit"])
            if row["roles"]:
                hashed.update(("\n" * any_ + _line(row["roles"], row["texts"])).encode())
                any_ = True
        if len(held) >= PART_ROWS:
            yield _records(held, kind)
            held = []
    if now:
        done()
    if held:
        yield _records(held, kind)


def _solved(rows: DataFrame, with_rows: bool) -> tuple[DataFrame, DataFrame]:
    """The parts, of which whole conversations are solved, and the traces of all others."""
    parts = written(_ordered(rows).mapInArrow(_parts(with_rows), PART), "conversations")
    others = parts.filter("not whole")
    tables = others.select("missing", "conv", "part", "place", "code").mapInArrow(
        _tables, "missing boolean, conv bigint, part bigint, place bigint, table array<bigint>")
    backwards = tables.repartition("missing", "conv").sortWithinPartitions(
        "missing", "conv", F.desc("part"), F.desc("place"))
    exits = backwards.mapInArrow(_exits, "part bigint, place bigint, exits array<bigint>, entries array<bigint>")
    return parts, others.join(exits, ["part", "place"]).mapInArrow(_traces, TRACE)


def audited(conversations: DataFrame) -> DataFrame:
    """``(conv_id, blank, duplicate, truncated, illegal, turns, low, high, cost, audit, digest)`` of each conversation of the
    rows ``(conv_id, turn, role, text, copies)``."""
    parts, traces = _solved(conversations, False)
    in_order = traces.repartition("missing", "conv").sortWithinPartitions("missing", "conv", "part", "place", "entry")
    names = [column.split()[0] for column in RESULT.split(", ")]
    found = parts.filter("whole").select(*names).union(in_order.mapInArrow(_joined, RESULT).select(*names))
    return found.select(F.when(~F.col("missing"), F.col("conv")).alias("conv_id"), *names[2:])


def as_rows(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copies)`` of rows as they are."""
    return conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        F.lit(1).cast("bigint").alias("copies"))


def repair(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)``: the repaired rows of all conversations, their turns counted from 0."""
    parts, traces = _solved(as_rows(conversations), True)
    columns = ["missing", "conv", "part", "place", "roles", "texts"]
    # Of a part's traces the one that begins where the part before it ends.
    steps = written(traces, "traces")
    chain = steps.select("missing", "conv", "part", "place", "entry", "ends").repartition("missing", "conv").sortWithinPartitions(
        "missing", "conv", "part", "place", "entry").mapInArrow(_chained, "part bigint, place bigint, entry int")
    lines = parts.filter("whole").select(*columns).union(steps.join(chain, ["part", "place", "entry"]).select(*columns))
    sizes = lines.select("missing", "conv", "part", "place", F.size("roles").alias("n"))
    # A row for each part of a conversation.
    ahead = Window.partitionBy("missing", "conv").orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("part", "place", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    opened = lines.join(before, ["part", "place"]).select(
        F.when(~F.col("missing"), F.col("conv")).alias("conv_id"), "before",
        F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "line"))
    return opened.select("conv_id", (F.col("before") + F.col("at")).alias("turn"), "line.roles", "line.texts").toDF(
        "conv_id", "turn", "role", "text")


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, conv, state, done = _arrow("part bigint, place bigint, entry int"), None, auction.START, None
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if (row["missing"], row["conv"]) != conv:
                conv, state, done = (row["missing"], row["conv"]), auction.START, None
            if (row["part"], row["place"]) != done and row["entry"] == state:
                done, state = (row["part"], row["place"]), row["ends"]
                rows.append({name: row[name] for name in ("part", "place", "entry")})
        yield _records(rows, kind)


def _gaps() -> Column:
    return F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")


def digest(conversations: DataFrame) -> DataFrame:
    return audited(damaged(conversations.select("conv_id", "turn", "role", "text"))).select(
        "conv_id", _gaps(), "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.col("digest").alias("repaired_sha256"))
