"""Fill-in-the-middle: a text is cut into prefix, middle and suffix, which are put in another order between markers.

A pattern of one unit, a code point unless the caller gives another (a line, a word with its white space), is matched as
``(unit)*`` over the whole text. The one match keeps every repetition: the ends of its group are as many as there are units,
and each end is a place to cut at. Nothing is counted unit by unit.

The cuts, and whether and how a text is turned, follow from a digest of seed and ``doc_id``, so reruns agree and rows of
equal id are cut by the same numbers. ``restored`` undoes the transformation from the output and its form alone: a text that holds
a marker itself stays as it is, so the first marker of each kind in an output is the one that was put there.

Defined results: null stands for the empty text, which stays ``plain``; a null ``doc_id`` is hashed as an empty text; a
text that does not wholly consist of units (never so with code points) stays ``plain``; repeated rows get equal results; no
rows give no rows; other columns play no part and may have any name. Texts have no length limit: a task holds one text
and the ends of its units.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tasks get this module's functions with the job; executors need not have the library installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The markers, and the shares of texts that stay plain and of others that begin with the suffix.
PREFIX, SUFFIX, MIDDLE = MARKERS = ("<P>", "<S>", "<M>")
PLAIN_FROM, SUFFIX_FIRST_BELOW = 90, 20
SEED = 1
CODE_POINT = r"(?s:.)"
# Units for cutting between lines or words.
LINE, WORD = r"[^\n]*+\n|[^\n]++", r"\S++\s*+|\s++"
FIELDS = ("n", "form", "prefix", "middle", "suffix", "output")


@dataclass(frozen=True)
class Cut:
    """``n`` units; prefix, middle and suffix are null where the form is ``plain``."""

    n: int
    form: str
    output: str
    prefix: str | None = None
    middle: str | None = None
    suffix: str | None = None


def numbers(doc_id, seed: int = SEED) -> list[int]:
    """Four numbers below 2**32 of a document."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[at:at + 8], 16) for at in range(0, 32, 8)]


def unit_pattern(unit: str = CODE_POINT):
    return regex.compile(f"({unit})*")


def cut(text: str | None, doc_id, pattern=None, seed: int = SEED) -> Cut:
    """The text cut and put together anew."""
    text = text or ""
    match = (pattern or unit_pattern()).fullmatch(text)
    ends = match.ends(1) if match else []
    # An empty text has no repetition, and no end.
    n, (h1, h2, h3, h4) = len(ends), numbers(doc_id, seed)
    if not n or h3 % 100 >= PLAIN_FROM or any(marker in text for marker in MARKERS):
        return Cut(n, "plain", text)
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[units - 1] if units else 0 for units in (first, last))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SUFFIX_FIRST_BELOW:
        return Cut(n, "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", prefix, middle, suffix)
    return Cut(n, "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", prefix, middle, suffix)


def restored(output: str, form: str) -> str:
    """The text from which an output was made."""
    if form == "plain":
        return output
    one, other = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    first, rest = output.removeprefix(one).split(other, 1)
    second, middle = rest.split(MIDDLE, 1)
    return first + middle + second if form == "psm" else second + middle + first


def _cut(unit: str, seed: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = unit_pattern(unit)
        for batch in batches:
            rows = batch.column("row")
            found = [cut(text.as_py(), doc_id.as_py(), pattern, seed)
                     for doc_id, text in zip(rows.field("doc_id"), rows.field("text"))]
            columns = [pa.array([getattr(c, name) for c in found], pa.int64() if name == "n" else pa.string()) for name in FIELDS]
            yield pa.RecordBatch.from_arrays([rows, *columns], ["row", *FIELDS])

    return made


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [restored(o.as_py(), f.as_py()) for o, f in zip(batch.column("output"), batch.column("form"))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "restored"])


def _with(schema: T.StructType, **kinds: T.DataType) -> T.StructType:
    return T.StructType([*schema, *[T.StructField(name, kind) for name, kind in kinds.items()]])


def transformed(docs: DataFrame, unit: str = CODE_POINT, seed: int = SEED) -> DataFrame:
    """``(row, n, form, prefix, middle, suffix, output)``: ``row`` holds the columns of the input."""
    rows = docs.select(F.struct("*").alias("row"))
    kinds = {name: T.LongType() if name == "n" else T.StringType() for name in FIELDS}
    return rows.mapInArrow(_cut(unit, seed), _with(rows.schema, **kinds))


def with_restored(outputs: DataFrame) -> DataFrame:
    """The rows, which have ``output`` and ``form``, and ``restored``, the text that their output was made from."""
    return outputs.mapInArrow(_restored, _with(outputs.schema, restored=T.StringType()))


def digest(docs: DataFrame) -> DataFrame:
    found = with_restored(transformed(docs.select("doc_id", "text")).select(
        "row.doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"),
        F.char_length("middle").cast("long").alias("middle_chars"), "output"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"))
