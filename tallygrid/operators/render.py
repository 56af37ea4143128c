"""Grids as text and JSON: fixed-width and CSV tables, titles and headers, documents."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.axis import Axis
from ..functions.labels import date_label
from ..functions.periods import INTRADAY_STEP
from ..sources.model import Model
from .catalog import chosen
from .grids import Grid

# The layout of report tables, and the words of titles and headers.
LABEL_WIDTH = 22
NARROW, WIDE = 6, 11
HEAD_TEXT, HEAD_CSV = "Fecha:", "Fecha"
DEFAULT_SEPARATOR = ";"
# Entities of one piece of a document.
PIECE = 1000
PERIODS = ("mes", "anio", "dia", None)
QUANTITY = {"mes": "día", "anio": "mes", "dia": "intervalo", None: "día"}
TITLE_FIELD = {"mes": "Mes", "anio": "Año", "dia": "Día"}
HEADER_STEP = {"mes": "diario", "anio": "mensual"}


def _width(period: str | None) -> int:
    return NARROW if period else WIDE


def _short(label: str) -> Column:
    return F.substring(F.coalesce(label, F.lit("")), 1, LABEL_WIDTH)


def text_head(axis: Axis, first: int, count: int, period: str | None) -> str:
    dates = (date_label(axis.instant(i), period) for i in range(first, first + count))
    return HEAD_TEXT.ljust(LABEL_WIDTH) + "".join(d.rjust(_width(period)) for d in dates)


def csv_head(axis: Axis, first: int, count: int, period: str | None, sep: str) -> str:
    return sep.join([HEAD_CSV, *(date_label(axis.instant(i), period) for i in range(first, first + count))])


def text_top(labels: Column, period: str | None) -> Column:
    """The head of a fixed-width table from its labels."""
    padded = F.transform(labels, lambda label: F.lpad(label, _width(period), " "))
    return F.concat(F.lit(HEAD_TEXT.ljust(LABEL_WIDTH)), F.array_join(padded, ""))


def csv_top(labels: Column, sep: str) -> Column:
    return F.array_join(F.concat(F.array(F.lit(HEAD_CSV)), labels), sep)


def text_line(values: Column, period: str | None, label: str = "label") -> Column:
    numbers = F.transform(values, lambda n: F.format_string(f"%{_width(period)}d", n))
    return F.concat(F.rpad(_short(label), LABEL_WIDTH, " "), F.array_join(numbers, ""))


def csv_line(values: Column, sep: str, label: str = "label") -> Column:
    numbers = F.transform(values, lambda n: n.cast("string"))
    return F.concat(_short(label), F.lit(sep), F.array_join(numbers, sep))


def separator(sep: str | None) -> str:
    return sep[0] if sep else DEFAULT_SEPARATOR


def _table(grid: Grid, head: str, line: Column) -> DataFrame:
    top = grid.rows.sparkSession.range(0, 1, 1, 1).select(F.lit(0).cast("bigint").alias("line_no"), F.lit(head).alias("line"))
    return top.unionByName(grid.rows.select((F.col("y") + 1).alias("line_no"), line.alias("line")))


def fixed_width(grid: Grid, period: str | None = None) -> DataFrame:
    """(line_no, line) of the fixed-width table; period is ``mes``, ``dia``, ``anio`` or None."""
    return _table(grid, text_head(grid.axis, 0, grid.axis.size, period), text_line(F.col("values"), period))


def csv(grid: Grid, period: str | None = None, sep: str | None = None) -> DataFrame:
    """(line_no, line) of the CSV table."""
    sep = separator(sep)
    return _table(grid, csv_head(grid.axis, 0, grid.axis.size, period, sep), csv_line(F.col("values"), sep))


def metadata(model: Model, tabla, var_id) -> DataFrame:
    """One row with the first matching network and variable as structs ``red`` and ``variable``, null when unknown."""
    network = chosen(model.table("redes"), tabla, "tabla_id").select(
        F.lit("red").alias("what"), "id", "nombre", F.col("tabla_id").alias("code"))
    variable = chosen(model.table("var"), var_id, "var").select(
        F.lit("variable").alias("what"), "id", "nombre", F.col("var").alias("code"))
    item, what = F.struct("nombre", "code", F.col("id").cast("string").alias("id")), F.col("what")

    def first(kind: str) -> Column:
        return F.min_by(F.when(what == kind, item), F.when(what == kind, F.col("id"))).alias(kind)

    return network.unionByName(variable).agg(first("red"), first("variable"))


def _numbered_lines(frame: DataFrame, lines: list[Column]) -> DataFrame:
    listed = frame.select(F.posexplode(F.array(*lines)).alias("pos", "line"))
    return listed.select(F.col("pos").cast("bigint").alias("line_no"), "line")


def title_lines(period: str | None, value: Column | None, start=None, end=None) -> list[Column]:
    """The lines above a fixed-width table, from the columns ``red`` and ``variable``; the last is blank."""

    def described(item: str) -> Column:
        text = F.concat(f"{item}.nombre", F.lit(" ("), f"{item}.code", F.lit(" ["), f"{item}.id", F.lit("])"))
        return F.coalesce(text, F.lit(""))

    lines = [
        F.lit(f"Cantidad de registros por {QUANTITY[period]}."),
        F.concat(F.lit("Red: "), described("red"), F.lit(".")),
        F.concat(F.lit("Variable: "), described("variable"), F.lit(".")),
    ]
    if period:
        lines.append(F.concat(F.lit(f"{TITLE_FIELD[period]}: "), value))
    else:
        lines += [F.lit(f"Inicio: {start}"), F.lit(f"Fin: {end}")]
    return [*lines, F.lit("")]


def header_lines(period: str | None, value: Column | None, dt: str | None = None) -> list[Column]:
    """The lines above a CSV table, from the columns ``red`` and ``variable``; the last two are blank."""

    def field(name: str, item: str, key: str) -> Column:
        return F.concat(F.lit(f"{name}="), F.coalesce(f"{item}.{key}", F.lit("")))

    lines = [
        field("redNombre", "red", "nombre"), field("redTabla", "red", "code"), field("redId", "red", "id"),
        field("variableNombre", "variable", "nombre"), field("variableCode", "variable", "code"),
        field("variableId", "variable", "id"),
    ]
    if period:
        step = HEADER_STEP.get(period, dt or INTRADAY_STEP)
        lines += [F.lit(f"intervaloTemporal={step}"), F.concat(F.lit("fecha="), value)]
    return [*lines, F.lit(""), F.lit("")]


def title(model: Model, tabla, var_id, period: str | None = None, value: str | None = None, start: str | None = None,
          end: str | None = None) -> DataFrame:
    """(line_no, line) above a fixed-width table."""
    return _numbered_lines(metadata(model, tabla, var_id), title_lines(period, F.lit(value), start, end))


def header(model: Model, tabla, var_id, period: str | None = None, value: str | None = None,
           dt: str | None = None) -> DataFrame:
    """(line_no, line) above a CSV table."""
    return _numbered_lines(metadata(model, tabla, var_id), header_lines(period, F.lit(value), dt))


def stacked(*parts: DataFrame) -> DataFrame:
    """(line_no, line) of several line frames one below the other; all but the last are short."""
    placed = [part.select(F.lit(i).alias("part"), "line_no", "line") for i, part in enumerate(parts)]
    whole = placed[0]
    for part in placed[1:]:
        whole = whole.unionByName(part)
    return whole.select((F.col("part").cast("bigint") * (1 << 40) + F.col("line_no")).alias("line_no"), "line")


def report(model: Model, grid: Grid, tabla, var_id, period: str | None = None, value: str | None = None, form: str = "fwc",
           start: str | None = None, end: str | None = None, sep: str | None = None, dt: str | None = None) -> DataFrame:
    """(line_no, line) of a grid as one report: the fixed-width table below its title, or with ``form="csv"`` the CSV table
    below its header."""
    if form == "csv":
        above, table = header_lines(period, F.lit(value), dt), csv(grid, period, sep)
    elif form == "fwc":
        above, table = title_lines(period, F.lit(value), start, end), fixed_width(grid, period)
    else:
        raise ValueError(f"unknown form of a report: {form!r}")
    head = _numbered_lines(metadata(model, tabla, var_id), above)
    return head.unionByName(table.select((F.col("line_no") + len(above)).alias("line_no"), "line"))


def document(grid: Grid, entities: int = PIECE) -> DataFrame:
    """``(piece, dates, names, cells)`` with 0-based ``[x, y, n]`` in order of x and y.

    The document of a grid of any size, in pieces of so many entities, numbered in their order; a chart of no more than
    that is one row. A grid without entities is one piece whose names and cells are null.
    """
    spark: SparkSession = grid.rows.sparkSession
    piece = F.call_function("div", F.col("y"), F.lit(entities)).cast("bigint").alias("piece")
    items = F.array_sort(F.collect_list(F.struct("y", "label", "values")))
    first = spark.range(0, 1, 1, 1).select(F.col("id").alias("piece"))
    pieces = first.join(grid.rows.groupBy(piece).agg(items.alias("r")), "piece", "full")
    size, none = F.lit(grid.axis.size), F.lit(None)

    def column(x: Column) -> Column:
        return F.transform("r", lambda e: F.array(x.cast("int"), e["y"].cast("int"), F.get(e["values"], x).cast("int")))

    positions = F.sequence(F.lit(0), size - 1) if grid.axis.size else F.array().cast("array<int>")
    dates = F.array(*[F.lit(d) for d in grid.dates()]).cast("array<string>") if grid.axis.size else none.cast("array<string>")
    triples = F.flatten(F.transform(positions, column)) if grid.axis.size else none.cast("array<array<int>>")
    known = F.col("r").isNotNull()
    return pieces.select(
        "piece", dates.alias("dates"), F.when(known, F.transform("r", lambda e: e["label"])).alias(grid.names),
        F.when(known, triples).alias("cells"))


def to_json(doc: DataFrame, name: str = "cells", keys: tuple[str, ...] = ()) -> DataFrame:
    """The columns of each row but the keys as one JSON text, beside the keys."""
    values = F.struct(*[c for c in doc.columns if c not in keys])
    return doc.select(*keys, F.to_json(values, {"ignoreNullFields": "false"}).alias(name))


def document_json(grid: Grid, entities: int = PIECE) -> DataFrame:
    """``(piece, cells)``: each piece of the document as JSON text."""
    return to_json(document(grid, entities), keys=("piece",))


def document_lines(grid: Grid) -> DataFrame:
    """(section, y, line): the JSON document in pieces, to be written in order of section and y.

    Each entity gives one line of labels and one of cells, so no row grows with the number of entities.
    """
    spark: SparkSession = grid.rows.sparkSession
    comma = F.when(F.col("y") > 0, ",").otherwise("")
    label = F.coalesce(F.regexp_extract(F.to_json(F.array("label")), r"^\[(.*)\]$", 1), F.lit("null"))
    triple = F.transform("values", lambda n, x: F.format_string("[%d,%d,%d]", x, F.col("y"), n))

    def fixed(section: int, text: str) -> DataFrame:
        return spark.range(0, 1, 1, 1).select(F.lit(section).alias("section"), F.col("id").alias("y"), F.lit(text).alias("line"))

    def each(section: int, text: Column) -> DataFrame:
        return grid.rows.select(F.lit(section).alias("section"), "y", F.concat(comma, text).alias("line"))

    head = f'{{"dates":{json.dumps(grid.dates(), separators=(",", ":"))},"{grid.names}":['
    return fixed(0, head).unionByName(each(1, label)).unionByName(fixed(2, '],"cells":[')).unionByName(
        each(3, F.array_join(triple, ","))).unionByName(fixed(4, "]}"))
