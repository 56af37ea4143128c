"""Report sets: the files of many periods from one scan and one aggregation."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.axis import Axis, add_months
from ..functions.labels import date_label, station_label
from ..functions.periods import INTRADAY_STEP, end_of_day, instant, midnight, month_bounds, year_bounds
from ..functions.steps import parse_step
from ..operators.grids import DAY, MONTH, Grid, station_rows
from ..operators.render import (
    csv_line, csv_top, document_lines, header_lines, metadata, separator, text_line, text_top, title_lines,
)
from ..sources.model import Model
from .versions import Versions

# Files that get their names at the same time.
RENAMES = 16
# The file stems, labels and separator of the report files, and their encoding.
STEMS = {"anio": "RepCuantAnual", "mes": "RepCuantMensual", "dia": "RepCuantDiario"}
TEXT_LABELS, CSV_LABELS = "ext", "ext_only"
CSV_SEPARATOR = ","
ENCODING = "ISO-8859-1"


@dataclass(frozen=True)
class Periods:
    """The reports of a set, numbered from 0. ``at`` makes of a number the struct of a report's name in file names
    (``period``), its ``value`` in titles and its part of the axis, from ``first`` on, ``count`` long. ``labels`` are the
    heads of the buckets of the longest report; a shorter one has the first of them."""

    size: int
    at: Callable[[Column], Column]
    labels: list[str]

    def each(self) -> Column:
        """A row for each report; what it takes to say so does not grow with their number."""
        return F.explode(F.transform(F.sequence(F.lit(0), F.lit(self.size - 1)), self.at)).alias("p")

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.range(0, 1, 1, 1).select(self.each()).select("p.*")


def _period(name: Column, value: Column, first: Column, count: Column) -> Column:
    return F.struct(
        name.alias("period"), value.alias("value"), first.cast("int").alias("first"), count.cast("int").alias("count"))


def _digits(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


@dataclass(frozen=True)
class ReportSet:
    """``rows`` are ``(y, label, code, values)`` of the stations, ``values`` running over the axis of all periods, and
    ``described`` is one row with the network and variable."""

    kind: str
    axis: Axis
    periods: Periods
    rows: DataFrame
    described: DataFrame
    dt: str | None = None

    def lines(self, sep: str = CSV_SEPARATOR) -> DataFrame:
        """(period, suffix, line_no, line) of the fixed-width reports, ``txt``, and of the CSV reports, ``csv``, each
        below its title or header. Both come from one pass over the rows.
        """
        sep, value = separator(sep), F.col("value")
        title, header = title_lines(self.kind, value), header_lines(self.kind, value, self.dt)
        opened = self.rows.select("*", self.periods.each()).withColumn(
            "part", F.slice("values", F.col("p.first") + 1, F.col("p.count")))
        text = text_line(F.col("part"), self.kind, "label")
        body = opened.select(F.col("p.period").alias("period"), _formats(
            line_no=(F.col("y") + len(title) + 1, F.col("y") + len(header) + 1),
            line=(text, csv_line(F.col("part"), sep, "code"))))
        tops = self.described.select("red", "variable", self.periods.each()).select("red", "variable", "p.*")
        labels = F.slice(F.array(*[F.lit(label) for label in self.periods.labels]), 1, F.col("count"))
        heads = tops.select("period", _formats(lines=(
            F.array(*title, text_top(labels, self.kind)), F.array(*header, csv_top(labels, sep)))))
        heads = heads.select("period", "f.suffix", F.posexplode("f.lines").alias("line_no", "line"))
        return heads.withColumn("line_no", F.col("line_no").cast("bigint")).unionByName(
            body.select("period", "f.suffix", "f.line_no", "f.line"))

    def text_lines(self) -> DataFrame:
        """(period, line_no, line) of the fixed-width reports."""
        return self.lines().where("suffix = 'txt'").drop("suffix")

    def csv_lines(self, sep: str = CSV_SEPARATOR) -> DataFrame:
        """(period, line_no, line) of the CSV reports."""
        return self.lines(sep).where("suffix = 'csv'").drop("suffix")


def _formats(**columns: tuple[Column, Column]) -> Column:
    """A struct ``f`` for each format, from pairs of the text and the CSV column."""
    return F.explode(F.array(*[
        F.struct(F.lit(suffix).alias("suffix"), *[pair[i].alias(name) for name, pair in columns.items()])
        for i, suffix in enumerate(("txt", "csv"))])).alias("f")


def _report_set(model: Model, kind: str, axis: Axis, last: datetime, periods: Periods, period_end: Column,
                tabla, var_id, proc_id, has_obs, dt=None) -> ReportSet:
    facts = model.between("observaciones", axis.start, last, closed=True)
    # As in a single report, a period ends with its last full second.
    facts = facts.where(
        F.col("timestart") <= period_end.cast("timestamp_ntz") + F.expr("interval '23:59:59' hour to second"))
    facts = facts.select("series_id", axis.bucket(F.col("timestart")).alias("x"))
    rows = station_rows(model, axis, facts, tabla, var_id, proc_id, TEXT_LABELS, has_obs,
                        label=station_label(TEXT_LABELS), code=station_label(CSV_LABELS))
    return ReportSet(kind, axis, periods, rows, metadata(model, tabla, var_id), dt)


def yearly(model: Model, tabla: str, var_id: int, start, end, proc_id: int | None = None,
           has_obs: bool = True) -> ReportSet:
    """A report of station × month for each year from that of start to that of end."""
    years = range(instant(start).year, instant(end).year + 1)
    if not years:
        raise ValueError("the end lies before the start")
    axis = Axis(year_bounds(years[0])[0], year_bounds(years[-1])[1], MONTH)

    def period(number: Column) -> Column:
        year = number + years[0]
        return _period(_digits(year, 4), year.cast("string"), number * 12, F.lit(12))

    periods = Periods(len(years), period, [f"{month:02d}" for month in range(1, 13)])
    year_end = F.make_date(F.year("timestart"), F.lit(12), F.lit(31))
    return _report_set(model, "anio", axis, axis.end, periods, year_end, tabla, var_id, proc_id, has_obs)


def monthly(model: Model, tabla: str, var_id: int, start, end, proc_id: int | None = None,
            has_obs: bool = True) -> ReportSet:
    """A report of station × day for each month that the range touches."""
    first, stop = month_bounds(instant(start).strftime("%Y-%m"))[0], instant(end)
    months = (stop.year - first.year) * 12 + stop.month - first.month + 1
    if stop < first:
        raise ValueError("the end lies before the start")
    last = add_months(first, months) - timedelta(seconds=1)

    def period(number: Column) -> Column:
        month = F.add_months(F.lit(first.date()), number)
        parts = _digits(F.year(month), 4), _digits(F.month(month), 2)
        return _period(
            F.concat(*parts), F.concat_ws("-", *parts), F.datediff(month, F.lit(first.date())), F.day(F.last_day(month)))

    periods = Periods(months, period, [f"{day:02d}" for day in range(1, 32)])
    return _report_set(model, "mes", Axis(first, midnight(last), DAY), last, periods, F.last_day("timestart"), tabla,
                       var_id, proc_id, has_obs)


def daily(model: Model, tabla: str, var_id: int, start, end, dt=INTRADAY_STEP, proc_id: int | None = None,
          has_obs: bool = True) -> ReportSet:
    """A report of station × step for each day of the range; the steps start again every day."""
    first, last = midnight(start), end_of_day(end)
    step = parse_step(dt)
    if step.months or step.seconds > DAY.seconds:
        raise ValueError(f"a step within a day is needed: {dt!r}")
    axis = Axis(first, last, step, cycle=DAY.seconds)
    days = (last.date() - first.date()).days + 1
    if days < 1:
        raise ValueError("the end lies before the start")
    each = axis.size // days

    def period(number: Column) -> Column:
        day = F.date_add(F.lit(first.date()), number)
        parts = _digits(F.year(day), 4), _digits(F.month(day), 2), _digits(F.day(day), 2)
        return _period(F.concat(*parts), F.concat_ws("-", *parts), number * each, F.lit(each))

    periods = Periods(days, period, [date_label(axis.instant(i), "dia") for i in range(each)])
    return _report_set(model, "dia", axis, last, periods, F.to_date("timestart"), tabla, var_id, proc_id, has_obs, dt)


def latin1(line: Column) -> Column:
    """Characters outside Latin-1 become question marks."""
    return F.regexp_replace(line, r"[^\u0000-ÿ]", "?")


def write_files(lines: DataFrame, directory: str, stem: str, file_lines: int | None = None) -> list[str]:
    """Write ``(period, suffix, line_no, line)`` as Latin-1 files ``stem_period.suffix``; returns their paths.

    Rows go to their file in parallel and are sorted within it. Only names pass through the driver. With ``file_lines`` a
    longer report goes on in ``stem_period.1.suffix`` and so on; without it a report is one file, however long. The files
    take effect one by one; ``publish_files`` lets a set take effect as a whole.
    """
    staging = f"{directory}/_staging-{uuid.uuid4().hex}"
    _write(lines, staging, stem, file_lines)
    return _publish(lines.sparkSession, staging, directory)


def _write(lines: DataFrame, folder: str, stem: str, file_lines: int | None) -> None:
    """Each file as the one part of a folder ``file=…``."""
    number = F.lit("")
    if file_lines:
        chunk = F.call_function("div", F.col("line_no"), F.lit(file_lines))
        number = F.when(chunk > 0, F.concat(F.lit("."), chunk.cast("string"))).otherwise("")
    name = F.concat(F.lit(f"{stem}_"), "period", number, F.lit("."), "suffix")
    placed = lines.select(name.alias("file"), "line_no", latin1(F.col("line")).alias("line"))
    # The text writer puts out the bytes of a string as they are, so the encoded bytes are passed as one.
    encoded = F.encode("line", ENCODING).cast("string").alias("value")
    rows = placed.repartition("file").sortWithinPartitions("file", "line_no").select("file", encoded)
    # One part for each file, whatever the session says of the rows of a part.
    rows.write.option("maxRecordsPerFile", 0).partitionBy("file").text(folder)


def _parts(spark, folder: str) -> dict[str, str]:
    """The one part of each file by its name; all folders are looked at before any is returned."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {}
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if not name.startswith("file="):
            continue
        parts = [p.getPath() for p in files.listStatus(status.getPath()) if p.getPath().getName().startswith("part-")]
        if len(parts) != 1:
            raise OSError(f"{len(parts)} parts of {name.removeprefix('file=')}; nothing was published")
        found[name.removeprefix("file=")] = parts[0].toString()
    return found


def _publish(spark, staging: str, directory: str) -> list[str]:
    """Give the one part of each file its final name, in place of an older file; the replacement is the rename itself."""
    hadoop, gateway = spark._jvm.org.apache.hadoop.fs, spark._sc._gateway
    root, target = hadoop.Path(staging), hadoop.Path(directory)
    settings = spark._jsc.hadoopConfiguration()
    files = root.getFileSystem(settings)
    found = {hadoop.Path(target, name): hadoop.Path(part) for name, part in _parts(spark, staging).items()}
    context = hadoop.FileContext.getFileContext(files.getUri(), settings)
    kind = getattr(hadoop, "Options$Rename")
    overwrite = gateway.new_array(kind, 1)
    overwrite[0] = kind.OVERWRITE
    for final, part in found.items():
        context.rename(files.makeQualified(part), files.makeQualified(final), overwrite)
    files.delete(root, True)
    return sorted(final.toString() for final in found)


def publish_files(lines: DataFrame, directory: str, stem: str, file_lines: int | None = None,
                  replace: bool = False) -> dict[str, str]:
    """Write the files of ``write_files`` as parts of the set in a directory (``versions.py``), which take effect together or
    not at all. Older files of other names stay unless ``replace``. Returns the paths of all files of the set by name.

    The files get their names at once in many threads, in a new folder that no reader knows of yet.
    """
    versions = Versions(lines.sparkSession, directory)
    after, folder = versions.number(), versions.folder()
    _write(lines, f"{versions.directory}/{folder}", stem, file_lines)
    names = {}
    for name, part in _parts(lines.sparkSession, f"{versions.directory}/{folder}").items():
        names[name] = f"{folder}/file={name}/{part.rsplit('/', 1)[1]}"
    with ThreadPoolExecutor(RENAMES) as pool:
        list(pool.map(lambda name: versions.rename(names[name], f"{folder}/{name}"), names))
    versions.publish({name: f"{folder}/{name}" for name in names}, after, replace)
    return versions.parts()


def published(spark: SparkSession, directory: str) -> DataFrame:
    """(file, line_no, line) of the files that a set consists of, each read by one task."""
    paths = Versions(spark, directory).parts()
    if not paths:
        return spark.createDataFrame([], "file string, line_no bigint, line string")
    text = F.regexp_replace(F.decode("content", ENCODING), r"\n$", "")
    return spark.read.format("binaryFile").load(list(paths.values())).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), F.posexplode(F.split(text, r"\n")).alias("line_no", "line")).withColumn(
        "line_no", F.col("line_no").cast("bigint"))


def write_report_set(reports: ReportSet, directory: str, file_lines: int | None = None) -> list[str]:
    """Write the text and CSV files of a report set in one job, as :func:`write_files` does."""
    return write_files(reports.lines(), directory, STEMS[reports.kind], file_lines)


def publish_report_set(reports: ReportSet, directory: str, file_lines: int | None = None, replace: bool = False) -> dict[str, str]:
    """Write a report set and let all its files take effect at once, as :func:`publish_files` does."""
    return publish_files(reports.lines(), directory, STEMS[reports.kind], file_lines, replace)


def write_document(grid: Grid, directory: str) -> None:
    """Write the JSON document of a grid of any size as text parts; in order of their names they are one document."""
    document_lines(grid).orderBy("section", "y").select("line").write.mode("overwrite").text(directory)
