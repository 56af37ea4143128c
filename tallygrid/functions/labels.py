"""Row labels and sort keys of grid entities, and the date labels of columns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# The label and sort modes of stations, and the lengths of cut labels.
STATION_MODES = ("ext", "ext_only", "nombre", "id", None)
CODE_LENGTH, NAME_LENGTH, LONG_LENGTH = 8, 11, 15
STATION_KEY_WIDTH, CALIBRATION_KEY_WIDTH, CALIBRATION_NAME_WIDTH = 5, 4, 10


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _name(column: str = "nombre") -> Column:
    return F.substring(column, 1, NAME_LENGTH)


def station_mode(use_id: str | None) -> str | None:
    """A known mode; any other text means the default one."""
    return use_id if use_id in STATION_MODES else None


def station_key(use_id: str | None) -> Column:
    mode = station_mode(use_id)
    if mode in ("ext", "ext_only"):
        return F.col("id_externo")
    if mode == "nombre":
        return F.col("nombre")
    return F.lpad(_text("id" if mode == "id" else "unid"), STATION_KEY_WIDTH, "0")


def station_label(use_id: str | None) -> Column:
    mode = station_mode(use_id)
    code = F.coalesce(F.col("id_externo"), _text("unid"))
    if mode == "ext":
        return F.concat(F.substring(code, 1, CODE_LENGTH), F.lit(" - "), _name())
    if mode == "ext_only":
        return code
    if mode == "nombre":
        return F.substring(F.coalesce(F.col("nombre"), _text("unid")), 1, LONG_LENGTH)
    if mode == "id":
        return F.substring(F.coalesce(_text("id"), _text("unid")), 1, LONG_LENGTH)
    return name_and_id("unid")


def name_and_id(key: str) -> Column:
    return F.concat(_name(), F.lit(" ("), _text(key), F.lit(")"))


def calibration_key(use_id: bool) -> Column:
    if use_id:
        return F.lpad(_text("id"), CALIBRATION_KEY_WIDTH, "0")
    return F.lpad("nombre", CALIBRATION_NAME_WIDTH, "0")


def calibration_label(use_id: bool) -> Column:
    if use_id:
        return F.concat(F.lpad(_text("id"), CALIBRATION_KEY_WIDTH, "0"), F.lit(" - "), _name())
    return _name()


def hour_label(t: Column) -> Column:
    """``YYYY-MM-DDTHH``. The text form of a zone-less instant does not depend on the session zone."""
    text = t.cast("string")
    return F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 2))


def date_label(value: datetime, period: str | None) -> str:
    """Column head in a report: day of a month, time of a day, month of a year, else the whole date."""
    return value.strftime({"mes": "%d", "dia": "%H:%M", "anio": "%m"}.get(period, "%Y-%m-%d"))


def number_text(value: Column) -> Column:
    """The shortest decimal text of a double, as ``3``, ``6.55`` or ``1e-7``; powers of ten from 1e21 and below 1e-6."""
    size, text = F.abs(value), value.cast("string")

    def plain(precise: str) -> Column:
        return F.regexp_replace(text.cast(precise).cast("string"), r"\.?0+$", "")

    power = F.regexp_replace(F.regexp_replace(text, r"\.0E|E", "e"), r"e(\d)", "e+$1")
    return (F.when(value == 0, "0").when((size >= 1e-6) & (size < 1e15), plain("decimal(38,23)"))
            .when((size >= 1e15) & (size < 1e21), plain("decimal(38,16)")).otherwise(power))
