"""Raw export of the water levels of one station."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import number_text
from ..functions.periods import instant
from ..functions.predicates import integer
from ..functions.sizing import broadcast_if, fits, within
from ..sources.model import Model

# The variable and procedure exported, and the code under which they go out.
LEVEL_VARIABLE, LEVEL_PROCEDURE, LEVEL_CODE = 2, 1, 1


def levels(model: Model, estacion_id, start, end) -> DataFrame:
    """(station, code, date, hour, minute, value) in order of time, both ends included."""
    station = integer(estacion_id) if estacion_id else None
    if not estacion_id:
        raise ValueError("missing estacion_id")
    if not station:
        raise ValueError("bad estacion_id")
    for name, value in (("startdate", start), ("enddate", end)):
        if not value:
            raise ValueError(f"missing {name}")
    series = model.table("series").where(
        (F.col("estacion_id") == station) & (F.col("var_id") == LEVEL_VARIABLE)
        & (F.col("proc_id") == LEVEL_PROCEDURE))
    chosen = broadcast_if(series.select(F.col("id").alias("series_id"), "estacion_id"), series)
    facts = model.between("observaciones", instant(start), instant(end), closed=True).join(chosen, "series_id")
    facts = facts.select("id", "timestart", "estacion_id")
    values = model.table("valores_num")
    if not fits(values):
        # Observations of a period have ids near each other: only that range of the values is read.
        values = within(values, "obs_id", facts, "id")
    values = facts.join(values, F.col("id") == F.col("obs_id"))
    day = F.to_date("timestart").cast("string")
    text = F.concat_ws("/", F.substring(day, 9, 2), F.substring(day, 6, 2), F.substring(day, 1, 4))
    return values.orderBy("timestart", "id").select(
        F.col("estacion_id").alias("codigo_de_estacion"), F.lit(LEVEL_CODE).cast("bigint").alias("codigo_de_variable"),
        text.alias("fecha"), F.hour("timestart").cast("bigint").alias("hora"),
        F.minute("timestart").cast("bigint").alias("minuto"), "valor")


def level_lines(rows: DataFrame) -> DataFrame:
    """(line): the export as comma-separated text, without a head."""
    texts = [number_text(F.col(c)) if kind == "double" else F.col(c).cast("string") for c, kind in rows.dtypes]
    return rows.select(F.array_join(F.array(*[F.coalesce(t, F.lit("")) for t in texts]), ",").alias("line"))
