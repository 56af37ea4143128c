"""Logical tables and the three kinds of series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_TYPES = {
    "long": T.LongType(), "string": T.StringType(), "boolean": T.BooleanType(), "double": T.DoubleType(),
    "timestamp": T.TimestampNTZType(), "strings": T.ArrayType(T.StringType()),
}


def _schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind], True) for name, kind in columns.items()])


_OBSERVATIONS = _schema(series_id="long", timestart="timestamp")
_FORECASTS = _schema(cor_id="long", series_id="long", timestart="timestamp")
_NAMED = _schema(id="long", nombre="string")
_COVERAGE = dict(
    series_table="string", series_id="long", cor_id="long", estacion_id="long", tabla="string", var_id="long",
    begin_date="timestamp", end_date="timestamp", count="long", qualifiers="strings",
)

# Column names are those of the monitored database.
SCHEMAS: dict[str, T.StructType] = {
    "redes": _schema(id="long", tabla_id="string", nombre="string"),
    "estaciones": _schema(unid="long", id="long", id_externo="string", nombre="string", tabla="string",
                          habilitar="boolean", has_obs="boolean"),
    "series": _schema(id="long", estacion_id="long", var_id="long", proc_id="long", unit_id="long"),
    "observaciones": _schema(id="long", series_id="long", timestart="timestamp"),
    "valores_num": _schema(obs_id="long", valor="double"),
    "var": _schema(id="long", var="string", nombre="string"),
    "procedimiento": _NAMED,
    "unidades": _schema(id="long", nombre="string", abrev="string"),
    "fuentes": _NAMED,
    "areas_pluvio": _schema(unid="long", nombre="string", activar="boolean", mostrar="boolean"),
    "series_areal": _schema(id="long", area_id="long", fuentes_id="long", var_id="long", proc_id="long",
                            unit_id="long"),
    "observaciones_areal": _OBSERVATIONS,
    "series_rast": _schema(id="long", escena_id="long", fuentes_id="long", var_id="long", proc_id="long",
                           unit_id="long"),
    "observaciones_rast": _OBSERVATIONS,
    "calibrados_grupos": _NAMED,
    "calibrados": _schema(id="long", nombre="string", grupo_id="long", model_id="long", activar="boolean"),
    "corridas": _schema(id="long", cal_id="long", date="timestamp"),
    "pronosticos": _FORECASTS,
    "pronosticos_areal": _FORECASTS,
    "pronosticos_rast": _FORECASTS,
    "series_prono_date_range": _schema(**_COVERAGE),
    "series_prono_date_range_last": _schema(**_COVERAGE, cal_id="long", cal_grupo_id="long",
                                            forecast_date="timestamp"),
}

# Columns a stored table may lack; they are read as null.
OPTIONAL = {"abrev"}
# A forecast table may carry this column; the coverage then lists its values.
QUALIFIER = "qualifier"


@dataclass(frozen=True)
class Kind:
    """One kind of series: its tables and the column that names its place."""

    tipo: str
    series: str
    observations: str
    forecasts: str
    place: str


KINDS = {
    kind.tipo: kind
    for kind in (
        Kind("puntual", "series", "observaciones", "pronosticos", "estacion_id"),
        Kind("areal", "series_areal", "observaciones_areal", "pronosticos_areal", "area_id"),
        Kind("raster", "series_rast", "observaciones_rast", "pronosticos_rast", "escena_id"),
    )
}


def kind_of(tipo: str | None) -> Kind:
    """The kind a request names; ``rast`` is ``raster`` and anything unknown is ``puntual``."""
    return KINDS.get("raster" if tipo == "rast" else tipo, KINDS["puntual"])
