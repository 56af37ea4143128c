"""The logical tables built from the supplied test tables (see ``FIXTURES.md``)."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

from .model import Model

# The stored columns. Declared, they spare the job that would infer them.
STORED = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_brand string, p_type string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
}
# Codes of the mapping.
EVENT_VAR = ("case event_type when 'click' then 1L when 'error' then 2L when 'purchase' then 3L when 'signup' then 4L "
             "when 'view' then 5L end")
SCENE = ("case p_type when 'ECONOMY' then 1L when 'LARGE' then 2L when 'MEDIUM' then 3L when 'PROMO' then 4L "
         "when 'SMALL' then 5L when 'STANDARD' then 6L end")
FLAG_VAR = "case l_returnflag when 'A' then 1L when 'N' then 2L when 'R' then 3L end"
STATUS_PROC = "case l_linestatus when 'F' then 1L when 'O' then 2L end"
PANEL_PAIRS = [
    (1, 1, "africa click"), (1, 2, "africa error"), (2, 1, "america click"), (3, 5, "asia view"),
    (4, 4, "europe signup"),
]

EVENT_PROC = f"case when {EVENT_VAR} = 4 then 2L else 1L end"
REGION_CODE = "lower(replace(r_name, ' ', '_'))"
BRAND = "cast(substring_index(p_brand, '#', -1) as bigint)"
AREAL_ID = "((area_id * 100 + fuentes_id) * 10 + var_id) * 10 + proc_id"
# The one procedure and unit of raster series; a bare literal would turn joins on it into nested loops.
ONE = "case when escena_id > 0 then 1L end"
RASTER_ID = "(fuentes_id * 10 + escena_id) * 10 + var_id"

# One stored table, its columns; distinct rows where marked.
PROJECTIONS = {
    "redes": ("region", ["cast(r_regionkey + 1 as bigint) id", f"{REGION_CODE} tabla_id", "r_name nombre"]),
    "observaciones": ("events", ["event_id id", f"user_id * 10 + {EVENT_VAR} series_id", "ts timestart"]),
    "valores_num": ("events", ["event_id obs_id", "value valor"]),
    "areas_pluvio": ("supplier", ["s_suppkey unid", "s_name nombre", "s_acctbal > 0 activar",
                                  "s_nationkey % 5 <> 0 mostrar"]),
    "calibrados_grupos": ("region", ["cast(r_regionkey + 1 as bigint) id", "r_name nombre"]),
    "calibrados": ("nation", ["cast(n_nationkey + 1 as bigint) id", "n_name nombre",
                              "cast(n_regionkey + 1 as bigint) grupo_id", "cast(1 + n_nationkey % 4 as bigint) model_id",
                              "n_nationkey % 6 <> 0 activar"]),
}
DISTINCT = {
    "series": ("events", ["user_id", "event_type"], [
        f"user_id * 10 + {EVENT_VAR} id", "user_id estacion_id", f"{EVENT_VAR} var_id", f"{EVENT_PROC} proc_id",
        "1 + user_id % 3 unit_id"]),
    "var": ("events", ["event_type"], [f"{EVENT_VAR} id", "event_type var", "initcap(event_type) nombre"]),
    "procedimiento": ("events", [f"{EVENT_PROC} id"], ["id", "'procedure ' || id nombre"]),
    "unidades": ("events", ["1 + user_id % 3 id"], ["id", "'unit ' || id nombre", "'u' || id abrev"]),
    "fuentes": ("part", ["p_brand"], [f"{BRAND} id", "p_brand nombre"]),
}


def fixture(spark: SparkSession, directory: str) -> Model:
    """A model over one scale of the supplied parquet tables."""

    @cache
    def read(name: str) -> DataFrame:
        return spark.read.schema(STORED[name]).parquet(f"{directory}/{name}.parquet")

    def stations() -> DataFrame:
        regions = read("region").selectExpr("r_regionkey n_regionkey", f"{REGION_CODE} tabla")
        nations = read("nation").join(regions, "n_regionkey").selectExpr("n_nationkey c_nationkey", "tabla")
        return read("customer").join(nations, "c_nationkey").selectExpr(
            "c_custkey unid", "c_custkey + 1000 id",
            "case when c_custkey % 10 <> 3 then substring(c_name, 10, 9) end id_externo",
            "c_mktsegment || ' ' || c_name nombre", "tabla", "c_acctbal >= 0 habilitar",
            "case when c_custkey % 41 <> 7 then c_custkey % 23 <> 5 end has_obs")

    def lines(*columns: str, where: str = "true") -> DataFrame:
        parts = read("part").selectExpr("p_partkey l_partkey", f"{BRAND} fuentes_id", f"{SCENE} escena_id")
        return read("lineitem").where(where).join(parts, "l_partkey").selectExpr(
            "l_orderkey cor_id", "l_suppkey area_id", "fuentes_id", "escena_id", f"{FLAG_VAR} var_id",
            f"{STATUS_PROC} proc_id", "l_shipdate timestart", "l_linestatus qualifier").selectExpr(*columns)

    def runs() -> DataFrame:
        owners = read("customer").selectExpr("c_custkey o_custkey", "cast(c_nationkey + 1 as bigint) cal_id")
        return read("orders").join(owners, "o_custkey").selectExpr(
            "o_orderkey id", "cal_id",
            "o_orderdate + make_dt_interval(0, if(o_orderpriority = '5-LOW', 12, 0)) date")

    def point_forecasts() -> DataFrame:
        return read("lineitem").where("l_linenumber % 3 = 0").selectExpr(
            "l_orderkey cor_id", "l_suppkey * 10 + 1 + l_linenumber % 5 series_id", "l_shipdate timestart",
            "l_linestatus qualifier")

    joined = {
        "estaciones": stations,
        "series_areal": lambda: lines("area_id", "fuentes_id", "var_id", "proc_id").distinct().selectExpr(
            f"{AREAL_ID} id", "area_id", "fuentes_id", "var_id", "proc_id", "1 + area_id % 3 unit_id"),
        "observaciones_areal": lambda: lines(f"{AREAL_ID} series_id", "timestart"),
        "series_rast": lambda: lines("escena_id", "fuentes_id", "var_id").distinct().selectExpr(
            f"{RASTER_ID} id", "escena_id", "fuentes_id", "var_id", f"{ONE} proc_id", f"{ONE} unit_id"),
        "observaciones_rast": lambda: lines(f"{RASTER_ID} series_id", "timestart"),
        "corridas": runs,
        "pronosticos": point_forecasts,
        "pronosticos_areal": lambda: lines("cor_id", f"{AREAL_ID} series_id", "timestart", "qualifier", where="l_linenumber % 3 = 1"),
        "pronosticos_rast": lambda: lines("cor_id", f"{RASTER_ID} series_id", "timestart", "qualifier", where="l_linenumber % 3 = 2"),
    }

    @cache
    def table(name: str) -> DataFrame:
        if name in PROJECTIONS:
            stored, columns = PROJECTIONS[name]
            return read(stored).selectExpr(*columns)
        if name in DISTINCT:
            stored, keys, columns = DISTINCT[name]
            return read(stored).selectExpr(*keys).distinct().selectExpr(*columns)
        return joined[name]()

    return Model(spark, table)
