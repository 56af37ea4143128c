"""The registered queries in SQL, written over the same logical tables but along the plain definitions: range joins
and dense cross products where the library counts by arithmetic."""

from __future__ import annotations

from ..operators.catalog import LISTED_COLUMNS
from .queries import LINE, POLYGON, TALLIED, TIPOS

TABLES = {
    "redes": """SELECT CAST(r_regionkey + 1 AS BIGINT) id, lower(replace(r_name, ' ', '_')) tabla_id, r_name nombre
        FROM region""",
    "estaciones": """SELECT c_custkey unid, c_custkey + 1000 id,
            CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE substring(c_name, 10, 9) END id_externo,
            c_mktsegment || ' ' || c_name nombre, lower(replace(r_name, ' ', '_')) tabla, c_acctbal >= 0 habilitar,
            CASE WHEN c_custkey % 41 = 7 THEN NULL ELSE c_custkey % 23 <> 5 END has_obs
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "ev": """SELECT *, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3
            WHEN 'signup' THEN 4 WHEN 'view' THEN 5 END var_id FROM events""",
    "series": """SELECT DISTINCT user_id * 10 + var_id id, user_id estacion_id, CAST(var_id AS BIGINT) var_id,
            CAST(CASE WHEN var_id = 4 THEN 2 ELSE 1 END AS BIGINT) proc_id, 1 + user_id % 3 unit_id FROM ev""",
    "observaciones": "SELECT event_id id, user_id * 10 + var_id series_id, ts timestart FROM ev",
    "valores_num": "SELECT event_id obs_id, value valor FROM events",
    "variables": """SELECT DISTINCT CAST(var_id AS BIGINT) id, event_type var,
            upper(substring(event_type, 1, 1)) || substring(event_type, 2) nombre FROM ev""",
    "procedimiento": "SELECT DISTINCT proc_id id, 'procedure ' || proc_id nombre FROM series",
    "unidades": "SELECT DISTINCT unit_id id, 'unit ' || unit_id nombre, 'u' || unit_id abrev FROM series",
    "fuentes": "SELECT DISTINCT CAST(substring(p_brand, 7) AS BIGINT) id, p_brand nombre FROM part",
    "areas_pluvio": """SELECT s_suppkey unid, s_name nombre, s_acctbal > 0 activar, s_nationkey % 5 <> 0 mostrar
        FROM supplier""",
    "li": """SELECT l_orderkey, l_linenumber, l_suppkey area_id, l_shipdate timestart,
            CAST(substring(p_brand, 7) AS BIGINT) fuentes_id,
            CAST(CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'PROMO' THEN 4
                WHEN 'SMALL' THEN 5 WHEN 'STANDARD' THEN 6 END AS BIGINT) escena_id,
            CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 END AS BIGINT) var_id,
            CAST(CASE l_linestatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS BIGINT) proc_id
            , l_linestatus qualifier
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "lk": """SELECT *, ((area_id * 100 + fuentes_id) * 10 + var_id) * 10 + proc_id areal_id,
            (fuentes_id * 10 + escena_id) * 10 + var_id rast_id FROM li""",
    "series_areal": """SELECT DISTINCT areal_id id, area_id, fuentes_id, var_id, proc_id, 1 + area_id % 3 unit_id
        FROM lk""",
    "observaciones_areal": "SELECT areal_id series_id, timestart FROM lk",
    "series_rast": """SELECT DISTINCT rast_id id, escena_id, fuentes_id, var_id, CAST(1 AS BIGINT) proc_id,
            CAST(1 AS BIGINT) unit_id FROM lk""",
    "observaciones_rast": "SELECT rast_id series_id, timestart FROM lk",
    "calibrados_grupos": "SELECT CAST(r_regionkey + 1 AS BIGINT) id, r_name nombre FROM region",
    "calibrados": """SELECT CAST(n_nationkey + 1 AS BIGINT) id, n_name nombre, CAST(n_regionkey + 1 AS BIGINT) grupo_id,
            CAST(1 + n_nationkey % 4 AS BIGINT) model_id, n_nationkey % 6 <> 0 activar FROM nation""",
    "corridas": """SELECT o_orderkey id, CAST(c_nationkey + 1 AS BIGINT) cal_id,
            o_orderdate + CASE WHEN o_orderpriority = '5-LOW' THEN INTERVAL 12 HOUR ELSE INTERVAL 0 HOUR END date
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "pronosticos": """SELECT l_orderkey cor_id, area_id * 10 + 1 + l_linenumber % 5 series_id, timestart, qualifier
        FROM lk WHERE l_linenumber % 3 = 0""",
    "pronosticos_areal": "SELECT l_orderkey cor_id, areal_id series_id, timestart, qualifier FROM lk WHERE l_linenumber % 3 = 1",
    "pronosticos_rast": "SELECT l_orderkey cor_id, rast_id series_id, timestart, qualifier FROM lk WHERE l_linenumber % 3 = 2",
    "coverage": """SELECT a.series_table, a.series_id, a.cor_id, s.estacion_id, e.tabla,
            coalesce(s.var_id, sa.var_id, sr.var_id) var_id, a.begin_date, a.end_date, a.count, a.qualifiers
        FROM (
            SELECT 'series' series_table, series_id, cor_id, min(timestart) begin_date, max(timestart) end_date,
                count(*) count, list_sort(list(DISTINCT qualifier)) qualifiers FROM pronosticos GROUP BY ALL
            UNION ALL
            SELECT 'series_areal', series_id, cor_id, min(timestart), max(timestart), count(*),
                list_sort(list(DISTINCT qualifier)) FROM pronosticos_areal GROUP BY ALL
            UNION ALL
            SELECT 'series_rast', series_id, cor_id, min(timestart), max(timestart), count(*),
                list_sort(list(DISTINCT qualifier)) FROM pronosticos_rast GROUP BY ALL) a
        LEFT JOIN series s ON a.series_table = 'series' AND a.series_id = s.id
        LEFT JOIN estaciones e ON s.estacion_id = e.unid
        LEFT JOIN series_areal sa ON a.series_table = 'series_areal' AND a.series_id = sa.id
        LEFT JOIN series_rast sr ON a.series_table = 'series_rast' AND a.series_id = sr.id""",
    "coverage_last": """SELECT coverage.*, r.cal_id, calibrados.grupo_id cal_grupo_id, r.date forecast_date
        FROM coverage
        JOIN (SELECT *, row_number() OVER (PARTITION BY cal_id ORDER BY date DESC, id DESC) rn FROM corridas) r
            ON coverage.cor_id = r.id AND r.rn = 1
        JOIN calibrados ON r.cal_id = calibrados.id""",
    "named": """SELECT n.*, v.var var_var, v.nombre var_nombre, CAST(NULL AS VARCHAR) "var_timeSupport",
            p.nombre proc_nombre, u.nombre unit_nombre, u.abrev unit_abrev
        FROM (
            SELECT 'puntual' tipo, s.id, s.estacion_id, CAST(NULL AS BIGINT) area_id, CAST(NULL AS BIGINT) escena_id,
                s.var_id, s.proc_id, s.unit_id, CAST(NULL AS BIGINT) fuentes_id, e.nombre estacion_nombre,
                CAST(NULL AS VARCHAR) fuentes_nombre
            FROM series s LEFT JOIN estaciones e ON s.estacion_id = e.unid
            UNION ALL
            SELECT 'areal', s.id, NULL, s.area_id, NULL, s.var_id, s.proc_id, s.unit_id, s.fuentes_id, a.nombre, f.nombre
            FROM series_areal s LEFT JOIN areas_pluvio a ON s.area_id = a.unid LEFT JOIN fuentes f ON s.fuentes_id = f.id
            UNION ALL
            SELECT 'raster', s.id, NULL, NULL, s.escena_id, s.var_id, s.proc_id, s.unit_id, s.fuentes_id, NULL, f.nombre
            FROM series_rast s LEFT JOIN fuentes f ON s.fuentes_id = f.id) n
        LEFT JOIN variables v ON n.var_id = v.id LEFT JOIN procedimiento p ON n.proc_id = p.id
        LEFT JOIN unidades u ON n.unit_id = u.id""",
    "covered": """SELECT c.series_id, c.series_table, c.tabla, c.cor_id, c.begin_date, c.end_date, c.count, c.qualifiers, n.*
            EXCLUDE (id)
        FROM coverage c JOIN named n ON c.series_id = n.id
            AND c.series_table = CASE n.tipo WHEN 'areal' THEN 'series_areal' WHEN 'raster' THEN 'series_rast' ELSE 'series' END""",
}
SERIES_TABLES = {"puntual": "series", "areal": "series_areal", "raster": "series_rast"}
FORECASTS = {"puntual": "pronosticos", "areal": "pronosticos_areal", "raster": "pronosticos_rast"}
STATION_JOINS = " JOIN estaciones ON s.estacion_id = estaciones.unid JOIN redes ON estaciones.tabla = redes.tabla_id"


def query(select: str, **parts: str) -> str:
    """A statement with the logical tables and further named parts, in order."""
    named = ", ".join(f"{name} AS ({text})" for name, text in {**TABLES, **parts}.items())
    return f"WITH {named} {select}"


def series_of(start: str, end: str, dt: str) -> str:
    span = f"generate_series(TIMESTAMP '{start}', TIMESTAMP '{end}', INTERVAL '{dt}')"
    return f"SELECT t, row_number() OVER (ORDER BY t) x FROM (SELECT unnest({span}) t)"


def vector(start, end, dt, obs: str, count: str = "count(*)", **parts) -> str:
    """Each bucket with its count; ``count`` is over the observations of one bucket."""
    inside = f"obs.timestart >= ticks.t AND obs.timestart < ticks.t + INTERVAL '{dt}'"
    return query(f"SELECT x, CAST(t AS VARCHAR) t, (SELECT {count} FROM obs WHERE {inside}) n FROM ticks",
                 **parts, ticks=series_of(start, end, dt), obs=obs)


def point_obs(start, end, condition: str) -> str:
    return f"""SELECT o.timestart, s.estacion_id, s.var_id, redes.tabla_id, redes.id red_id
        FROM observaciones o JOIN series s ON o.series_id = s.id {STATION_JOINS}
        WHERE o.timestart >= TIMESTAMP '{start}' AND o.timestart < TIMESTAMP '{end}' AND {condition}"""


def other_obs(tipo, start, end, condition: str) -> str:
    observed = {"areal": "observaciones_areal", "raster": "observaciones_rast"}[tipo]
    return f"""SELECT o.timestart, o.series_id, s.fuentes_id FROM {observed} o
        JOIN {SERIES_TABLES[tipo]} s ON o.series_id = s.id
        WHERE o.timestart >= TIMESTAMP '{start}' AND o.timestart < TIMESTAMP '{end}' AND {condition}"""


def _known(tipo: str, series: str) -> str:
    """Whether a series exists, at a station of a known network where it has one."""
    joins = STATION_JOINS if tipo == "puntual" else ""
    return f"{series} IN (SELECT s.id FROM {SERIES_TABLES[tipo]} s{joins})"


def forecast_obs(tipo, start, end, dt, condition: str) -> str:
    """Forecast values in a span, once for each series that the newest run of their calibration covers."""
    return f"""SELECT value.timestart, l.cal_id, l.cor_id, value.series_id
        FROM coverage_last l, {FORECASTS[tipo]} value
        WHERE value.cor_id = l.cor_id AND l.series_table = '{SERIES_TABLES[tipo]}' AND {condition}
            AND {_known(tipo, "value.series_id")} AND value.timestart >= TIMESTAMP '{start}'
            AND value.timestart < TIMESTAMP '{end}' + INTERVAL '{dt}'"""


def run_obs(tipo, start, end, dt, condition: str) -> str:
    """Runs in a span, once for each known series that they cover."""
    return f"""SELECT run.date timestart, run.id cor_id, run.cal_id
        FROM coverage c, corridas run, calibrados
        WHERE c.cor_id = run.id AND run.cal_id = calibrados.id AND c.series_table = '{SERIES_TABLES[tipo]}'
            AND {condition} AND {_known(tipo, "c.series_id")} AND run.date >= TIMESTAMP '{start}'
            AND run.date < TIMESTAMP '{end}' + INTERVAL '{dt}'"""


def matrix(start, end, dt, entities: str, key: list[str], obs: str, extra: tuple = (),
           count: str = "count(obs.timestart)", **parts) -> str:
    same = " AND ".join(f"obs.{k} = e.{k}" for k in key)
    columns = ", ".join(f"e.{c}" for c in [*key, *extra, "label"])
    return query(f"""SELECT x - 1 x, e.y - 1 y, CAST(t AS VARCHAR) t, {columns}, {count} n,
            strftime(t, '%Y-%m-%dT%H') AS hour
        FROM ticks CROSS JOIN entities e
        LEFT JOIN obs ON {same} AND obs.timestart >= ticks.t AND obs.timestart < ticks.t + INTERVAL '{dt}'
        GROUP BY x, t, e.y, {columns}""", **parts, ticks=series_of(start, end, dt), entities=entities, obs=obs)


JANUARY = ("2024-01-01", "2024-01-31")
YEAR = ("1996-01-01", "1997-01-01")
ALL_YEARS = ("1995-01-01", "2002-01-01")
GROUPS = "l.cal_grupo_id IN (1, 2, 3, 4, 5)"


def _vectors() -> dict[str, str]:
    first = point_obs(*JANUARY, "s.var_id = 1")
    daily = vector(*JANUARY, "1 day", first)
    found = {
        "obs_density_1d": daily,
        "obs_density_3h": vector("2024-01-05", "2024-01-08", "3 hours",
                                 point_obs("2024-01-05", "2024-01-08", "redes.tabla_id = 'asia' AND s.proc_id = 1")),
        "obs_density_unaligned": vector("2024-01-02 05:30:00", "2024-01-31", "7 days",
                                        point_obs("2024-01-02 05:30:00", "2024-01-31", "s.var_id IN (1, 2)")),
        "obs_density_7d_none": vector(*JANUARY, "7 days", point_obs(*JANUARY, "s.estacion_id = 1400")),
        "station_density_1d": vector(*JANUARY, "1 day", first, "count(DISTINCT obs.estacion_id)"),
        "station_density_3d": vector(
            *JANUARY, "3 days", point_obs(*JANUARY, "redes.tabla_id IN ('asia', 'europe') AND s.proc_id = 1"),
            "count(DISTINCT obs.estacion_id)"),
        "areal_density_1m": vector(*YEAR, "1 month", other_obs("areal", *YEAR, "s.fuentes_id = 3")),
        "areal_density_1m_jan31": vector("1996-01-31", YEAR[1], "1 month",
                                         other_obs("areal", "1996-01-31", YEAR[1], "s.fuentes_id = 3")),
        "raster_density_3m": vector(*ALL_YEARS, "3 months", other_obs("raster", *ALL_YEARS, "s.var_id = 1")),
        "raster_density_series": vector(*ALL_YEARS, "6 months", other_obs("raster", *ALL_YEARS, "o.series_id = 321")),
        "prono_density_dedupe": vector(
            *ALL_YEARS, "1 year", f"""SELECT p.timestart FROM pronosticos p JOIN series s ON p.series_id = s.id {STATION_JOINS}
                WHERE p.cor_id IN (SELECT l.cor_id FROM coverage_last l WHERE l.series_table = 'series' AND {GROUPS})
                    AND p.timestart >= TIMESTAMP '{ALL_YEARS[0]}'"""),
        "request_forecast_areal": vector(*ALL_YEARS, "1 year", forecast_obs("areal", *ALL_YEARS, "1 year", GROUPS)),
        "request_runs_raster": vector(
            *YEAR, "1 month", run_obs("raster", *YEAR, "1 month", "calibrados.grupo_id = 2")),
        "request_stations": vector(*JANUARY, "1 day", first, "count(DISTINCT obs.estacion_id)"),
        "obs_density_open_period": vector(
            "2023-12-20", "2024-01-20 15:30:00", "1 day", point_obs("2023-12-20", "2024-01-20 15:30:00", "s.var_id = 1")),
        "run_density_distinct": vector(*YEAR, "1 month", run_obs("puntual", *YEAR, "1 month", "calibrados.grupo_id = 2"),
                                       "count(DISTINCT obs.cor_id)"),
        "vector_arrays": query(f"""SELECT to_json({{'values': list(n ORDER BY x), 'timestamps': list(t ORDER BY x)}})::VARCHAR
            vector FROM ({daily})"""),
        "vector_tuples": query(f"""SELECT to_json({{'tuples': list({{'x': x, 't': t, 'count': n}} ORDER BY x)}})::VARCHAR
            vector FROM ({daily})"""),
    }
    for name, tipo in TIPOS.items():
        found[f"prono_density_{name}"] = vector(*ALL_YEARS, "1 year", forecast_obs(tipo, *ALL_YEARS, "1 year", GROUPS))
        found[f"run_density_1m_{name}"] = vector(
            *YEAR, "1 month", run_obs(tipo, *YEAR, "1 month", "calibrados.grupo_id = 2"))
    return found


def calibration_ids(span, tipo: str, coverage: str, condition: str = "true") -> str:
    """Active calibrations with covered series of a kind in a span."""
    return f"""SELECT DISTINCT calibrados.id, calibrados.nombre FROM calibrados
        JOIN corridas ON corridas.cal_id = calibrados.id
        JOIN covered ON covered.cor_id = corridas.id
        WHERE calibrados.activar AND covered.tipo = '{tipo}' AND {condition} AND {_overlap(span)} AND {_last(coverage)}"""


def _overlap(span) -> str:
    if span is None:
        return "true"
    return f"covered.end_date >= TIMESTAMP '{span[0]}' AND covered.begin_date <= TIMESTAMP '{span[1]}'"


def _last(coverage: str) -> str:
    return "covered.cor_id IN (SELECT cor_id FROM coverage_last)" if coverage == "last" else "true"


def _matrices() -> dict[str, str]:
    networks = "SELECT id, tabla_id, nombre AS label, row_number() OVER (ORDER BY id) y FROM redes"
    first = point_obs(*JANUARY, "s.var_id = 1")
    by_network = matrix(*JANUARY, "1 day", networks, ["tabla_id"], first, ("id",))
    sources = "SELECT id fuentes_id, nombre AS label, row_number() OVER (ORDER BY id) y FROM fuentes"
    rasters = """SELECT s.id series_id, v.var || '/' || f.nombre AS label, row_number() OVER (ORDER BY s.id) y
        FROM series_rast s JOIN fuentes f ON s.fuentes_id = f.id JOIN variables v ON s.var_id = v.id"""
    pairs = """SELECT CAST(y AS BIGINT) y, CAST(red_id AS BIGINT) red_id, CAST(var_id AS BIGINT) var_id, label FROM (VALUES
        (1, 1, 1, 'africa click'), (2, 1, 2, 'africa error'), (3, 2, 1, 'america click'), (4, 3, 5, 'asia view'),
        (5, 4, 4, 'europe signup')) p(y, red_id, var_id, label)"""

    def calibrations(ids: str) -> str:
        return f"SELECT id cal_id, id || ' - ' || nombre AS label, row_number() OVER (ORDER BY id) y FROM ({ids})"

    found = {
        "matrix_network_obs": by_network,
        "matrix_network_stations": matrix(*JANUARY, "1 day", networks, ["tabla_id"], first, ("id",),
                                          "count(DISTINCT obs.estacion_id)"),
        "matrix_source_areal": matrix(*YEAR, "1 month", sources, ["fuentes_id"], other_obs("areal", *YEAR, "true")),
        "matrix_raster_series": matrix(*YEAR, "3 months", rasters, ["series_id"], other_obs("raster", *YEAR, "true")),
        "matrix_calibration_values": matrix(
            *ALL_YEARS, "1 year", calibrations(calibration_ids(ALL_YEARS, "puntual", "last")), ["cal_id"],
            forecast_obs("puntual", *ALL_YEARS, "1 year", "true")),
        "matrix_calibration_runs": matrix(
            *YEAR, "1 month", calibrations(calibration_ids(YEAR, "puntual", "all")), ["cal_id"],
            run_obs("puntual", *YEAR, "1 month", "true")),
        "matrix_max": query(f"SELECT coalesce(max(n), 0) max FROM ({by_network})"),
        "panel_month": matrix("2023-12-01", "2024-02-01", "1 month", pairs, ["red_id", "var_id"],
                              point_obs("2023-12-01", "2024-02-01", "true")),
    }
    for name, tipo in TIPOS.items():
        entities = f"""SELECT cal_id, series_id, cor_id, cal_id || ' - ' || series_id || ' - ' || cor_id AS label,
                row_number() OVER (ORDER BY cal_id, series_id, cor_id) y
            FROM (SELECT calibrados.id cal_id, covered.series_id, covered.cor_id FROM calibrados
                JOIN corridas ON corridas.cal_id = calibrados.id JOIN covered ON covered.cor_id = corridas.id
                WHERE calibrados.activar AND covered.tipo = '{tipo}' AND {_overlap(ALL_YEARS)} AND {_last('last')})"""
        found[f"matrix_calibration_series_{name}"] = matrix(
            *ALL_YEARS, "1 year", entities, ["cal_id", "series_id", "cor_id"],
            forecast_obs(tipo, *ALL_YEARS, "1 year", "true"))
    return found


STATION_KEYS = {
    "ext": "id_externo", "ext_only": "id_externo", "nombre": "nombre", "id": "lpad(CAST(estaciones.id AS VARCHAR), 5, '0')",
    None: "lpad(CAST(unid AS VARCHAR), 5, '0')",
}
STATION_LABELS = {
    "ext": "left(coalesce(id_externo, CAST(unid AS VARCHAR)), 8) || ' - ' || left(nombre, 11)",
    "ext_only": "coalesce(id_externo, CAST(unid AS VARCHAR))",
    "nombre": "left(coalesce(nombre, CAST(unid AS VARCHAR)), 15)",
    "id": "left(CAST(coalesce(estaciones.id, unid) AS VARCHAR), 15)",
    None: "left(nombre, 11) || ' (' || unid || ')'",
}
CELLS = "SELECT x - 1 x, y - 1 y, CAST(t AS VARCHAR) t, entity, label, n FROM grid"


def stations(var_id: int, proc_id: int, use_id, has_obs: bool = True) -> str:
    known = "true" if has_obs else "has_obs"
    return f"""SELECT unid entity, series.id series_id, {STATION_LABELS[use_id]} AS label,
            coalesce(id_externo, CAST(unid AS VARCHAR)) code,
            row_number() OVER (ORDER BY {STATION_KEYS[use_id]} NULLS LAST, unid, series.id) y
        FROM series JOIN estaciones ON series.estacion_id = estaciones.unid
        WHERE estaciones.tabla = 'asia' AND var_id = {var_id} AND proc_id = {proc_id} AND habilitar
            AND has_obs = {known}"""


def grid(select: str, start, end, last, dt, entities: str, observed: str = "observaciones", bucket: str | None = None,
         time: str = "timestart") -> str:
    """A dense grid; ``bucket`` is the condition that puts an observation into the bucket t."""
    bucket = bucket or f"o.at >= ticks.t AND o.at < ticks.t + INTERVAL '{dt}'"
    return query(
        select, ticks=series_of(start, end, dt), entities=entities,
        seen=f"""SELECT entity, o.{time} AS "at" FROM {observed} o, entities
            WHERE o.series_id = entities.series_id AND o.{time} BETWEEN TIMESTAMP '{start}' AND TIMESTAMP '{last}'""",
        grid=_dense(f"SELECT count(*) FROM seen o WHERE o.entity = e.entity AND {bucket}"))


def _dense(count: str) -> str:
    """Every entity and bucket with its count, a subquery on both."""
    return f"SELECT x, y, ticks.t, e.entity, label, ({count}) n FROM ticks, entities e"


def by_day(select: str, start, end, entities: str, observed: str = "observaciones") -> str:
    return grid(select, start, end, f"{end} 23:59:59", "1 day", entities, observed, "CAST(o.at AS DATE) = ticks.t")


def by_month(select: str, entities: str) -> str:
    return grid(select, "2024-01-01", "2024-12-31 23:59:59", "2024-12-31 23:59:59", "1 month", entities,
                bucket="extract(month FROM o.at) = extract(month FROM ticks.t)")


def in_day(select: str, day: str, dt: str, entities: str) -> str:
    return grid(select, day, f"{day} 23:59:59", f"{day} 23:59:59", dt, entities)


def areas(condition: str) -> str:
    return f"""SELECT area_id entity, series_areal.id series_id, left(nombre, 11) || ' (' || area_id || ')' AS label,
            row_number() OVER (ORDER BY area_id, series_areal.id) y
        FROM series_areal JOIN areas_pluvio ON area_id = unid
        WHERE fuentes_id = 3 AND activar AND mostrar AND {condition}"""


def run_grid(bucket: str, condition: str, key: str, label: str, select: str = CELLS) -> str:
    start, end = "1996-01-01", "1996-01-31"
    return query(
        select, ticks=series_of(start, end, "1 day"),
        entities=f"""SELECT id entity, {label} AS label, row_number() OVER (ORDER BY {key}, id) y FROM calibrados
            WHERE id IN (SELECT cal_id FROM corridas) AND {condition}""",
        grid=_dense(f"""SELECT count(*) FROM corridas WHERE cal_id = e.entity AND {bucket}
            AND date BETWEEN TIMESTAMP '{start}' AND TIMESTAMP '{end} 23:59:59'"""))


HALF = ("2024-01-01", "2024-01-15")
NETWORK_SERIES = """SELECT redes.id entity, s.id series_id FROM series s JOIN estaciones e ON s.estacion_id = e.unid
    JOIN redes ON e.tabla = redes.tabla_id WHERE s.var_id = 1 AND s.proc_id = 1 AND e.habilitar AND e.has_obs"""


def network_grid(select: str) -> str:
    return query(
        select, ticks=series_of(*JANUARY, "1 day"),
        entities="""SELECT id entity, left(nombre, 11) || ' (' || id || ')' AS label,
            row_number() OVER (ORDER BY id) y FROM redes""",
        seen=f"""SELECT entity, CAST(timestart AS DATE) AS day FROM observaciones JOIN ({NETWORK_SERIES}) USING (series_id)
            WHERE timestart BETWEEN TIMESTAMP '{JANUARY[0]}' AND TIMESTAMP '{JANUARY[1]} 23:59:59'""",
        grid=_dense("SELECT count(*) FROM seen o WHERE o.entity = e.entity AND o.day = ticks.t"))


def document(names: str, entities: int = 1000) -> str:
    """The grid in pieces of so many entities."""
    return f"""SELECT piece, to_json({{'dates': (SELECT list(strftime(t, '%Y-%m-%d') ORDER BY x) FROM ticks),
        '{names}': (SELECT list(label ORDER BY y) FROM entities WHERE (y - 1) // {entities} = piece),
        'cells': (SELECT list([CAST(x - 1 AS INT), CAST(y - 1 AS INT), CAST(n AS INT)] ORDER BY x, y)
            FROM grid WHERE (y - 1) // {entities} = piece)}})::VARCHAR cells
        FROM (SELECT DISTINCT (y - 1) // {entities} AS piece FROM entities)"""


def _grids() -> dict[str, str]:
    ext = stations(1, 1, "ext")
    modes = {"ext": "ext", "ext_only": "ext_only", "name": "nombre", "id": "id", "default": None}
    found = {f"grid_day_station_{name}": by_day(CELLS, *HALF, stations(1, 1, mode)) for name, mode in modes.items()}
    number, name = "lpad(CAST(id AS VARCHAR), 4, '0')", "left(nombre, 11)"
    lines = """SELECT 0 section, CAST(0 AS BIGINT) y, '{"dates":["' || string_agg(strftime(t, '%Y-%m-%d'), '","' ORDER BY x)
            || '"],"estaciones":[' line FROM ticks
        UNION ALL SELECT 1, y - 1, CASE WHEN y > 1 THEN ',' ELSE '' END || to_json(label)::VARCHAR FROM entities
        UNION ALL SELECT 2, 0, '],"cells":['
        UNION ALL SELECT 3, y - 1, CASE WHEN y > 1 THEN ',' ELSE '' END
            || string_agg('[' || (x - 1) || ',' || (y - 1) || ',' || n || ']', ',' ORDER BY x) FROM grid GROUP BY y
        UNION ALL SELECT 4, 0, ']}'"""
    return {
        **found,
        "grid_day_station_default_proc": by_day(CELLS, *HALF, stations(4, 2, None)),
        "grid_day_station_any_obs": by_day(CELLS, *HALF, stations(1, 1, "ext", False)),
        "grid_year_station": by_month(CELLS, ext),
        "grid_intraday_station_3h": in_day(CELLS, "2024-01-10", "3 hours", stations(1, 1, None)),
        "grid_intraday_station_5h": in_day(CELLS, "2024-01-10", "5 hours", stations(1, 1, None)),
        "grid_day_area": by_day(CELLS, "1996-03-01", "1996-03-31", areas("true"), "observaciones_areal"),
        "grid_day_area_var_proc": by_day(CELLS, "1996-03-01", "1996-03-31", areas("var_id = 1 AND proc_id = 2"),
                                         "observaciones_areal"),
        "grid_day_runs": run_grid("date = t", "true", number, f"{number} || ' - ' || {name}"),
        "grid_day_runs_by_day": run_grid("CAST(date AS DATE) = t", "true", number, f"{number} || ' - ' || {name}"),
        "grid_day_runs_model": run_grid("date = t", "model_id = 2", "lpad(nombre, 10, '0')", name),
        "grid_day_network": network_grid(CELLS),
        "grid_document": network_grid(document("redes")),
        "grid_document_runs": run_grid("date = t", "true", number, f"{number} || ' - ' || {name}", document("calibrados")),
        "grid_document_station": by_day(document("estaciones", 10), *HALF, ext),
        "grid_document_area": by_day(document("areas", 8), "1996-03-01", "1996-03-31", areas("true"), "observaciones_areal"),
        "grid_document_lines": by_day(lines, *HALF, ext),
    }


def _near_edges(text: str, inside: bool = False) -> str:
    """Whether the point of a station is near an edge of a shape, or within its rings, from its text."""
    rings = [[tuple(p.split()) for p in ring.split(",")] for ring in text.partition("(")[2].rstrip(")").replace("(", "").split("),")]
    edges = ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)"
                      for ring in rings for a, b in zip(ring, ring[1:]))
    at = "greatest(0, least(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / (power(x2 - x1, 2) + power(y2 - y1, 2))))"
    far = f"sqrt(power(px - x1 - {at} * (x2 - x1), 2) + power(py - y1 - {at} * (y2 - y1), 2))"
    crossed = "(y1 > py) <> (y2 > py) AND px < (x2 - x1) * (py - y1) / (y2 - y1) + x1"
    judged = f"min({far}) < 0.001" + (f" OR count(*) FILTER (WHERE {crossed}) % 2 = 1" if inside else "")
    return query(f"""SELECT unid FROM (SELECT unid, unid % 50 / 1000.0::DOUBLE px, unid % 7 / 10000.0::DOUBLE py FROM estaciones),
        (VALUES {edges}) e(x1, y1, x2, y2) GROUP BY unid HAVING {judged}""")


def _filters() -> dict[str, str]:
    def station(condition: str) -> str:
        return query(f"SELECT unid FROM estaciones WHERE {condition}")

    def run(condition: str) -> str:
        return query(f"SELECT id FROM corridas WHERE {condition}")

    def value(condition: str) -> str:
        return query(f"SELECT obs_id FROM valores_num WHERE {condition}")

    found = {
        "filter_not_null": station("id_externo IS NOT NULL"),
        "filter_regex": station("regexp_matches(nombre, '^household.*7$', 'i')"),
        "filter_string": station("tabla = 'asia'"),
        "filter_string_list": station("tabla IN ('asia', 'europe')"),
        "filter_string_fold": station("lower(tabla) IN (lower('ASIA'), lower('Middle_East'))"),
        "filter_boolean": station("has_obs = false"),
        "filter_only_true": station("habilitar = true"),
        "filter_only_false": station("habilitar = false"),
        "filter_geometry": station(
            "sqrt(power(unid % 50 / 1000.0 - 0.01, 2) + power(unid % 7 / 10000.0 - 0.0002, 2)) < 0.001"),
        "filter_geometry_line": _near_edges(LINE),
        "filter_geometry_polygon": _near_edges(POLYGON, True),
        "filter_geometry_json": station(" OR ".join(
            f"sqrt(power(unid % 50 / 1000.0 - {x}, 2) + power(unid % 7 / 10000.0 - {y}, 2)) < 0.001"
            for x, y in ((0.01, 0.0002), (0.03, 0.0005)))),
        "filter_date": run("date = TIMESTAMP '1996-01-05'"),
        "filter_timestart": run("date >= TIMESTAMP '2001-01-01 12:00:00'"),
        "filter_timeend": run("date <= TIMESTAMP '1995-06-01 12:00:00'"),
        "filter_from_date": run("date >= TIMESTAMP '2001-05-05'"),
        "filter_to_date": run("date <= TIMESTAMP '1995-02-02'"),
        "filter_numeric_interval": value("valor >= 5.5 AND valor <= 9.25"),
        "filter_numeric_min": value("valor >= 90"),
        "filter_numeric_max": value("valor <= 1.5"),
        "filter_integer": station("unid = 12"),
        "filter_integer_list": station("unid IN (7, 8, 140)"),
        "filter_number": value("valor = CAST(6.55 AS DOUBLE)"),
        "filter_number_list": value("valor IN (CAST(6.55 AS DOUBLE), CAST(1.63 AS DOUBLE))"),
        "filter_untyped": station("unid IN (3, 30)"),
    }
    found["filter_interval"] = query("""SELECT cor_id, series_id FROM pronosticos p JOIN corridas c ON p.cor_id = c.id
        WHERE p.timestart - c.date = INTERVAL 3 DAY""")
    found["filter_case_insensitive"] = station("lower(tabla) = 'europe'")
    found["filter_required"] = station("unid IN (3, 30)")
    for field in ("microseconds", "milliseconds", "second", "minute"):
        found[f"filter_date_{field}"] = query(f"""SELECT id FROM observaciones
            WHERE date_trunc('{field}', timestart) = date_trunc('{field}', TIMESTAMP '2024-01-01 00:00:07')""")
    moment = "TIMESTAMP '1998-08-05 12:34:56'"
    for field in ("hour", "day", "week", "month", "quarter", "year", "decade"):
        found[f"filter_date_{field}"] = run(f"date_trunc('{field}', date) = date_trunc('{field}', {moment})")
    # PostgreSQL truncates to years that end in 1, as extract numbers them; DuckDB's date_trunc to years that end in 0.
    for field in ("century", "millennium"):
        found[f"filter_date_{field}"] = run(f"extract({field} FROM date) = extract({field} FROM {moment})")
    return found


def _catalog() -> dict[str, str]:
    raster = """SELECT s.id, v.var || '/' || f.nombre nombre FROM series_rast s JOIN fuentes f ON s.fuentes_id = f.id
        JOIN variables v ON s.var_id = v.id"""
    columns = """calibrados.id, calibrados.nombre, covered.series_id, covered.series_table, covered.estacion_id,
        covered.tabla, covered.var_id, covered.cor_id, CAST(covered.begin_date AS VARCHAR) begin_date,
        CAST(covered.end_date AS VARCHAR) end_date, covered.count, array_to_string(covered.qualifiers, ',') qualifiers, covered.tipo, covered.proc_id, covered.unit_id,
        covered.fuentes_id, covered.estacion_nombre, covered.fuentes_nombre, covered.var_var, covered.var_nombre,
        covered."var_timeSupport", covered.proc_nombre, covered.unit_nombre, covered.unit_abrev"""
    listed = ", ".join(
        f"'{c}': CAST({c} AS VARCHAR)" if c in ("begin_date", "end_date") else f"""'{c}': covered."{c}\"""" for c in LISTED_COLUMNS)
    joined = f"""FROM calibrados JOIN corridas ON corridas.cal_id = calibrados.id
        JOIN covered ON covered.cor_id = corridas.id WHERE calibrados.activar AND {_overlap(YEAR)}"""
    covered = query("""SELECT * REPLACE (CAST(begin_date AS VARCHAR) AS begin_date,
            CAST(end_date AS VARCHAR) AS end_date, array_to_string(qualifiers, ',') AS qualifiers) FROM coverage""")
    last = query("""SELECT * REPLACE (CAST(begin_date AS VARCHAR) AS begin_date,
            CAST(end_date AS VARCHAR) AS end_date, CAST(forecast_date AS VARCHAR) AS forecast_date,
            array_to_string(qualifiers, ',') AS qualifiers) FROM coverage_last""")
    found = {
        "catalog_networks": query("SELECT * FROM redes"),
        "catalog_network_by_id": query("SELECT * FROM redes WHERE id = 3"),
        "catalog_network_by_code": query("SELECT * FROM redes WHERE tabla_id = 'asia'"),
        "catalog_variables": query("SELECT * FROM variables"),
        "catalog_variable_by_code": query("SELECT * FROM variables WHERE var = 'view'"),
        "catalog_procedures": query("SELECT * FROM procedimiento"),
        "catalog_units": query("SELECT id, nombre FROM unidades"),
        "catalog_sources": query("SELECT * FROM fuentes"),
        "catalog_source_by_id": query("SELECT * FROM fuentes WHERE id = 12"),
        "catalog_groups": query("SELECT * FROM calibrados_grupos"),
        "catalog_group_by_id": query("SELECT * FROM calibrados_grupos WHERE id = 2"),
        "catalog_raster_series": query(raster),
        "catalog_raster_series_by_id": query(f"{raster} WHERE s.id = 321"),
        "catalog_network_labels": query(
            "SELECT *, nombre || '(' || tabla_id || '[' || id || '])' AS label FROM redes"),
        "catalog_source_labels": query("SELECT *, nombre || ' (' || id || ')' AS label FROM fuentes"),
        "forecast_coverage": covered,
        "forecast_coverage_last": last,
        "forecast_coverage_refreshed": covered,
        "forecast_coverage_last_refreshed": last,
        "matrix_calibration_values_stored": _matrices()["matrix_calibration_values"],
        "series_named": query("SELECT * FROM named"),
        "calibrations_last": query(calibration_ids(None, "puntual", "last", "calibrados.grupo_id IN (1, 2, 3)")),
        "calibrations_filtered": query(
            calibration_ids(YEAR, "puntual", "all", "covered.var_id = 2 AND covered.unit_id = 1")),
        "calibrations_nested": query(f"""SELECT calibrados.id, calibrados.nombre, series_table, series_id // 1000 part,
                to_json(list({{{listed}}} ORDER BY series_id, cor_id))::VARCHAR series
            {joined} AND covered.tipo = 'puntual' AND {_last('last')} GROUP BY ALL"""),
    }
    for name, tipo in TIPOS.items():
        found[f"calibrations_{name}"] = query(calibration_ids(YEAR, tipo, "all"))
        found[f"calibrations_series_{name}"] = query(f"SELECT {columns} {joined} AND covered.tipo = '{tipo}'")
    return found


def table_lines(head: str, date: str, label: str, number: str, sep: str = "") -> str:
    """Lines of a report over grid and ticks."""
    return f"""SELECT CAST(0 AS BIGINT) line_no, {head} || string_agg({date}, '{sep}' ORDER BY x) line FROM ticks
        UNION ALL SELECT y, {label} || string_agg({number}, '{sep}' ORDER BY x) FROM grid GROUP BY y, label"""


def _fixed(form: str, width: int) -> str:
    return table_lines("rpad('Fecha:', 22, ' ')", f"lpad(strftime(t, '{form}'), {width}, ' ')",
                       "rpad(substring(label, 1, 22), 22, ' ')", f"printf('%{width}d', n)")


def _csv(form: str, sep: str) -> str:
    return table_lines(f"'Fecha{sep}'", f"strftime(t, '{form}')", f"substring(label, 1, 22) || '{sep}'",
                       "CAST(n AS VARCHAR)", sep)


NETWORK = "(SELECT {} FROM redes WHERE tabla_id = 'asia')"
VARIABLE = "(SELECT {} FROM variables WHERE id = 1)"
NAMED = "nombre || ' (' || {} || ' [' || id || '])'"


def title(quantity: str, *last: str) -> list[str]:
    return [f"'Cantidad de registros por {quantity}.'", f"'Red: ' || {NETWORK.format(NAMED.format('tabla_id'))} || '.'",
            f"'Variable: ' || {VARIABLE.format(NAMED.format('var'))} || '.'", *[f"'{line}'" for line in last], "''"]


def header(step: str | None, date: str = "") -> list[str]:
    period = [f"'intervaloTemporal={step}'", f"'fecha={date}'"] if step else []
    return [f"'redNombre=' || {NETWORK.format('nombre')}", f"'redTabla=' || {NETWORK.format('tabla_id')}",
            f"'redId=' || {NETWORK.format('id')}", f"'variableNombre=' || {VARIABLE.format('nombre')}",
            f"'variableCode=' || {VARIABLE.format('var')}", f"'variableId=' || {VARIABLE.format('id')}", *period, "''", "''"]


def lines(texts: list[str]) -> str:
    return query(" UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) line_no, {text} line" for i, text in enumerate(texts)))


def _whole(above: list[str], table: str) -> str:
    """A table below the lines above it."""
    return f"""SELECT line_no, line FROM ({lines(above)})
        UNION ALL SELECT line_no + {len(above)}, line FROM ({table})"""


def _set(reports: list[tuple[str, list[str], str]]) -> str:
    """Reports (period, lines above, table), each as one file holds it."""
    return " UNION ALL ".join(
        f"""SELECT '{period}' period, line_no, line FROM ({lines(above)})
            UNION ALL SELECT '{period}', line_no + {len(above)}, line FROM ({table})"""
        for period, above, table in reports)


def _files(stem: str, text: str, csv: str) -> str:
    """The lines of the text and CSV files of a set."""
    return " UNION ALL ".join(
        f"SELECT '{stem}_' || period || '.{suffix}' AS file, line_no, line FROM ({lines_})"
        for suffix, lines_ in (("txt", text), ("csv", csv)))


def _reports() -> dict[str, str]:
    ext, only, default = stations(1, 1, "ext"), stations(1, 1, "ext_only"), stations(1, 1, None)
    months = [("202312", "2023-12-01", "2023-12-31"), ("202401", "2024-01-01", "2024-01-31"),
              ("202402", "2024-02-01", "2024-02-29")]
    days = ["2024-01-09", "2024-01-10", "2024-01-11"]
    day_name = lambda day: day.replace("-", "")

    def year(number: int, form: str = _fixed("%m", 6), rows: str = ext) -> str:
        first, last = f"{number}-01-01", f"{number}-12-31 23:59:59"
        return grid(form, first, last, last, "1 month", rows,
                    bucket="extract(month FROM o.at) = extract(month FROM ticks.t)")

    levels = f"""SELECT s.estacion_id codigo_de_estacion, CAST(1 AS BIGINT) codigo_de_variable,
            strftime(o.timestart, '%d/%m/%Y') fecha, extract(hour FROM timestart) hora,
            extract(minute FROM timestart) minuto, valor
        FROM series s JOIN observaciones o ON s.id = o.series_id JOIN valores_num ON o.id = obs_id
        WHERE s.estacion_id = 8 AND s.var_id = 2 AND s.proc_id = 1 AND timestart >= TIMESTAMP '{JANUARY[0]}'
            AND timestart <= TIMESTAMP '{JANUARY[1]}'"""
    half = [f"Inicio: {HALF[0]}", f"Fin: {HALF[1]}"]
    return {
        "report_full_month": _whole(title("día", "Mes: 2024-01"), by_day(_fixed("%d", 6), *JANUARY, ext)),
        "report_full_month_csv": _whole(header("diario", "2024-01"), by_day(_csv("%d", ","), *JANUARY, only)),
        "report_full_day": _whole(title("intervalo", "Día: 2024-01-10"), in_day(_fixed("%H:%M", 6), "2024-01-10", "3 hours", ext)),
        "report_full_day_csv": _whole(header("05:00", "2024-01-10"), in_day(_csv("%H:%M", ";"), "2024-01-10", "5 hours", only)),
        "report_full_year": _whole(title("mes", "Año: 2024"), year(2024)),
        "report_full_year_csv": _whole(header("mensual", "2024"), year(2024, _csv("%m", ";"), only)),
        "report_full_range": _whole(title("día", *half), by_day(_fixed("%Y-%m-%d", 11), *HALF, default)),
        "report_full_range_csv": _whole(header(None), by_day(_csv("%Y-%m-%d", "|"), *HALF, default)),
        "report_full_range_json": by_day(document("estaciones"), *HALF, default),
        "report_fwc_month": by_day(_fixed("%d", 6), *JANUARY, ext),
        "report_csv_month": by_day(_csv("%d", ","), *JANUARY, only),
        "report_fwc_range": by_day(_fixed("%Y-%m-%d", 11), *HALF, default),
        "report_fwc_year": year(2024),
        "report_csv_day": in_day(_csv("%H:%M", ";"), "2024-01-10", "3 hours", only),
        "report_title": lines(title("día", "Mes: 2024-01")),
        "report_header": lines(header("diario", "2024-01")),
        "report_set_monthly": _set([
            (m, title("día", f"Mes: {a[:7]}"), by_day(_fixed("%d", 6), a, b, ext)) for m, a, b in months]),
        "report_set_monthly_csv": _set([
            (m, header("diario", a[:7]), by_day(_csv("%d", ","), a, b, only)) for m, a, b in months]),
        "report_set_yearly": _set([(str(y), title("mes", f"Año: {y}"), year(y)) for y in (2023, 2024)]),
        "report_set_daily": _set([
            (day_name(d), title("intervalo", f"Día: {d}"), in_day(_fixed("%H:%M", 6), d, "3 hours", ext)) for d in days]),
        "report_set_daily_5h": _set([
            (day_name(d), header("05:00", d), in_day(_csv("%H:%M", ","), d, "5 hours", only)) for d in days]),
        "report_set_published": _files("RepCuantMensual", _set([
            (m, title("día", f"Mes: {a[:7]}"), by_day(_fixed("%d", 6), a, b, ext)) for m, a, b in months]), _set([
            (m, header("diario", a[:7]), by_day(_csv("%d", ","), a, b, only)) for m, a, b in months])),
        "level_export": query(levels),
        "level_export_lines": query(f"""SELECT codigo_de_estacion || ',' || codigo_de_variable || ',' || fecha || ',' || hora
            || ',' || minuto || ',' || regexp_replace(CAST(valor AS VARCHAR), '\\.0$', '') line FROM ({levels})"""),
    }


def oracle_sql() -> dict[str, str]:
    found = {**_vectors(), **_matrices(), **_grids(), **_filters(), **_catalog(), **_reports()}
    return found | {f"{name}_tallied": found[name] for name in TALLIED}
