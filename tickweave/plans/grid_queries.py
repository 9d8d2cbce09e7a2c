"""Queries of the regular grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.functions.codes import normal_code
from tickweave.operators.grid import regular_grid
from tickweave.runtime import table


def _grid(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "ticks").select("code", "delay_time", "close", "tick_id")
    return regular_grid(t, normal_code(F.col("code")), F.col("delay_time"), F.col("close"), F.col("tick_id"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    g = _grid(spark, folder).filter("n_readings = 0")
    return g.select(F.col("source").alias("code"), F.date_format("day", "yyyy-MM-dd").alias("trade_day"), F.col("minute").alias("minute_of_day"))


def p1_series(spark: SparkSession, folder: str) -> DataFrame:
    g = _grid(spark, folder)
    return g.select(
        F.col("source").alias("code"), F.date_format("day", "yyyy-MM-dd").alias("trade_day"), F.col("minute").alias("minute_of_day"), "n_readings",
        F.round("first_value", 6).alias("first_close"), F.round("last_value", 6).alias("last_close"), F.round("grid_value", 6).alias("grid_close"), "status",
    )


_READINGS = """
WITH r AS (
  SELECT code, CAST(delay_time AS DATE) AS day, (hour(delay_time) * 3600 + minute(delay_time) * 60) * CAST(1000000 AS BIGINT) + microsecond(delay_time) AS us, tick_id, close
  FROM (SELECT CASE WHEN length(d) >= 6 THEN d WHEN length(d) > 0 THEN lpad(d, 6, '0') END AS code, delay_time, tick_id, close
        FROM (SELECT regexp_replace(code, '[^0-9]', '', 'g') AS d, * EXCLUDE (code) FROM ticks))
  WHERE code IS NOT NULL AND delay_time IS NOT NULL AND close IS NOT NULL AND NOT isnan(close)),
p AS (SELECT unnest(list_concat(range(570, 690, 5), range(780, 900, 5))) AS m),
d AS (SELECT DISTINCT code, day FROM r WHERE us // 300000000 * 5 IN (SELECT m FROM p)),
g AS (SELECT code, day, m FROM d, p)
"""

ORACLE = {
    "p1_found": _READINGS
    + """SELECT g.code, strftime(g.day, '%Y-%m-%d') AS trade_day, CAST(m AS INTEGER) AS minute_of_day
FROM g WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.code = g.code AND r.day = g.day AND r.us // 300000000 * 5 = m)""",
    "p1_series": _READINGS
    + """, n AS (SELECT code, day, us // 300000000 * 5 AS m, count(*) AS n, min(ROW(us, tick_id, close)) AS f, max(ROW(us, tick_id, close)) AS l FROM r GROUP BY ALL),
q AS (SELECT g.*, CAST(m AS BIGINT) * 60000000 AS s FROM g),
b AS (SELECT q.code, q.day, q.m, max(ROW(us, tick_id, close)) AS x FROM q JOIN r ON r.code = q.code AND r.day = q.day AND r.us < s GROUP BY ALL),
a AS (SELECT q.code, q.day, q.m, min(ROW(us, tick_id, close)) AS x FROM q JOIN r ON r.code = q.code AND r.day = q.day AND r.us >= s GROUP BY ALL),
v AS (SELECT q.code, q.day, q.m, coalesce(n.n, 0) AS n, n.f[3] AS f, n.l[3] AS l,
  CASE WHEN a.x[1] = s THEN a.x[3] WHEN a.x[1] - b.x[1] <= 1800000000 THEN b.x[3] + (a.x[3] - b.x[3]) * ((s - b.x[1]) / (a.x[1] - b.x[1])) END AS v
  FROM q LEFT JOIN n USING (code, day, m) LEFT JOIN b USING (code, day, m) LEFT JOIN a USING (code, day, m))
SELECT code, strftime(day, '%Y-%m-%d') AS trade_day, CAST(m AS INTEGER) AS minute_of_day, n AS n_readings, round(f, 6) AS first_close, round(l, 6) AS last_close, round(v, 6) AS grid_close,
  CASE WHEN n > 0 THEN 'observed' WHEN v IS NOT NULL THEN 'interpolated' ELSE 'missing' END AS status FROM v""",
}
QUERIES = {"p1_found": p1_found, "p1_series": p1_series}
