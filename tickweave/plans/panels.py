"""The panels that the queries run over, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.functions.codes import normal_code
from tickweave.runtime import finite, table

PRICES = ("close", "last_close", "askP1", "bidP1")
SIZES = ("volume", "askV1", "bidV1")


def tick_panel(spark: SparkSession, folder: str) -> DataFrame:
    """date, code, delay_time, seq and the fields of each tick that has a time and a code; values that no
    price or size can have are null."""
    t = table(spark, folder, "ticks")
    price = lambda c: F.when((finite(F.col(c)) > 0) & (F.col(c) < 10000), finite(F.col(c))).alias(c)
    size = lambda c: F.when((finite(F.col(c)) >= 0) & (F.col(c) < 1e9), finite(F.col(c))).alias(c)
    t = t.select(F.to_date("delay_time").alias("date"), normal_code(F.col("code")).alias("code"), "delay_time", F.col("tick_id").alias("seq"), *map(price, PRICES), *map(size, SIZES))
    return t.filter("code is not null and delay_time is not null")


TICKS = (
    "panel AS (SELECT CAST(delay_time AS DATE) AS date, CASE WHEN length(d) >= 6 THEN d WHEN length(d) > 0 THEN lpad(d, 6, '0') END AS code, delay_time, tick_id AS seq, "
    + ", ".join([f"CASE WHEN NOT isnan({c}) AND {c} > 0 AND {c} < 10000 THEN {c} END AS {c}" for c in PRICES] + [f"CASE WHEN NOT isnan({c}) AND {c} >= 0 AND {c} < 1e9 THEN {c} END AS {c}" for c in SIZES])
    + " FROM (SELECT regexp_replace(code, '[^0-9]', '', 'g') AS d, * FROM ticks) WHERE d IS NOT NULL AND d <> '' AND delay_time IS NOT NULL)"
)
ORDERED = "PARTITION BY date, code ORDER BY delay_time, seq"


def rows(n: int, by: str = ORDERED) -> str:
    return f"OVER ({by} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def daily_returns(spark: SparkSession, folder: str) -> DataFrame:
    """date, ticker, ticker_ord, ret: change of the mean price of a supplier's line items from month to month, on the
    first of the month; so each date has as many tickers as there are suppliers."""
    from pyspark.sql import Window as W

    l = table(spark, folder, "lineitem").filter("l_shipdate is not null and l_suppkey is not null and l_quantity > 0")
    d = l.groupBy(F.trunc("l_shipdate", "month").alias("date"), F.col("l_suppkey").cast("int").alias("ticker_ord")).agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("c"))
    r = d.withColumn("ret", F.round(F.col("c") / F.lag("c").over(W.partitionBy("ticker_ord").orderBy("date")) - 1, 9))
    return r.select("date", F.lpad(F.col("ticker_ord").cast("string"), 6, "0").alias("ticker"), "ticker_ord", "ret")


DAILY = TICKS + (
    ", daily AS (SELECT date, lpad(CAST(ticker_ord AS VARCHAR), 6, '0') AS ticker, ticker_ord, round(c / lag(c) OVER (PARTITION BY ticker_ord ORDER BY date) - 1, 9) AS ret "
    "FROM (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, CAST(l_suppkey AS INTEGER) AS ticker_ord, round(avg(l_extendedprice / l_quantity), 6) AS c FROM lineitem WHERE l_shipdate IS NOT NULL AND l_suppkey IS NOT NULL AND l_quantity > 0 GROUP BY ALL))"
)



_UPTO = f"OVER ({ORDERED} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def ewm_sql(source: str, columns: dict[str, tuple[str, float, bool]]) -> str:
    """SQL of exponential means (``m_name``) of expressions over the CTE ``source``, each with its half-life. With
    ``adjust`` by sums of weights that fall by half every so many rows. Without, the old mean and the new value share
    the weight at each value, and the products of those shares are sums of logarithms."""
    whole = f"OVER ({ORDERED} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    before = f"OVER ({ORDERED} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    out: list[list[str]] = [[], [], [], [], []]
    for n, (x, half, adjust) in columns.items():
        d = f"CAST({0.5 ** (1 / half)!r} AS DOUBLE)"
        out[0] += [f"{x} AS x_{n}"]
        out[1] += [f"x_{n} - first_value(x_{n} IGNORE NULLS) {whole} AS y_{n}, first_value(x_{n} IGNORE NULLS) {whole} AS f_{n}, i - max(CASE WHEN x_{n} IS NOT NULL THEN i END) {before} AS g_{n}"]
        if adjust:
            out[2] += [f"CASE WHEN x_{n} IS NOT NULL THEN power({d}, nn // 2 - i) END AS w_{n}"]
            out[3] += [f"sum(w_{n}) {_UPTO} AS a_{n}, sum(w_{n} * y_{n}) {_UPTO} AS c_{n}"]
            out[4] += [f"c_{n} / a_{n} + f_{n} AS m_{n}"]
        else:
            old = f"(power({d}, g_{n}) / (power({d}, g_{n}) + 1 - {d}))"
            out[2] += [f"CASE WHEN x_{n} IS NOT NULL AND g_{n} IS NOT NULL THEN {old} END AS o_{n}, sum(CASE WHEN x_{n} IS NOT NULL AND g_{n} IS NOT NULL THEN ln{old} END) {_UPTO} AS l_{n}"]
            out[3] += [f"exp(coalesce(l_{n}, 0)) * sum((1 - o_{n}) * y_{n} / exp(l_{n})) {_UPTO} AS c_{n}"]
            out[4] += [f"coalesce(c_{n}, CASE WHEN max(x_{n}) {_UPTO} IS NOT NULL THEN 0 END) + f_{n} AS m_{n}"]
    steps = [f"SELECT *, {', '.join(out[0])} FROM (SELECT *, row_number() OVER ({ORDERED}) AS i, count(*) {whole} AS nn FROM {source})"] + [f"SELECT *, {', '.join(v)} FROM e{k}" for k, v in enumerate(out[1:])]
    return ", ".join(f"{'ewm' if k == 4 else f'e{k}'} AS ({v})" for k, v in enumerate(steps))
