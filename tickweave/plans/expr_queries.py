"""Queries of the expression language: one column per operator."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.operators import expr as E
from tickweave.operators.plugins import user_factor
from tickweave.plans.panels import ORDERED, TICKS, ewm_sql, rows, tick_panel

A, B = "close", "volume"
SCALARS = {
    "e1_add": ["add", A, "bidP1"], "e2_sub": ["sub", A, "bidP1"], "e3_mul": ["mul", A, B], "e4_div": ["div", A, B], "e5_safe_div": ["safe_div", A, B], "e6_neg": ["neg", A],
    "e7_abs": ["abs", ["sub", A, "askP1"]], "e8_clip": ["clip", A, 10, 100], "e9_log1p": ["log1p", A], "e10_log": ["log", A], "e11_tanh": ["tanh", ["sub", A, "bidP1"]], "e12_sign": ["sign", ["sub", A, "last_close"]],
    "e13_max": ["max", A, "askP1"], "e14_min": ["min", A, "askP1"], "e15_gt": ["gt", A, "last_close"], "e15_lt": ["lt", A, "last_close"], "e15_ge": ["ge", A, "last_close"], "e15_le": ["le", A, "last_close"],
    "e15_eq": ["eq", A, "bidP1"], "e16_neq": ["neq", A, "bidP1"], "e17_and": ["and", ["gt", A, "last_close"], B], "e17_or": ["or", ["gt", A, "last_close"], B], "e18_where": ["where", ["sub", A, "bidP1"], A, "bidP1"], "e19_literal": ["add", A, 1.5],
}
WINDOWS = {
    "w1_mean": ["rolling_mean", A, 5], "w2_std": ["rolling_std", A, 5], "w3_sum": ["rolling_sum", A, 5], "w4_min": ["rolling_min", A, 5], "w4_max": ["rolling_max", A, 5], "w5_median": ["rolling_median", A, 5],
    "w6_rank": ["rolling_rank", A, 5], "w7_count": ["rolling_count", ["gt", A, "last_close"], 5], "w8_zscore": ["zscore", A, 20], "w11_diff": ["diff", A, 2], "w12_shift": ["shift", A, 3], "w13_pct_change": ["pct_change", A, 2],
    "w14_corr": ["rolling_corr", "askP1", "bidP1", 8], "w15_cov": ["rolling_cov", ["mul", A, 0.37719], "bidP1", 8], "w16_beta": ["rolling_beta", A, "bidP1", 8], "w17_div_mean": ["div_mean", A, "last_close", 5], "w18_div_std": ["div_std", A, "last_close", 5], "w19_vol_scale": ["vol_scale", A, 12], "w20_rank": ["rank", A],
}
EWMS = {"w9_ewm_mean": ["ewm_mean", A, 3], "w10_ewm_std": ["ewm_std", A, 3], "nested": ["where", ["gt", ["rolling_mean", A, 2], A], ["div_mean", ["sub", "bidV1", "askV1"], ["add", "bidV1", "askV1"], 2], ["neg", ["ewm_mean", ["diff", B, 1], 2]]]}
#: Candidate expressions of the front-end query: two equal ones in other notations, a negated one and faulty ones.
CANDIDATES = (
    '["div",["sub","askP1","bidP1"],["add","bidP1","askP1"]]', '{"op":"div","args":[["sub","askP1","bidP1"],{"op":"add","args":["askP1","bidP1"]}]}', '["neg",["rolling_std",["diff","close",1.0],12]]',
    '["zscore","volume"]', '["tanh",["vol_scale",["clip",["pct_change","close",3],-1,1],30]]', '["halve","close"]', '["diff","ret10s",2]', '["shift","volume",-4]', '["add","bidV1",["neg","bidV1"]]', '["mul",1,["add","askP1",0]]',
)


def _rounded(df: DataFrame, names, digits: int = 6) -> DataFrame:
    return df.select("seq", *(F.round(n, digits).alias(n) for n in names))


def e_scalars(spark: SparkSession, folder: str) -> DataFrame:
    exact = {"e4_div", "e5_safe_div", "e3_mul"}
    x = E.evaluate(tick_panel(spark, folder), SCALARS, keep=["seq"])
    return x.select("seq", *(F.col(n) if n in exact else F.round(n, 6).alias(n) for n in SCALARS))


def w_windows(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(E.evaluate(tick_panel(spark, folder), WINDOWS, keep=["seq"]), WINDOWS)


def w_ewm(spark: SparkSession, folder: str) -> DataFrame:
    names = ["w9_ewm_mean", "nested"]
    return _rounded(E.evaluate(tick_panel(spark, folder), {k: EWMS[k] for k in names}, keep=["seq"]), names)


def w10_ewm_std(spark: SparkSession, folder: str) -> DataFrame:
    """Tested against pandas: by sums, as in SQL, the deviation loses its places after long gaps."""
    return _rounded(E.evaluate(tick_panel(spark, folder), {"w10_ewm_std": EWMS["w10_ewm_std"]}, keep=["seq"]), ["w10_ewm_std"])


def w21_derived(spark: SparkSession, folder: str) -> DataFrame:
    names = ["spread_l1", "mid_price_l1", "relative_spread_l1", "depth_imbalance_l1", "microprice_l1", "log_volume", "volume_shock_20_120", "activity_surge_20_120"]
    return _rounded(E.derived_features(tick_panel(spark, folder)), names, 10)


def f_front_end(spark: SparkSession, folder: str) -> DataFrame:
    """Parse, analyse, canonicalise, key and print each candidate (driver work by nature; no table is read)."""
    import json

    from tickweave.operators import prefix as P

    known = tick_panel(spark, folder).columns
    out = []
    for i, text in enumerate(CANDIDATES):
        tree = P.listed(json.loads(text))
        faults = E.validate(tree, known)
        ok = not faults
        out.append((i, ok, "; ".join(faults), E.fields(tree), E.windows(tree), E.infix(tree), P.text_of(P.canonical(tree)), sorted(E.ops(tree)), E.size(tree), E.factor_key(tree), E.equivalent(tree, json.loads(CANDIDATES[0])), E.sign_equivalent(tree, json.loads(CANDIDATES[0]))))
    return spark.createDataFrame(out, "candidate int, valid boolean, faults string, fields array<string>, windows array<int>, infix string, canonical string, ops array<string>, size int, factor_key string, equals_first boolean, equals_first_or_negated boolean")


def f9_correlation_equivalent(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of factors whose values correlate at 0.999 or more in size, from at least three complete pairs."""
    import itertools

    x = E.evaluate(tick_panel(spark, folder), {"mean5": ["rolling_mean", A, 5], "mean6": ["rolling_mean", A, 6], "neg": ["neg", A], "volume": B}, keep=["seq"])
    names = ["mean5", "mean6", "neg", "volume"]
    cols = []
    for a, b in itertools.combinations(names, 2):
        ok = F.col(a).isNotNull() & F.col(b).isNotNull()
        p, q = F.when(ok, F.col(a)), F.when(ok, F.col(b))
        r = F.try_divide(F.covar_samp(p, q), F.stddev_samp(p) * F.stddev_samp(q))
        cols.append(F.struct(F.lit(f"{a}~{b}").alias("pair"), F.round(r, 6).alias("corr"), (F.abs(r) >= 0.999).alias("equivalent"), F.count(p).alias("n")))
    return x.agg(F.array(*cols).alias("x")).select(F.explode("x").alias("y")).select("y.*").filter("n >= 3")


def f13_factor_values(spark: SparkSession, folder: str) -> DataFrame:
    tree = ["rolling_std", ["div_mean", A, "last_close", 5], 20]
    x = E.evaluate(tick_panel(spark, folder), {"value": tree}, keep=["seq"])
    return x.select(F.col("seq").alias("row_index"), F.lit("std_div_mean_5_20").alias("factor_id"), F.round("value", 6).alias("value"))


def user_factor_function(spark: SparkSession, folder: str) -> DataFrame:
    """A factor that a user wrote in Python, by panel."""
    def compute(pdf: pd.DataFrame) -> pd.Series:
        return pdf["close"] - pdf["close"].shift(1)

    x = user_factor(tick_panel(spark, folder).select("date", "code", "delay_time", "seq", "close"), compute)
    return x.select("seq", F.round("factor", 6).alias("factor"))


def t(c: str) -> str:
    return f"coalesce({c} <> 0, true)"


_E = {
    "e1_add": f"round({A} + bidP1, 6)", "e2_sub": f"round({A} - bidP1, 6)", "e3_mul": f"{A} * {B}", "e4_div": f"CASE WHEN {B} = 0 THEN CASE WHEN {A} > 0 THEN CAST('inf' AS DOUBLE) WHEN {A} < 0 THEN CAST('-inf' AS DOUBLE) END ELSE {A} / {B} END", "e5_safe_div": f"{A} / ({B} + CAST(1e-12 AS DOUBLE))",
    "e6_neg": f"round(-{A}, 6)", "e7_abs": f"round(abs({A} - askP1), 6)", "e8_clip": f"CASE WHEN {A} IS NOT NULL THEN round(greatest(CAST(10 AS DOUBLE), least(CAST(100 AS DOUBLE), {A})), 6) END", "e9_log1p": f"round(ln(1 + {A}), 6)", "e10_log": f"round(ln(abs({A}) + CAST(1e-12 AS DOUBLE)), 6)", "e11_tanh": f"round(tanh({A} - bidP1), 6)", "e12_sign": f"CAST(sign({A} - last_close) AS DOUBLE)",
    "e13_max": f"CASE WHEN {A} IS NOT NULL AND askP1 IS NOT NULL THEN round(greatest({A}, askP1), 6) END", "e14_min": f"CASE WHEN {A} IS NOT NULL AND askP1 IS NOT NULL THEN round(least({A}, askP1), 6) END", **{f"e15_{n}": f"CAST(CAST(coalesce({A} {o} {b}, false) AS INTEGER) AS DOUBLE)" for n, o, b in (("gt", ">", "last_close"), ("lt", "<", "last_close"), ("ge", ">=", "last_close"), ("le", "<=", "last_close"), ("eq", "=", "bidP1"))},
    "e16_neq": f"CAST(CAST(coalesce({A} <> bidP1, true) AS INTEGER) AS DOUBLE)", "e17_and": f"CAST(CAST(coalesce({A} > last_close, false) AND {t(B)} AS INTEGER) AS DOUBLE)", "e17_or": f"CAST(CAST(coalesce({A} > last_close, false) OR {t(B)} AS INTEGER) AS DOUBLE)", "e18_where": f"round(CASE WHEN {t(f'({A} - bidP1)')} THEN {A} ELSE bidP1 END, 6)", "e19_literal": f"round({A} + CAST(1.5 AS DOUBLE), 6)",
}
_PAIR = lambda x, y: (f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {y} END")
_p, _q = _PAIR("askP1", "bidP1")
_c, _d = _PAIR(A, "bidP1")
_W = {
    "w1_mean": f"avg({A}) {rows(5)}", "w2_std": f"stddev_samp({A}) {rows(5)}", "w3_sum": f"sum({A}) {rows(5)}", "w4_min": f"min({A}) {rows(5)}", "w4_max": f"max({A}) {rows(5)}", "w5_median": f"median({A}) {rows(5)}",
    "w6_rank": f"CASE WHEN {A} IS NOT NULL THEN (len(list_filter(h, lambda v: v < {A})) + (len(list_filter(h, lambda v: v = {A})) + 1) / CAST(2 AS DOUBLE)) / len(h) END", "w7_count": f"sum(CAST(CAST(coalesce({A} > last_close, false) AS INTEGER) AS DOUBLE)) {rows(5)}",
    "w8_zscore": f"({A} - avg({A}) {rows(20)}) / (nullif(stddev_samp({A}) {rows(20)}, 0) + CAST(1e-12 AS DOUBLE))", "w11_diff": f"{A} - lag({A}, 2) OVER ({ORDERED})", "w12_shift": f"lag({A}, 3) OVER ({ORDERED})", "w13_pct_change": f"filled / lag(filled, 2) OVER ({ORDERED}) - 1",
    "w14_corr": f"covar_samp({_p}, {_q}) {rows(8)} / nullif(stddev_samp({_p}) {rows(8)} * stddev_samp({_q}) {rows(8)}, 0)", "w15_cov": f"covar_samp({_c} * CAST(0.37719 AS DOUBLE), {_d}) {rows(8)}", "w16_beta": f"covar_samp({_c}, {_d}) {rows(8)} / (var_samp(bidP1) {rows(8)} + CAST(1e-12 AS DOUBLE))",
    "w17_div_mean": f"avg({A} / (last_close + CAST(1e-12 AS DOUBLE))) {rows(5)}", "w18_div_std": f"stddev_samp({A} / (last_close + CAST(1e-12 AS DOUBLE))) {rows(5)}", "w19_vol_scale": f"{A} / (stddev_samp({A}) {rows(12)} + CAST(1e-12 AS DOUBLE))",
    "w20_rank": f"CASE WHEN {A} IS NOT NULL THEN (rank() OVER (PARTITION BY date, code ORDER BY {A} NULLS LAST) + (count(*) OVER (PARTITION BY date, code, {A}) - 1) / CAST(2 AS DOUBLE)) / count({A}) OVER (PARTITION BY date, code) END",
}
_FILLED = f"x AS (SELECT *, last_value({A} IGNORE NULLS) OVER ({ORDERED} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled, list_filter(list({A}) {rows(5)}, lambda v: v IS NOT NULL) AS h FROM panel)"
_EPS = "CAST(1e-12 AS DOUBLE)"
_DERIVED = {
    "spread_l1": "askP1 - bidP1", "mid_price_l1": "(askP1 + bidP1) / 2", "relative_spread_l1": f"(askP1 - bidP1) / ((askP1 + bidP1) / 2 + {_EPS})", "depth_imbalance_l1": f"(bidV1 - askV1) / (bidV1 + askV1 + {_EPS})", "microprice_l1": f"(askP1 * bidV1 + bidP1 * askV1) / (bidV1 + askV1 + {_EPS})",
    "log_volume": "ln(1 + nullif(volume, 0))", "volume_shock_20_120": f"avg(volume) {rows(20)} / (avg(volume) {rows(120)} + {_EPS})", "activity_surge_20_120": f"sum(abs(volume)) {rows(20)} / (avg(abs(volume)) {rows(120)} + {_EPS})",
}
_CORR = " UNION ALL ".join(
    f"SELECT '{a}~{b}' AS pair, round(covar_samp({p}, {q}) / (stddev_samp({p}) * stddev_samp({q})), 6) AS corr, abs(covar_samp({p}, {q}) / (stddev_samp({p}) * stddev_samp({q}))) >= 0.999 AS equivalent, count({p}) AS n FROM y"
    for a, b in (("mean5", "mean6"), ("mean5", "neg"), ("mean5", "volume"), ("mean6", "neg"), ("mean6", "volume"), ("neg", "volume"))
    for p, q in (_PAIR(a, b),)
)
ORACLE = {
    "e_scalars": f"WITH {TICKS} SELECT seq, " + ", ".join(f"{v} AS {k}" for k, v in _E.items()) + " FROM panel",
    "w_windows": f"WITH {TICKS}, {_FILLED} SELECT seq, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in _W.items()) + " FROM x",
    "w_ewm": f"WITH {TICKS}, p1 AS (SELECT *, avg({A}) {rows(2)} AS m2, avg((bidV1 - askV1) / (bidV1 + askV1 + {_EPS})) {rows(2)} AS dm, {B} - lag({B}, 1) OVER ({ORDERED}) AS dv FROM panel), {ewm_sql('p1', {'a': (A, 3, True), 'v': ('dv', 2, True)})} SELECT seq, round(m_a, 6) AS w9_ewm_mean, round(CASE WHEN coalesce(m2 > {A}, false) THEN dm ELSE -m_v END, 6) AS nested FROM ewm",
    "user_factor_function": f"WITH {TICKS} SELECT seq, round(close - lag(close) OVER ({ORDERED}), 6) AS factor FROM panel",
    "w21_derived": f"WITH {TICKS} SELECT seq, " + ", ".join(f"round({v}, 10) AS {k}" for k, v in _DERIVED.items()) + " FROM panel",
    "f9_correlation_equivalent": f"WITH {TICKS}, y AS (SELECT avg({A}) {rows(5)} AS mean5, avg({A}) {rows(6)} AS mean6, -{A} AS neg, volume FROM panel) {_CORR}",
    "f13_factor_values": f"WITH {TICKS}, y AS (SELECT *, avg({A} / (last_close + {_EPS})) {rows(5)} AS m FROM panel) SELECT seq AS row_index, 'std_div_mean_5_20' AS factor_id, round(stddev_samp(m) {rows(20)}, 6) AS value FROM y",
}
QUERIES = {"e_scalars": e_scalars, "w_windows": w_windows, "w_ewm": w_ewm, "w10_ewm_std": w10_ewm_std, "w21_derived": w21_derived, "f_front_end": f_front_end, "f9_correlation_equivalent": f9_correlation_equivalent, "f13_factor_values": f13_factor_values, "user_factor_function": user_factor_function}
