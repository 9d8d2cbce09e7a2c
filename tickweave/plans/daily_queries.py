"""Queries of the daily panel and of the second dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.operators import daily as D
from tickweave.operators import hf as H
from tickweave.plans.grid_queries import ORACLE as GRID
from tickweave.plans.panels import DAILY, ORDERED, TICKS, daily_returns, ewm_sql, rows, tick_panel

_FEATURES = ("momentum_sum", "reversal_sum", "mean_return", "volatility", "downside_volatility", "skewness", "kurtosis", "max_return", "min_return", "autocorrelation_lag1", "market_residual_momentum")
_N, _LEAST = 5, 4
_SPEC = D.ExperimentSpec("momentum_sum", 2, 2, "1996-03-01", "1999-06-01", max_abs_return=0.5)
BY = "PARTITION BY ticker ORDER BY date"


def d_features(spark: SparkSession, folder: str) -> DataFrame:
    x = D.features(D.sanitize(daily_returns(spark, folder), 0.5), _FEATURES, _N, _LEAST)
    return x.select("date", "ticker", "ret", *(F.round(f, 5).alias(f) for f in _FEATURES))


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return D.forward_label(D.feature(D.sanitize(daily_returns(spark, folder), 0.5), "momentum_sum", 2), 2)


def d11_label(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled(spark, folder).select("date", "ticker", F.round("label", 7).alias("label"))


def d13_rank_ic(spark: SparkSession, folder: str) -> DataFrame:
    return D.rank_ic(_labelled(spark, folder), 5).select("date", F.round("rank_ic", 6).alias("rank_ic"), "n")


def d14_spread(spark: SparkSession, folder: str) -> DataFrame:
    return D.quantile_spread(_labelled(spark, folder), 5).select("date", F.round("spread", 7).alias("spread"))


def d15_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    e = D.evaluate(_labelled(spark, folder), 5)
    return e.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in e.dtypes))


def d12_d17_experiment(spark: SparkSession, folder: str) -> DataFrame:
    e = _SPEC.run(daily_returns(spark, folder))
    return e.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in e.dtypes))


def flagship_bar_rank_ic(spark: SparkSession, folder: str) -> DataFrame:
    """Scan, grid, expression, label and cross-section in one plan: the rank IC of each five-minute bar of a
    three-bar momentum against the next bar's return."""
    from pyspark.sql import Window as W

    from tickweave.operators.expr import Panel, evaluate
    from tickweave.plans.grid_queries import p1_series

    bars = p1_series(spark, folder).withColumn("close", F.coalesce("last_close", "grid_close"))
    x = evaluate(bars, {"feature": ["pct_change", "close", 3]}, Panel(("code", "trade_day"), ("minute_of_day",)), keep=["code", "trade_day", "minute_of_day", "close"])
    after = F.lead("close").over(W.partitionBy("code", "trade_day").orderBy("minute_of_day"))
    x = x.select(F.concat_ws(" ", "trade_day", F.col("minute_of_day").cast("string")).alias("date"), "feature", (F.try_divide(after, F.col("close")) - 1).alias("label"))
    return D.rank_ic(x, 3).select(F.col("date").alias("bar"), F.round("rank_ic", 6).alias("rank_ic"), "n")


def d16_axes(spark: SparkSession, folder: str) -> DataFrame:
    r = daily_returns(spark, folder)
    return D.axis_differences(r, r.filter("ret is not null"))


def s2_unpivot(spark: SparkSession, folder: str) -> DataFrame:
    """Wide matrix of the returns by the last digit of the ticker, and back to long."""
    wide = daily_returns(spark, folder).withColumn("t", F.substring("ticker", -1, 1)).groupBy("date").pivot("t", [str(i) for i in range(10)]).agg(F.round(F.avg("ret"), 9))
    return D.unpivot(wide).select("date", "ticker", "ticker_ord", F.round("ret", 7).alias("ret"))


def h_helpers(spark: SparkSession, folder: str) -> DataFrame:
    r = H.Rolling()
    df = r.prepared(tick_panel(spark, folder), 1)
    c, v, a, b, l = (F.col(x) for x in ("close", "volume", "askP1", "bidP1", "last_close"))
    cols = {
        "h1_num": H.num(df, "nothing"), "h2_sum_cols": H.sum_cols([a, b]), "h3_safe_div": H.safe_div(c * 0.3771912837, v), "h4_mean": r.mean(c, 4), "h4_sum": r.sum(c, 4), "h5_std": r.std(c, 4), "h6_cov": r.cov(c, b * 0.3771912837, 6), "h6_corr": r.corr(a, b, 6),
        "h7_conditional": r.conditional_mean(c, v, 6), "h8_beta": r.beta(c, b, 6), "h9_integral": r.integral(a, 3), "h12_coherence": r.coherence(c - l, 7), "h13_path": r.path_ratio(c, 5), "h14_min": r.min(c, 4), "h14_max": r.max(c, 4), "h14_median": r.median(c, 4),
        "h15_quantile": r.quantile(c, 5, 0.3), "h16_skew": r.skew(c, 6), "h17_mean": r.expanding(c * 0.3771912837, "mean"), "h17_min": r.expanding(c, "min"), "h17_max": r.expanding(c, "max"), "h18_cumsum": r.cumsum(c), "h19_rank": r.rank(c) * 0.3771912837, "h20_shift": r.shift(c, 2), "h20_diff": r.diff(c, 2), "h20_pct": r.pct_change(c, 2),
        "h21_sign": H.sign(c - l), "h21_abs": H.absolute(c - l), "h21_sqrt": H.sqrt(c), "h21_exp": H.exp(c - l), "h21_log": H.log(c), "h21_clip": H.clip(c, 5, 50), "h22_first": r.first(c), "h23_open": r.session_open(df), "h24_zscore": r.zscore(c, 12), "h25_where": H.where(c > l, c, l),
        "h26_mid": H.mid_price(df), "h26_log_return": r.mid_log_return(df), "h26_spread": H.spread(df), "h27_depth": H.depth(df, "bid", 1), "h27_imbalance": H.book_imbalance(df, 1), "h28_pressure": H.lob_pressure(df, 1, 0.5), "h29_space": H.space_decay([F.col("bidV1"), -F.col("askV1")], 0.5),
        "h31_weighted": r.volume_weighted(c, v, 5), "h32_distance": r.vector_zdistance(df, 1, 20), "h33_noise": F.log1p(r.noise_trace(df, 20)), "h34_cost": H.cost_adjusted_score(c - l, r.std(c, 4), H.spread(df)), "h34_band": H.no_trade_band_distance(c - l, H.spread(df), r.std(c, 4)),
    }
    return df.select("seq", *(F.round(x, 5).alias(k) for k, x in cols.items()))


def h10_decays(spark: SparkSession, folder: str) -> DataFrame:
    df = tick_panel(spark, folder).withColumn("prod", F.col("close") * F.col("volume"))
    out = H.decays(df, [("h10_decay", "close", 20.0), ("h11_ewma", "close", H.half_life(0.0637)), ("h30_interaction", "prod", 20.0)])
    return out.select("seq", *(F.round(c, n).alias(c) for c, n in (("h10_decay", 4), ("h11_ewma", 4), ("h30_interaction", 0))))


def h37_variants(spark: SparkSession, folder: str) -> DataFrame:
    df = tick_panel(spark, folder)
    v = H.variants("volume", F.col("volume"))
    return df.select("seq", *(F.round(x, 5).alias(k) for k, x in v.items()))


def _least(agg: str, n: str = "ret") -> str:
    return f"CASE WHEN count({n}) {rows(_N, BY)} >= {_LEAST} THEN {agg} END"


def _w(f: str) -> str:
    return f"{f} {rows(_N, BY)}"


_X, _Y = ("CASE WHEN ret IS NOT NULL AND prev IS NOT NULL THEN ret END", "CASE WHEN ret IS NOT NULL AND prev IS NOT NULL THEN prev END")
_SANE = DAILY + ", r AS (SELECT date, ticker, ticker_ord, CASE WHEN abs(ret) <= 0.5 THEN ret END AS ret FROM daily), p AS (SELECT *, lag(ret) OVER (PARTITION BY ticker ORDER BY date) AS prev, ret - avg(ret) OVER (PARTITION BY date) AS rest FROM r)"
_D = {
    "momentum_sum": _least(_w("sum(ret)")), "reversal_sum": _least("-" + _w("sum(ret)")), "mean_return": _least(_w("avg(ret)")), "volatility": _least(_w("stddev_samp(ret)")), "downside_volatility": _least(f"sqrt({_w('avg(power(CASE WHEN ret < 0 THEN ret ELSE 0 END, 2))')})", "*"),
    "skewness": _least(f"CASE WHEN count(ret) {rows(_N, BY)} >= 3 THEN {_w('skewness(ret)')} END"), "kurtosis": _least(_w("kurtosis(ret)")), "max_return": _least(_w("max(ret)")), "min_return": _least(_w("min(ret)")),
    "autocorrelation_lag1": f"CASE WHEN {_w(f'count({_X})')} >= {_LEAST} THEN {_w(f'covar_samp({_X}, {_Y})')} / nullif({_w(f'stddev_samp({_X})')} * {_w(f'stddev_samp({_Y})')}, 0) END", "market_residual_momentum": f"CASE WHEN {_w('count(rest)')} >= {_LEAST} THEN {_w('sum(rest)')} END",
}
_LAB = _SANE + (
    f", m AS (SELECT date, ticker, ticker_ord, CASE WHEN count(ret) {rows(2, BY)} >= 2 THEN sum(ret) {rows(2, BY)} END AS feature, (1 + lead(ret, 1) OVER ({BY})) * (1 + lead(ret, 2) OVER ({BY})) - 1 AS label FROM r)"
    ", v AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY feature) + (count(*) OVER (PARTITION BY date, feature) - 1) / CAST(2 AS DOUBLE) AS rf, rank() OVER (PARTITION BY date ORDER BY label) + (count(*) OVER (PARTITION BY date, label) - 1) / CAST(2 AS DOUBLE) AS rl,"
    " row_number() OVER (PARTITION BY date ORDER BY feature, ticker_ord) / CAST(count(*) OVER (PARTITION BY date) AS DOUBLE) AS sh FROM m WHERE feature IS NOT NULL AND label IS NOT NULL)"
    ", ic AS (SELECT date, (count(*) * sum(rf * rl) - sum(rf) * sum(rl)) / nullif(sqrt(count(*) * sum(rf * rf) - sum(rf) * sum(rf)) * sqrt(count(*) * sum(rl * rl) - sum(rl) * sum(rl)), 0) AS rank_ic, count(*) AS n FROM v GROUP BY date HAVING count(*) >= 5 AND rank_ic IS NOT NULL)"
    ", q AS (SELECT date, avg(label) FILTER (sh > 0.8) - avg(label) FILTER (sh <= 0.2) AS spread FROM v GROUP BY date HAVING count(*) >= 5 AND spread IS NOT NULL)"
)
_z = lambda x: f"coalesce(CASE WHEN NOT isnan({x}) AND NOT isinf({x}) THEN {x} END, 0)"
_dz = lambda a, b: f"coalesce(({a}) / nullif({b}, 0), 0)"
_E6 = "CAST(1e-6 AS DOUBLE)"
_lag = lambda x, k: f"lag({x}, {k}) OVER ({ORDERED})"
_ok = lambda x, y: f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {x} END"
_UP = f"OVER ({ORDERED} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_log = lambda x: f"coalesce(ln(greatest({x}, CAST(1e-12 AS DOUBLE))), 0)"
_zs = lambda x, n: _dz(f"{x} - avg({x}) {rows(n)}", f"stddev_samp({x}) {rows(n)}")
_STD = lambda x, n: f"coalesce(stddev_samp({x}) {rows(n)}, 0)"
_MID, _SPREAD, _IMB = "((askP1 + bidP1) / 2)", _dz("askP1 - bidP1", f"(askP1 + bidP1) / 2 + {_E6}"), _dz("bidV1 - askV1", f"bidV1 + askV1 + {_E6}")
_MLR = _log(_dz(_MID, "CASE WHEN last_close > 0 THEN last_close ELSE prev_close END"))
_a, _b = _ok("close", "bidP1"), _ok("bidP1", "close")
_p, _q = _ok("askP1", "bidP1"), _ok("bidP1", "askP1")
_COV = f"coalesce(covar_samp({_a}, {_b}) {rows(6)}, 0)"
_PRESS = (_dz("bidV1", "1"), _dz("askV1", "1"))
_H = {
    "h1_num": "CAST(NULL AS DOUBLE)", "h2_sum_cols": "askP1 + bidP1", "h3_safe_div": _dz("close * CAST(0.3771912837 AS DOUBLE)", "volume"), "h4_mean": f"avg(close) {rows(4)}", "h4_sum": f"sum(close) {rows(4)}", "h5_std": _STD("close", 4), "h6_cov": f"coalesce(covar_samp({_a}, {_b} * CAST(0.3771912837 AS DOUBLE)) {rows(6)}, 0)",
    "h6_corr": f"coalesce(covar_samp({_p}, {_q}) {rows(6)} / nullif(stddev_samp({_p}) {rows(6)} * stddev_samp({_q}) {rows(6)}, 0), 0)", "h7_conditional": f"coalesce(avg(CASE WHEN volume > vm THEN close END) {rows(6)}, avg(close) {rows(6)}, 0)",
    "h8_beta": f"{_COV} / (power({_STD('bidP1', 6)}, 2) + {_E6})", "h9_integral": f"sum(askP1) {rows(3)}", "h12_coherence": f"avg(coalesce(sign(close - last_close), 0)) {rows(7)}", "h13_path": _dz(f"coalesce(abs(close - {_lag('close', 5)}), 0)", f"sum(abs(d1)) {rows(5)} + {_E6}"),
    "h14_min": f"coalesce(min(close) {rows(4)}, 0)", "h14_max": f"coalesce(max(close) {rows(4)}, 0)", "h14_median": f"coalesce(median(close) {rows(4)}, 0)", "h15_quantile": f"coalesce(quantile_cont(close, 0.3) {rows(5)}, 0)", "h16_skew": f"coalesce(CASE WHEN count(close) {rows(6)} >= 3 AND stddev_samp(close) {rows(6)} > 0 THEN skewness(close) {rows(6)} END, 0)",
    "h17_mean": f"coalesce(avg(close * CAST(0.3771912837 AS DOUBLE)) {_UP}, 0)", "h17_min": f"coalesce(min(close) {_UP}, 0)", "h17_max": f"coalesce(max(close) {_UP}, 0)", "h18_cumsum": f"CASE WHEN close IS NOT NULL THEN sum(close) {_UP} ELSE 0 END",
    "h19_rank": "CAST(0.3771912837 AS DOUBLE) * coalesce(CASE WHEN close IS NOT NULL THEN (rank() OVER (PARTITION BY date, code ORDER BY close NULLS LAST) + (count(*) OVER (PARTITION BY date, code, close) - 1) / CAST(2 AS DOUBLE)) / count(close) OVER (PARTITION BY date, code) END, 0.5)",
    "h20_shift": f"coalesce({_lag('close', 2)}, 0)", "h20_diff": f"coalesce(close - {_lag('close', 2)}, 0)", "h20_pct": f"coalesce(filled / {_lag('filled', 2)} - 1, 0)", "h21_sign": "coalesce(CAST(sign(close - last_close) AS DOUBLE), 0)", "h21_abs": "coalesce(abs(close - last_close), 0)", "h21_sqrt": "coalesce(sqrt(greatest(close, 0)), 0)",
    "h21_exp": "exp(CASE WHEN close - last_close > 20 OR close - last_close IS NULL THEN 20 ELSE close - last_close END)", "h21_log": "ln(coalesce(close, CAST(1e-12 AS DOUBLE)))", "h21_clip": "coalesce(CASE WHEN close IS NOT NULL THEN greatest(CAST(5 AS DOUBLE), least(CAST(50 AS DOUBLE), close)) END, 0)",
    "h22_first": f"first_value(close IGNORE NULLS) OVER ({ORDERED} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", "h23_open": f"coalesce(first_value(close IGNORE NULLS) OVER ({ORDERED} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0)", "h24_zscore": _zs("close", 12), "h25_where": "coalesce(CASE WHEN close > last_close THEN close ELSE last_close END, 0)",
    "h26_mid": _MID, "h26_log_return": _MLR, "h26_spread": _SPREAD, "h27_depth": "bidV1", "h27_imbalance": _IMB, "h28_pressure": _dz("bp - ap", f"bp + ap + {_E6}"), "h29_space": _dz("bidV1 - askV1 * exp(CAST(-0.5 AS DOUBLE))", f"abs(bidV1) + abs(askV1) * exp(CAST(-0.5 AS DOUBLE)) + {_E6}"),
    "h31_weighted": _dz(f"sum(close * volume) {rows(5)}", f"sum(volume) {rows(5)} + {_E6}"), "h32_distance": f"sqrt(power({_zs('bidV1', 20)}, 2) + power({_zs('askV1', 20)}, 2) + power({_zs('db', 20)}, 2) + power({_zs('da', 20)}, 2))",
    "h33_noise": f"ln(1 + power({_STD('mlr', 20)}, 2) + power({_STD('ds', 20)}, 2) + power({_STD('di', 20)}, 2) + power({_STD('dd', 20)}, 2))", "h34_cost": _dz("close - last_close", f"abs({_STD('close', 4)}) + abs(spread) + {_E6}"), "h34_band": f"greatest(coalesce(abs(close - last_close) - abs(spread) - 0.5 * {_STD('close', 4)}, 0), 0) * sign(close - last_close)",
}
_BASE = (
    f"{TICKS}, x0 AS (SELECT *, {_lag('close', 1)} AS prev_close, {_SPREAD} AS spread, {_IMB} AS imb, {_dz('bidV1 + askV1', f'volume + {_E6}')} AS dep, avg(volume) {rows(6)} AS vm, coalesce(close - {_lag('close', 1)}, 0) AS d1, coalesce(bidP1 - {_lag('bidP1', 1)}, 0) AS db, coalesce(askP1 - {_lag('askP1', 1)}, 0) AS da,"
    f" last_value(close IGNORE NULLS) {_UP} AS filled, CASE WHEN askP1 IS NULL OR bidP1 IS NULL THEN 0 ELSE {_PRESS[0]} END AS bp, CASE WHEN askP1 IS NULL OR bidP1 IS NULL THEN 0 ELSE {_PRESS[1]} END AS ap FROM panel),"
    f" x AS (SELECT *, {_MLR} AS mlr, coalesce(spread - {_lag('spread', 1)}, 0) AS ds, coalesce(imb - {_lag('imb', 1)}, 0) AS di, coalesce(dep - {_lag('dep', 1)}, 0) AS dd FROM x0)"
)
_V = {"volume": "coalesce(s, 0)", "volume_flip": "coalesce(-s, 0)", "volume_roll5": f"avg(s) {rows(5)}", "volume_roll20": f"avg(s) {rows(20)}", "volume_z20": _zs("s", 20), "volume_norm5": _dz("s", _STD("s", 5)), "volume_norm20": _dz("s", _STD("s", 20))}
_R = lambda d, n: ", ".join(f"round({v}, {n}) AS {k}" for k, v in d.items())
_EVAL = "SELECT round((SELECT avg(rank_ic) FROM {ic}), 6) AS mean_ic, round((SELECT stddev_samp(rank_ic) FROM {ic}), 6) AS std_ic, round((SELECT avg(CAST(rank_ic > 0 AS INTEGER)) FROM {ic}), 6) AS positive_ratio, (SELECT count(*) FROM {ic}) AS n_days, round((SELECT avg(spread) FROM {q}), 6) AS qspread_mean, round((SELECT count(*) FROM {v}) / nullif(CAST((SELECT count(label) FROM {m}) AS DOUBLE), 0), 6) AS finite_ratio, (SELECT count(*) FROM {v}) AS n_obs, round((SELECT avg(rank_ic) / stddev_samp(rank_ic) FROM {ic}), 6) AS icir"
_BARS = (
    f"s AS (SELECT *, coalesce(last_close, grid_close) AS close FROM ({GRID['p1_series']})), f AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY code, trade_day ORDER BY minute_of_day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c, lead(close) OVER (PARTITION BY code, trade_day ORDER BY minute_of_day) AS nxt FROM s), "
    "g AS (SELECT trade_day || ' ' || minute_of_day AS bar, c / nullif(lag(c, 3) OVER (PARTITION BY code, trade_day ORDER BY minute_of_day), 0) - 1 AS feature, nxt / nullif(close, 0) - 1 AS label FROM f), "
    "v AS (SELECT bar, rank() OVER (PARTITION BY bar ORDER BY feature) + (count(*) OVER (PARTITION BY bar, feature) - 1) / CAST(2 AS DOUBLE) AS rf, rank() OVER (PARTITION BY bar ORDER BY label) + (count(*) OVER (PARTITION BY bar, label) - 1) / CAST(2 AS DOUBLE) AS rl FROM g WHERE feature IS NOT NULL AND label IS NOT NULL)"
)
ORACLE = {
    "flagship_bar_rank_ic": f"WITH {_BARS} SELECT bar, round(covar_samp(rf, rl) / nullif(stddev_samp(rf) * stddev_samp(rl), 0), 6) AS rank_ic, count(*) AS n FROM v GROUP BY bar HAVING count(*) >= 3 AND rank_ic IS NOT NULL",
    "d_features": f"WITH {_SANE} SELECT date, ticker, ret, {_R(_D, 5)} FROM p",
    "d11_label": f"WITH {_LAB} SELECT date, ticker, round(label, 7) AS label FROM m",
    "d13_rank_ic": f"WITH {_LAB} SELECT date, round(rank_ic, 6) AS rank_ic, n FROM ic",
    "d14_spread": f"WITH {_LAB} SELECT date, round(spread, 7) AS spread FROM q",
    "d15_evaluation": f"WITH {_LAB} " + _EVAL.format(ic="ic", q="q", v="v", m="m"),
    "d12_d17_experiment": "WITH " + _LAB.replace(">= 5", ">= 2").replace("FROM m WHERE", f"FROM mm WHERE").replace(", v AS (", f", mm AS (SELECT * FROM m WHERE date BETWEEN DATE '{_SPEC.first}' AND DATE '{_SPEC.last}'), v AS (") + f" SELECT *, '{_SPEC.id}' AS experiment_id FROM (" + _EVAL.format(ic="ic", q="q", v="v", m="mm") + ")",
    "d16_axes": f"WITH {DAILY} SELECT date, ticker, 'a' AS only_in FROM daily WHERE ret IS NULL",
    "s2_unpivot": f"WITH {DAILY}, d AS (SELECT DISTINCT date FROM daily), t AS (SELECT CAST(unnest(range(10)) AS INTEGER) AS i) SELECT d.date, CAST(i AS VARCHAR) AS ticker, i AS ticker_ord, round((SELECT round(avg(ret), 9) FROM daily x WHERE x.date = d.date AND right(ticker, 1) = CAST(i AS VARCHAR)), 7) AS ret FROM d, t",
    "h_helpers": f"WITH {_BASE} SELECT seq, {_R(_H, 5)} FROM x",
    "h10_decays": f"WITH {TICKS}, {ewm_sql('panel', {'d': ('close', 20.0, False), 'e': ('close', H.half_life(0.0637), False), 'p': ('close * volume', 20.0, False)})} SELECT seq, round(coalesce(m_d, 0), 4) AS h10_decay, round(coalesce(m_e, 0), 4) AS h11_ewma, round(coalesce(m_p, 0), 0) AS h30_interaction FROM ewm",
    "h37_variants": f"WITH {TICKS}, y AS (SELECT *, volume AS s FROM panel) SELECT seq, {_R(_V, 5)} FROM y",
}
QUERIES = {"flagship_bar_rank_ic": flagship_bar_rank_ic, "d_features": d_features, "d11_label": d11_label, "d13_rank_ic": d13_rank_ic, "d14_spread": d14_spread, "d15_evaluation": d15_evaluation, "d12_d17_experiment": d12_d17_experiment, "d16_axes": d16_axes, "s2_unpivot": s2_unpivot, "h_helpers": h_helpers, "h10_decays": h10_decays, "h37_variants": h37_variants}
