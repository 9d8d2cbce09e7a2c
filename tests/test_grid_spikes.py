"""Regular grid and implausible ticks against plain Python."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickweave.functions.codes import normal_code
from tickweave.operators import spikes as S
from tickweave.operators.grid import regular_grid

SCHEMA = "tick_id long, code string, delay_time timestamp, close double, volume double, askP1 double, bidP1 double, source string, day string"


def _ts(h, m, s=0, day=3):
    return dt.datetime(2018, 1, day, h, m, s)


def _grid(df):
    return regular_grid(df, normal_code(F.col("code")), F.col("delay_time"), F.col("close"), F.col("tick_id"))


def test_codes(spark):
    got = spark.createDataFrame([("SZ008298",), ("8298",), (" 008298 ",), ("sh000001",), ("",), (None,), ("x",)], "c string").select(normal_code(F.col("c"))).collect()
    assert [r[0] for r in got] == ["008298", "008298", "008298", "000001", None, None, None]


def test_grid_interpolates_and_marks(spark):
    rows = [(1, "600001", _ts(9, 31), 10.0), (2, "SH600001", _ts(9, 41), 12.0), (3, "600001", _ts(9, 41), math.nan), (4, None, _ts(9, 50), 1.0), (5, "600001", None, 1.0), (6, "600001", _ts(14, 59), 20.0), (7, "600002", _ts(9, 0), 5.0), (8, "600001", _ts(9, 31), None)]
    df = spark.createDataFrame([(*r[:3], r[3], 1.0, 1.0, 1.0, "clash", "clash") for r in rows], SCHEMA)
    g = {(r["source"], r["minute"]): r for r in _grid(df).collect()}
    assert len(g) == 48 and {k[0] for k in g} == {"600001"}  # 600002 has no reading in the session
    assert g["600001", 570]["status"] == "observed" and g["600001", 570]["grid_value"] is None
    assert g["600001", 575]["status"] == "interpolated" and g["600001", 575]["grid_value"] == pytest.approx(10 + 2 * 4 / 10)
    assert g["600001", 580]["grid_value"] == pytest.approx(11.8) and g["600001", 580]["n_readings"] == 1
    assert g["600001", 600]["status"] == "missing"  # a gap of hours


def test_grid_empty(spark):
    assert _grid(spark.createDataFrame([], SCHEMA)).count() == 0


def _random_ticks(n=1500, seed=3):
    rng = np.random.default_rng(seed)
    t0, price, rows = _ts(9, 30), 50.0, []
    for i in range(n):
        price += float(rng.choice([-0.02, -0.01, 0, 0.01, 0.02]))
        rows.append([i, "600001", t0 + dt.timedelta(seconds=5 * i), round(price, 2), float(rng.integers(1, 80)) * 100, round(price + 0.01, 2), round(price - 0.01, 2)])
    return rows


def _judge(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    c = F.expr("try_cast(__c as int)")
    df = df.withColumn("__c", normal_code(F.col("code")))
    out = S.implausible(df, c, F.col("delay_time"), F.col("tick_id"), F.col("close"), F.col("volume"), F.col("askP1"), F.col("bidP1"), **kw)
    return {r["id"]: r["reasons"] for r in out.collect()}


def test_planted_values_are_flagged(spark):
    rows = _random_ticks()
    rows[100][3] *= 1.05  # spike
    rows[200][3] = -rows[200][3]
    rows[300][5], rows[300][6] = rows[300][6], rows[300][5]  # crossed
    rows[400][4] = 5e7
    for i in range(501, 520):
        rows[i][4] = rows[500][4]  # stuck: 500 is the first
    for i in range(700, 1500):
        for k in (3, 5, 6):
            rows[i][k] = round(rows[i][k] + 5, 2)  # a lasting move
    rows[600][3], rows[601][4], rows[602][4] = None, 0.0, None
    rows.append([9000, *rows[100][1:]])  # a copy of a case
    rows.append([9001, "600001", None, 1.0, -5.0, 2.0, 1.0])  # no time: physical limits alone
    rows.append([9002, None, _ts(10, 0), None, None, None, None])
    got = _judge(spark, rows)
    assert len(got) == len(rows)
    bad = {k for k, v in got.items() if v}
    assert bad == {100, 200, 300, 400, 9000, 9001} | set(range(501, 520))
    assert got[9001] == 1 and got[100] & 2 and got[400] & 16 and got[510] & 32
    assert _judge(spark, rows, broadcast_bytes=0) == got  # models joined instead of broadcast


def test_spikes_empty(spark):
    assert _judge(spark, []) == {}


def test_sequence_features_match_brute_force():
    rng = np.random.default_rng(1)
    n = 60
    source, day, us = np.repeat([1, 2], n // 2).astype(np.int32), np.ones(n, np.int32), np.arange(n) * 1000
    x = np.round(rng.normal(10, 0.1, n), 1)
    x[5], x[40] = np.nan, np.nan
    b = S.sequence_features(source, day, us, np.arange(n), {f: x.copy() for f in S.FIELDS})
    run = np.array(b.column("run_close"))
    for s in (1, 2):
        v = [i for i in range(n) if source[i] == s and not np.isnan(x[i])]
        i = 0
        while i < len(v):
            j = i
            while j + 1 < len(v) and x[v[j + 1]] == x[v[i]]:
                j += 1
            assert run[v[i]] == -(j - i + 1) and all(run[v[k]] == j - i + 1 for k in range(i + 1, j + 1))
            i = j + 1
        d = np.array(b.column("d_close"))
        for k in range(len(v)):
            y = np.log(x[v])
            before, after = y[max(0, k - 3) : k], y[k + 1 : k + 4]
            p, q = (y[k] - np.median(z) if len(z) else None for z in (before, after))
            want = q if p is None else p if q is None else (0 if p * q <= 0 else min(p, q, key=abs))
            assert d[v[k]] == pytest.approx(want, abs=1e-6)


def test_blocks_do_not_split_days():
    rows = pd.DataFrame({"source": np.repeat([1, 2, 3], 50).astype(np.int32), "day": np.int32(1), "us": np.tile(np.arange(50), 3), "id": np.arange(150)})
    import pyarrow as pa

    t = pa.table({**{c: rows[c] for c in rows}, **{f: np.random.default_rng(0).normal(5, 1, 150) for f in S.FIELDS}})
    old, S.BLOCK = S.BLOCK, 60
    try:
        parts = list(S._sequence_pass(iter(t.to_batches(max_chunksize=7))))
    finally:
        S.BLOCK = old
    whole = list(S._sequence_pass(iter(t.to_batches())))
    assert len(parts) > 1 and pa.Table.from_batches(parts).equals(pa.Table.from_batches(whole))


def test_the_forest_decides(spark):
    rows = _random_ticks(800)
    rows[100][3] *= 1.05
    rows[200][3] = -rows[200][3]
    rows[400][4] = 5e7
    for i in range(501, 520):
        rows[i][4] = rows[500][4]
    x = {k for k, v in _judge(spark, rows).items() if v}
    assert x == {100, 200, 400} | set(range(501, 520))
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    cols = [F.lit(1), F.col("delay_time"), F.col("tick_id"), F.col("close"), F.col("volume"), F.col("askP1"), F.col("bidP1")]
    scores = {r["id"]: r["score"] for r in S.implausible(df, *cols).collect()}
    assert {k for k, v in scores.items() if v >= S.SCORE} == x - {200}  # all but the physically impossible one
    without = {k for k, v in scores.items() if v >= 2}  # ablation: no score is ever high enough
    assert without == set() and x - without - {200} == {100, 400} | set(range(501, 520))
    flat = S.forest_score(np.ones((2, S.CELLS), np.float32), np.array([[0.1, 5.0]], np.float32))
    assert (flat == S.SCORE).all()  # a forest without cuts tells a spike from nothing


def test_paths_never_grow_beyond_the_readings():
    rng = np.random.default_rng(5)
    x = np.abs(rng.normal(0, 0.3, (3000, 2))).astype(np.float32)
    x[:20, 0] = 30  # what lies beyond the limit does not mask anything
    p = S.grow_forest(x, 3)
    assert p.shape == (2, S.CELLS) and (np.diff(p[:, S.CELLS // 2 :], axis=1) <= 1e-4).all()
    s = S.forest_score(p, np.array([[0.05, 0.05], [1.0, 1.0], [1.9, 50.0]], np.float32))
    assert (s[0] < 0.35).all() and s[1] == pytest.approx([S.SCORE, S.SCORE]) and (s[2] > S.SCORE).all()
    empty = S.grow_forest(np.full((3, 2), 9.0), 1)
    assert np.isfinite(S.forest_score(empty, np.zeros((2, 2), np.float32))).all()
