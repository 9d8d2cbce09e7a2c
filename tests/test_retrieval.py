"""Search, profiles, votes, bounded formulas and ranks against plain Python."""

import difflib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tickweave.operators import expr as E
from tickweave.operators import retrieval as R
from tickweave.operators import store as S
from tickweave.operators.plugins import encoded, user_factor
from tickweave.runtime import spread_join

ROWS = [
    (1, "W1", "Volatility of limit orders", "queues", None, "Ann Berg", "JTS"),
    (2, "W2", "Price impact", "the VOLATILITY smile", "risk", "Vola Tility", None),
    (3, "W3", None, None, None, None, None),
    (4, "W4", "波动率 forecasts", "volatile markets", None, "", "x"),
    (5, "W5", "volume " * 4000, "impact", None, "Carl Dahl", "volatility"),
]
SCHEMA = "rec_id long, id string, title string, abstract string, keywords string, authors string, metadata string, score string"


def _frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def _brute(rows, terms, synonyms):
    names = ["id", "title", "abstract", "keywords", "authors", "metadata"]
    low = [{n: (v or "").lower() for n, v in zip(names, r[1:])} for r in rows]
    vocabulary = sorted({w for f in low for w in re.findall(r"[a-z0-9][a-z0-9_-]*|[一-鿿]+", " ".join(f[n] for n in R.FIELDS))})
    out = {}
    for r, f in zip(rows, low):
        score = n = 0
        for t in terms:
            vs = [t, *synonyms.get(t, ())]
            best = max((w for v in vs for k, w in R.FIELDS.items() if v in f[k]), default=0)
            if not best:
                fix = difflib.get_close_matches(t, vocabulary, n=1, cutoff=0.78)
                best = max((0.82 * w for v in fix for k, w in R.FIELDS.items() if v in f[k]), default=0)
            n += best > 0
            score += best + (5 if best and any(v in f["authors"] for v in vs) else 0)
        letters = set("".join(terms))
        if n == len(terms):
            out[r[0]] = score + 0.25 * len(letters & set(" ".join(f[k] for k in R.FIELDS))) / len(letters)
    return out


@pytest.mark.parametrize("terms", [["volatilty"], ["volatility", "impct"], ["price", "impact"], ["zzzz"], ["波动率"], ["order"]])
def test_search_corrects_like_brute_force(spark, terms):
    synonyms = {"order": ("queues",)}
    got = {r["rec_id"]: r["score"] for r in R.search(_frame(spark), terms, synonyms).collect()}
    assert got == pytest.approx(_brute(ROWS, terms, synonyms))
    assert R.search(_frame(spark), []).count() == 0 and R.search(_frame(spark).filter("false"), terms).count() == 0


def test_profiles_need_no_pairs(spark):
    r = random.Random(3)
    rows = [(r.choice("abc"), [r.choice("uvwxyz") for _ in range(r.randrange(0, 5))]) for _ in range(60)] + [("d", ["q"]), ("e", []), (None, ["u"])]
    got = {x["g"]: x for x in R.group_profiles(spark.createDataFrame(rows, "g string, words array<string>"), "g", "words").collect()}
    cosine = lambda a, b: sum(a.count(w) * b.count(w) for w in set(a)) / (sum(a.count(w) ** 2 for w in set(a)) * sum(b.count(w) ** 2 for w in set(b))) ** 0.5
    for g in "abc":
        own = [w for k, w in rows if k == g and w]
        pairs = [cosine(a, b) for a, b in itertools.combinations(own, 2)]
        assert got[g]["coherence"] == pytest.approx(sum(pairs) / len(pairs), abs=1e-4)
    assert got["d"]["coherence"] == 1 and got["d"]["distinctiveness"] == 1 and got["e"]["n_rows"] == 1 and None not in got


def test_votes(spark):
    df = spark.createDataFrame([(1, ["x", "bad"], ["t"], "A Word"), (2, None, None, None)], "i long, own array<string>, tags array<string>, text string")
    v = R.field_votes(df, "i", F.col("own"), F.col("tags"), F.col("text"), {"t": ["x", "y"]}, {"word": ["y", "z"]}, ["z"], ["x", "y", "z"])
    assert {(r["i"], r["field"]): r["score"] for r in v.collect()} == {(1, "x"): 5.0, (1, "y"): 3.0, (1, "z"): 1.2, (2, "z"): 0.2}


def test_bounded_infix():
    known = ["close", "volume"]
    assert E.bounded_infix("rolling_mean(close, 20) - volume", known) == ["sub", ["rolling_mean", "close", 20], "volume"]
    for t in (None, "", "close; volume", "rolling_mean(close, 2001)", "open + close", "(close", "close)(", "+".join(["close"] * 80), "abs(" * 9 + "close" + ")" * 9, "ret60s + close", "abs(close) + " * 8 + "abs(close)"):
        assert E.bounded_infix(t, known + ["ret60s"]) is None, t


def test_nearest_rank_by_ranges(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.choice([None, 1.0, r.random(), r.random() * 100])) for _ in range(3000)] + [("one", 4.0), ("none", None)]
    got = {x["g"]: x for x in S.nearest_rank(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0, 50, 99, 100], parts=8).collect()}
    for g in ("a", "b", None, "one"):
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert [got[g][f"p{p}"] for p in (0, 50, 99, 100)] == [v[min(len(v) * p // 100, len(v) - 1)] for p in (0, 50, 99, 100)]
    assert "none" not in got


def test_split_keys_join_the_same(spark):
    r = random.Random(2)
    a = spark.createDataFrame([(r.choice([1, 1, 1, 2, 3, None]), i) for i in range(90)], "k int, a int")
    b = spark.createDataFrame([(r.choice([1, 1, 2, 4, None]), i) for i in range(70)], "k int, b int")
    want = sorted(map(tuple, a.join(b, "k").select("k", "a", "b").collect()))
    for hot in (1, 7, 40, 1000):
        assert sorted(map(tuple, spread_join(a, b, "k", hot).select("k", "a", "b").collect())) == want
    assert spread_join(a.filter("false"), b, "k", 1).count() == 0


def test_plugins(spark):
    df = spark.createDataFrame([("2020-01-01", c, i, float(i), "clash") for c in ("a", "b", None) for i in (3, 1, 2)], "date string, code string, delay_time int, close double, id string").withColumn("seq", F.col("delay_time"))
    got = user_factor(df, lambda p: 1 / (p["close"] - 1)).collect()
    assert {(r["code"], r["delay_time"]): r["factor"] for r in got} == {(c, i): {1: None, 2: 1.0, 3: 0.5}[i] for c in ("a", "b", None) for i in (1, 2, 3)}
    x = encoded(df, F.col("delay_time"), F.col("code"), lambda: lambda texts: [[len(t), 0] for t in texts], batch=2).collect()
    assert sorted((r["id"], r["vector"]) for r in x) == sorted((i, [float(bool(c)), 0.0]) for c in ("a", "b", None) for i in (1, 2, 3))
    assert user_factor(df.filter("false"), lambda p: p["close"]).count() == 0
    with pytest.raises(Exception, match="1 values for 3 rows"):
        user_factor(df, lambda p: p["close"].head(1)).collect()
