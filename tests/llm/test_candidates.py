"""Candidate search and estimated weights of the entity matching against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

M = pytest.importorskip("tickweave.llm.matching")

SCHEMA = "id string, title string, names array<string>, year int"


def _entities(spark, rows):
    d = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("clash"))
    return M.entities(d, F.col("id"), F.col("title"), F.col("names"), None, F.col("year"), F.lit(None).cast("string"), F.struct(F.lit(1).alias("t")))


def _brute(a, b):
    out = set()
    for x in a:
        if x["surnames"]:
            continue
        wx = {w for w in x["words"] if w not in M.STOP}
        for y in b:
            wy = {w for w in y["words"] if w not in M.STOP}
            need = min(len(wx), max(2, int(np.ceil(len(wx) * M.COMMON))))
            if need and len(wx & wy) >= need and (x["year"] is None or y["year"] is None or abs(x["year"] - y["year"]) <= M.YEARS):
                out.add((x["id"], y["id"]))
    return out


@pytest.mark.parametrize("hot", [2, 10**9])
def test_title_keys_lose_nothing(spark, hot):
    r = random.Random(1)
    words = [f"w{i}" for i in range(14)]
    title = lambda n: " ".join(r.choice(words) for _ in range(n))
    sizes = [1, 2, 3, 4, 5, 6, 8, 11, 30, 60]
    more = [f"v{i}" for i in range(80)]
    a = [(f"A{i}", title(r.choice(sizes)) if i % 7 else " ".join(r.sample(more, 40)), [] if i % 4 else ["Xan Bo"], r.choice([None, 2010, 2013, 2020])) for i in range(60)]
    b = [(f"B{i}", title(r.choice(sizes)) if i % 5 else " ".join(r.sample(more, r.choice([10, 35, 60]))), ["Xan Bo"], r.choice([None, 2011, 2019])) for i in range(60)]
    a += [("A_", None, None, None), ("A-", "of the", None, None), ("A語", "市場の微細構造と流動性", None, None)]
    b += [("B_", None, None, None), ("B語", "流動性と市場の微細構造について", None, None)]
    ea, eb = _entities(spark, a), _entities(spark, b)
    got = {(x["a_id"], x["b_id"]) for x in M._title_keys(ea, eb, hot).collect()}
    assert got == _brute(ea.collect(), eb.collect()) and ("A語", "B語") in got and len(got) > 100


def test_weights_are_estimated():
    rng = np.random.default_rng(2)
    n = {"match": 4000, "people": 5000, "titles": 9000}
    draw = lambda p, k: rng.choice(len(p), k, p=np.array(p) / sum(p))
    like = lambda c: [np.exp(-abs(i // 5 - c) * 1.5) for i in range(35)]
    parts = []
    for kind, people, centre, year in (("match", [1, 0, 0, 0, 6, 0, 6, 0, 6], 6, [8, 2, 0, 0]), ("people", [0, 0, 8, 2, 1, 0, 0, 0, 0], 0, [2, 1, 2, 5]), ("titles", [9, 1, 0, 0, 0, 0, 0, 0, 0], 2, [3, 3, 3, 1])):
        k = n[kind]
        parts.append(np.stack([draw(people, k), draw(like(centre), k), draw([97, 3] if kind != "match" else [1, 0], k), np.where(rng.random(k) < 0.8, -1, int(kind == "match")), draw(year, k)], axis=1))
    x = np.concatenate(parts)
    truth = np.repeat([1, 0, 0], list(n.values()))
    pat, at, count = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    found = M.estimate(pat, count.astype(float))[at.ravel()] > 0
    assert (found & (truth == 1)).sum() / truth.sum() > 0.98 and (found & (truth == 0)).sum() / found.sum() < 0.02
    more = M.estimate(pat, 100.0 * count)[at.ravel()] > 0  # the weights follow the data, not their number
    assert (found == more).mean() > 0.99


def test_candidates_hold_nearly_all_matches_of_all_pairs(spark, data):
    from tickweave.llm import queries as Q

    sides = {}
    keep = M.match
    try:
        M.match = lambda a, b: sides.update(a=M.written(a, "a"), b=M.written(b, "b"))
        Q._matches(spark, data.replace("sf0.001", "sf0.01"))
    finally:
        M.match = keep
    a, b = sides["a"], sides["b"]
    names = list(M.LEVELS)
    every = M.written(M.compared(a.select(F.col("id").alias("a_id")).crossJoin(b.select(F.col("id").alias("b_id"))), a, b), "every").filter("people > 1 or title >= 10")
    pairs = M.candidates(a, b)
    counts = M.compared(pairs, a, b).groupBy(*names).count().toPandas()
    odds = dict(zip(map(tuple, counts[names].to_numpy(int).tolist()), M.estimate(counts[names].to_numpy(int), counts["count"].to_numpy(float))))
    likely = {(r["a_id"], r["b_id"]) for r in every.collect() if odds.get(tuple(r[f] for f in names), 0) > 0}
    found = {(r["a_id"], r["b_id"]) for r in pairs.collect()}
    print(f"candidates hold {len(likely & found)} of {len(likely)} likely pairs of all {a.count()} x {b.count()}")
    assert len(likely) > 100 and len(likely & found) / len(likely) >= 0.9
