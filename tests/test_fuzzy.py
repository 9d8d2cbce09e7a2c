"""Fuzzy join of titles against all pairs."""

import difflib
import random

import pytest

from tickweave.operators.fuzzy import fuzzy_pairs
from tickweave.plans import text_queries

WORDS = "order flow limit book price impact queue spread noise trading hawkes kernel alpha decay depth fill rates across night sessions".split()


def _titles(n):
    r = random.Random(3)
    out = ["", "a", "abcdefgh", "abcdefghi", "x" * 17, "order book" * 25]
    for _ in range(n):
        out.append(" ".join(r.choices(WORDS, k=r.choice([1, 2, 4, 8, 14, 20]))))
    edited = []
    for t in out:
        s = list(t)
        for _ in range(r.choice([0, 1, 2, 4, 7])):
            i = r.randrange(len(s) + 1)
            s[i : i + r.choice([0, 1, 1, 2])] = r.choice(["", "z", "zy"])
        edited.append("".join(s))
    return out, edited + ["essays on " + t for t in out[-40:]]


@pytest.mark.parametrize("least", [0.94, 0.8])
def test_no_pair_is_lost(spark, least):
    a, b = _titles(120)
    A, B = (spark.createDataFrame(list(enumerate(x)), "id long, text string") for x in (b, a))
    want = {(i, j): difflib.SequenceMatcher(None, t, u).ratio() for i, t in enumerate(b) for j, u in enumerate(a)}
    want = {k: v for k, v in want.items() if v >= least}
    got = {(r["a_id"], r["b_id"]): r["ratio"] for r in fuzzy_pairs(A, B, least).collect()}
    assert got == pytest.approx(want) and len(got) > 60


def test_best_match_needs_no_equal_start(spark, tmp_path):
    long = "the endogenous structure of limit order queues and spread dynamics in opening calls and closing auctions"
    works = [(1, long), (2, long), (3, "Microprice Estimation across Dark Venues"), (4, None)]
    prints = [(1, "Essays on " + long), (2, "Micorprice Estimation across Dark Venues"), (3, long.upper()), (4, "nothing like it"), (5, None)]
    for name, rows in (("works", works), ("preprints", prints)):
        spark.createDataFrame(rows, "rec_id long, title string").write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {r["rec_id"]: r["work_rec"] for r in text_queries.t39_best_match(spark, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 3, 3: 1}
