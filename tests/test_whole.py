"""Queries and operators over all of their rows, against brute force on small fixtures."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave.functions import text as X
from tickweave.operators import graph as G
from tickweave.plans import corpus_queries, flow_queries, select_queries, text_queries

TITLES = ["Order-flow & Price Impact", "Ｏrder–Flow <Imbalance>", "Straße: limit order", "市场 market depth", "a\x0bb \"queue positions\"", "  ", "x ", None]


@pytest.fixture()
def nodes(spark, tmp_path):
    rows = [(i, f"N{i}", t, a, 2020, ["A"], "{}", None, "s", i) for i, (t, a) in enumerate(zip(TITLES, ["Fill—rates and naïve order flow", None, "", "volume shocks", "é", "alpha decay", "x", "market depth"]))]
    s = "rec_id long, id string, title string, abstract string, year int, authors array<string>, metadata string, added_at timestamp, source string, citation_count long"
    spark.createDataFrame(rows, s).write.parquet(str(tmp_path / "graph_nodes.parquet"))
    return str(tmp_path), rows


def _found(text):
    return sorted(p for p in text_queries.PHRASES if f" {p} " in f" {X.match_form(text)} ")


def test_every_node_has_phrases_and_a_decision(spark, nodes):
    folder, rows = nodes
    got = {r["rec_id"]: r for r in text_queries.t1_t7_phrases(spark, folder).collect()}
    assert sorted(got) == [r[0] for r in rows]
    for i, _, t, a, *_ in rows:
        th, ah = _found(t), _found(a)
        assert (got[i]["normal"], got[i]["title_hits"], got[i]["abstract_hits"], got[i]["score"]) == (X.match_form(t), "|".join(th), "|".join(ah), 4 * len(th) + len(ah)), t
    status = {r["rec_id"]: r["previous_status"] for r in text_queries.t8_t12_decisions(spark, folder).collect()}
    assert status == {r[0]: "accepted" if _found(r[2]) else "rejected" for r in rows}


def test_every_node_has_tokens(spark, nodes):
    folder, rows = nodes
    got = {r["rec_id"]: r for r in text_queries.t36_t37_tokens(spark, folder).collect()}
    for i, _, t, *_ in rows:
        low = (t or "").lower()
        assert got[i]["tokens"] == " ".join(sorted(set(re.findall(r"[a-z0-9][a-z0-9_-]*|[一-鿿]+", low))))
        assert got[i]["title_tokens"] == " ".join(w for w in re.findall(r"[a-z][a-z-]+", low) if len(w) >= 3 and w not in text_queries.STOP)
        assert got[i]["token_estimate"] == max(1, round(len(t or "") / 4))


def test_every_node_has_a_feed_entry(spark, nodes):
    folder, rows = nodes
    got = {r["rec_id"]: (r["title"], r["url"]) for r in flow_queries.s8_feeds(spark, folder).collect()}
    assert got == {r[0]: ((r[2] or "").replace("\x0b", "").strip(), f"https://x.org/{r[0]}") for r in rows}


def test_edges_of_every_nation_and_segment(spark, tmp_path):
    r = random.Random(1)
    people = [(i, i % 5, ("BUILDING", "MACHINERY")[i % 2]) for i in range(60)]
    orders = [(r.randrange(60), r.choice("12345")) for _ in range(300)]
    spark.createDataFrame(people, "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame(orders, "o_custkey long, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    keys = {i: {p for o, p in orders if o == i} for i, _, _ in people}
    want = {(a, b): len(keys[a] & keys[b]) for a, na, sa in people for b, nb, sb in people if a < b and (na, sa) == (nb, sb) and len(keys[a] & keys[b]) >= 3}
    got = {(x["a"], x["b"]): x["shared"] for x in corpus_queries.j13_keyword_edges(spark, str(tmp_path)).collect()}
    assert got == want and {people[a][1] for a, _ in got} == {0, 1, 2, 3, 4}


def test_all_metrics_go_through_the_files(spark, tmp_path):
    rows = [(i, i % 9, 1, 1000 * i, 0.05, 100.0, 5.0, 0.04) for i in range(1, 8)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_linenumber int, l_orderkey long, l_discount double, l_extendedprice double, l_quantity double, l_tax double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = flow_queries.s4_metric_files(spark, str(tmp_path)).groupBy("kind").agg(F.sum("n").alias("n")).collect()
    assert {x["kind"]: x["n"] for x in got} == {"parquet": 7, "csv": 7, "jsonl": 7}


def test_context_of_all_records(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, "x" * r.randrange(0, 60) if i % 11 else None, r.choice(["positive", "negative", None])) for i in range(400)]
    spark.createDataFrame(rows, "rec_id long, reason string, direction string").repartition(5).write.parquet(str(tmp_path / "feedback_memory.parquet"))
    want, upto = set(), 0
    for i, s, d in sorted((x for x in rows if x[1] is not None), key=lambda x: (["positive", "negative", None].index(x[2]), x[0])):
        upto += len(s)
        if upto <= 2000:
            want.add((i, d or "unknown", upto))
    assert {tuple(x) for x in select_queries.r27_context(spark, str(tmp_path)).collect()} == want and max(i for i, *_ in want) > 60


def test_every_query_vector_is_searched(spark, tmp_path):
    g = np.random.default_rng(4)
    v = {i: g.normal(size=6) for i in range(350)} | {200: np.zeros(6), 301: None}
    v[5] = v[0] * 2
    spark.createDataFrame([(i, None if x is None else x.tolist()) for i, x in v.items()], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    unit = {i: x / np.linalg.norm(x) for i, x in v.items() if x is not None and x.any()}
    want = {(q, i) for q in (0, 100, 300) for i in sorted((i for i in unit if i != q and round(unit[i] @ unit[q], 6) >= 0.2), key=lambda i: (-round(unit[i] @ unit[q], 6), i))[:20]}
    assert {(x["query"], x["vec_id"]) for x in corpus_queries.r8_semantic(spark, str(tmp_path)).collect()} == want
    e = spark.read.parquet(str(tmp_path / "embeddings.parquet"))
    assert {(x["query"], x["vec_id"]) for x in G.cosine_search(e.filter("vec_id % 100 = 0"), e, "vec_id", "embedding", 0.2, 20, block_rows=3).collect()} == want


def test_clusters_take_the_best_member(spark):
    at = lambda d: [float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))]
    turns = [0, 50, 85, 170, 125, 45]  # 85 is near a member, not the head
    df = spark.createDataFrame([(i, 0, at(d)) for i, d in enumerate(turns)] + [(10 + i, 1, at(3 * i)) for i in range(40)], "vec_id long, label int, e array<double>")
    got = {r["vec_id"]: r["cluster"] for r in G.greedy_clusters(df, "label", "vec_id", "e", 0.55).collect()}
    assert [got[i] for i in range(6)] == [0, 0, 0, 1, 0, 0] and {got[10 + i] for i in range(40)} == {0}
    turns = [0, 100, 55]
    df = spark.createDataFrame([(i, 0, at(d)) for i, d in enumerate(turns)], "vec_id long, label int, e array<double>")
    assert [r["cluster"] for r in G.greedy_clusters(df, "label", "vec_id", "e", 0.55).orderBy("vec_id").collect()] == [0, 1, 1]


def test_find_needs_every_word(spark, tmp_path):
    rows = [(1, "Liquidity", "positive", ["order flow"]), (2, "liquidity", "positive", None), (3, "flow", None, ["x"]), (4, "flow of liquidity", None, None)]
    spark.createDataFrame(rows, "rec_id long, reason string, label string, mechanism_tags array<string>").write.parquet(str(tmp_path / "feedback_memory.parquet"))
    assert [r["rec_id"] for r in corpus_queries.r25_find(spark, str(tmp_path)).collect()] == [1, 4]
