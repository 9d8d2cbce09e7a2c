"""Daily evaluation, text, stores, graphs and flows on small fixtures."""

import itertools
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickweave.functions import ids as I
from tickweave.functions import text as X
from tickweave.operators import daily as D
from tickweave.operators import graph as G
from tickweave.operators import store as S
from tickweave.operators.components import components
from tickweave.runtime import skew_join
from tickweave.sources import tables as T
from tickweave.streaming import flows as L


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first()["r"]


@pytest.fixture(scope="module")
def returns(spark):
    days = pd.date_range("2020-01-01", periods=20).strftime("%Y-%m-%d")
    wide = pd.DataFrame({f"S{j:03d}": [(((i * 30 + j) % 17) - 8) / 1000 for i in range(20)] for j in range(30)})
    wide.iloc[5, 0], wide.iloc[6, 1] = 19.0, np.nan
    wide.insert(0, "date", days)
    return spark.createDataFrame(wide), wide


def test_unpivot_and_features(spark, returns):
    df, wide = returns
    r = D.sanitize(D.unpivot(df))
    m = wide.set_index("date")
    m = m.where(m.abs() <= 1)
    want = {"momentum_sum": m.rolling(5, 3).sum(), "volatility": m.rolling(5, 3).std(), "skewness": m.rolling(5, 3).skew(), "max_return": m.rolling(5, 3).max(), "downside_volatility": (m.where(m < 0, 0.0) ** 2).rolling(5, 3).mean() ** 0.5, "market_residual_momentum": m.sub(m.mean(axis=1), axis=0).rolling(5, 3).sum()}
    for k, w in want.items():
        got = D.feature(r, k, 5, 3).toPandas().pivot(index="date", columns="ticker", values="feature")
        np.testing.assert_allclose(got.to_numpy(float), w.to_numpy(float), rtol=1e-6, atol=1e-9, err_msg=k)
    assert D.repeated_dates(df).count() == 0
    for bad in ((1, 1), (5, 6)):
        with pytest.raises(ValueError):
            D.feature(r, "momentum_sum", *bad)


def test_label_and_rank_ic(spark, returns):
    df, wide = returns
    r = D.forward_label(D.feature(D.sanitize(D.unpivot(df)), "momentum_sum", 3), 2)
    p = r.toPandas()
    m = wide.set_index("date")
    m = m.where(m.abs() <= 1)
    lab = (1 + m.shift(-1)) * (1 + m.shift(-2)) - 1
    np.testing.assert_allclose(p.pivot(index="date", columns="ticker", values="label").to_numpy(float), lab.to_numpy(float), atol=1e-12)
    ic = {d: g.feature.rank().corr(g.label.rank()) for d, g in p.dropna(subset=["feature", "label"]).groupby("date") if len(g) >= 5}
    got = {x["date"]: x["rank_ic"] for x in D.rank_ic(r, 5).collect()}
    assert set(got) == {d for d, v in ic.items() if v == v}
    assert all(got[d] == pytest.approx(ic[d]) for d in got)
    e = D.evaluate(r, 5).first()
    assert e["n_days"] == len(got) and e["mean_ic"] == pytest.approx(np.mean(list(got.values())))
    empty = D.evaluate(r.filter("false"), 5).first()
    assert empty["n_obs"] == 0 and empty["mean_ic"] is None
    s = D.ExperimentSpec("momentum_sum", 3, 2, "2020-01-05", "2020-01-15")
    assert s.id == D.ExperimentSpec("momentum_sum", 3, 2, "2020-01-05", "2020-01-15").id
    with pytest.raises(PermissionError):
        D.ExperimentSpec("momentum_sum", 3, 2, "2020-01-05", "2020-01-15", segment="locked_test").run(D.unpivot(df))


def test_ids(spark):
    assert one(spark, "https://doi.org/10.1000/ABC%2F1).", I.doi) == "10.1000/abc/1"
    assert one(spark, "no", I.doi) is None and one(spark, None, I.doi) is None
    assert one(spark, "https://openalex.org/w12/", I.openalex) == "W12" and one(spark, "X12", I.openalex) is None
    for t in ("https://arxiv.org/abs/2001.01234v2", "arXiv: 2001.01234", "http://arxiv.org/pdf/2001.01234v11.pdf"):
        assert one(spark, t, I.arxiv) == "2001.01234"
    assert one(spark, "HTTPS://A.org/x/?utm_a=1&b=2&fbclid=3#f", I.canonical_url) == "https://a.org/x?b=2" and one(spark, None, I.canonical_url) is None
    assert one(spark, "//a.b/?q=a%20b&x&&y=%7e*&gclid=1", I.canonical_url) == "//a.b?q=a+b&x=&y=~%2A" and one(spark, "", I.canonical_url) == ""
    assert one(spark, "A (b) Title - of [x] &amp; 中文!", I.canonical_title) == "atitleof中文"
    v, same, none = (list(one(spark, t, lambda c: I.hash_embedding(c, 16))) for t in ("order Order flow", "FLOW, order; order", ""))
    assert math.isclose(sum(x * x for x in v), 1) and v == same and none == [0.0] * 16


def test_text(spark):
    assert one(spark, "Ｏrder–Flow_imbalance  Straße", X.match_text) == "order flow imbalance strasse"
    assert one(spark, "Order-Flow, (x)", X.match_text) == "order flow x"
    n = spark.createDataFrame([("order flow in limit order books",), ("border flows",), (None,)], "n string")
    assert [r[0] for r in n.select(X.hits(F.col("n"), ["order flow", "limit order"])).collect()] == [["limit order", "order flow"], [], []]
    m = spark.sql("select map('b', array(1, -1), 'a', array(0, 2), 'n', cast(null as array<int>)) m")
    assert m.select(X.rebuilt_abstract(F.col("m"))).first()[0] == "a b a"
    t = "First one. Second one! 第三句。 Fourth?\n\nFifth"
    assert one(spark, t, lambda c: X.chunks(c, 24)) == ["First one.\nSecond one!", "第三句。\nFourth?\nFifth"]
    assert one(spark, None, X.chunks) == [] and one(spark, "x" * 50_000, lambda c: X.chunks(c, 100)) == ["x" * 50_000]
    assert one(spark, "Mon, 06 Jan 2025 10:00:00 GMT", X.timestamp_of) == one(spark, "2025-01-06T10:00:00Z", X.timestamp_of)
    assert one(spark, "nonsense", X.timestamp_of) is None
    assert one(spark, "<p>a<script>x</script>b</p>c &amp; d", X.stripped_html) == "a b\nc & d"
    assert one(spark, 0.0234, X.ic_bucket, "double") == "0.02"
    assert [one(spark, v, lambda c: X.accepted(c, "ic >= 0.02"), "double") for v in (0.03, 0.01, None)] == ["supported", "refuted", "inconclusive"]
    assert one(spark, 1.0, lambda c: X.accepted(c, "os.system('x')"), "double") == "inconclusive"
    assert [one(spark, v, lambda c: X.scalar_kind(c)["kind"]) for v in ("", "true", "12", "1.5", "x", None)] == ["null", "boolean", "int", "float", "text", "null"]
    assert one(spark, [" A ", "a", "", None, "B"], X.first_seen, "array<string>") == ["A", "B"]
    rows = spark.createDataFrame([([{"a": 3, "b": 1}, {"a": 2}, {"b": 9}, {}],)], "c array<map<string,int>>")
    assert rows.select(X.selected_chunks(F.col("c"), ["a", "b"], 4)).first()[0] == [0, 1, 2, 3]


def test_merge_policies(spark):
    df = spark.createDataFrame([("a", 1, None, ["x"]), ("a", 2, "p", ["y", "x"]), ("a", 3, " ", None), ("b", 4, "q", []), (None, 5, "r", None), (None, 6, "s", None)], "k string, seq int, v string, l array<string>")
    assert sorted(r["seq"] for r in S.first_seen(df.drop("l"), ["k"], ["seq"]).collect()) == [1, 4, 5, 6]
    assert sorted(r["seq"] for r in S.last_wins(df.drop("l"), ["k"], ["seq"]).collect()) == [3, 4, 5, 6]
    m = {r["k"]: r for r in S.fill_merge(df, ["k"], ["seq"], ["v"], ["l"], last=True).collect()}
    assert m["a"]["v"] == "p" and m["a"]["l"] == ["x", "y"] and m["a"]["n_rows"] == 3
    assert S.richest(df, ["k"], ["v"], ["seq"]).filter("k = 'a'").first()["seq"] == 2
    x = spark.createDataFrame([("g", float(i)) for i in range(10)] + [("h", None)], "g string, v double")
    r = S.nearest_rank(x, ["g"], "v", [50, 99, 100]).collect()
    assert [tuple(y) for y in r] == [("g", 5.0, 9.0, 9.0)]


def test_components(spark):
    rng = np.random.default_rng(0)
    chain = [(i, i + 1) for i in range(200)]
    rand = [(1000 + int(a), 1000 + int(b)) for a, b in rng.integers(0, 80, (60, 2))]
    hub = [(5000, 5001 + i) for i in range(300)]
    edges = chain + rand + hub + [(1, 1), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {n: find(n) for n in parent}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_similarity_joins(spark):
    rng = np.random.default_rng(1)
    v = {i: rng.normal(size=6).tolist() for i in range(40)} | {40: [0.0] * 6}
    v[41] = v[0]
    df = spark.createDataFrame([(i, x) for i, x in v.items()] + [(50, None), (51, [])], "id long, v array<double>")
    unit = {i: np.array(x) / np.linalg.norm(x) for i, x in v.items() if any(x)}
    want = {(a, b) for a, b in itertools.combinations(sorted(unit), 2) if unit[a] @ unit[b] >= 0.4}
    for block in (8, 1000):
        assert {(r["a"], r["b"]) for r in G.cosine_pairs(df, "id", "v", 0.4, block).collect()} == want
    sets = {i: {int(x) for x in rng.integers(0, 25, rng.integers(1, 9))} for i in range(50)}
    rows = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s] + [(99, None)], "id long, x long")
    for least in (0.3, 0.7, 1.0):
        want = {(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) / math.sqrt(len(sets[a]) * len(sets[b])) >= least - 1e-12}
        assert {(r["a"], r["b"]) for r in G.set_cosine_pairs(rows, "id", "x", least).collect()} == want
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8), (1, 4, 0.8), (3, 4, 0.1)], "a long, b long, score double")
    assert {(r["a"], r["b"]) for r in G.top_k(pairs, 1).collect()} == {(1, 2), (1, 3), (1, 4)}


def test_paths_and_identity(spark):
    n = spark.createDataFrame([("old", 2010, 100), ("mid", 2018, 50), ("new", 2025, 10), ("odd", 2009, 1)], "id string, year int, citation_count long")
    e = spark.createDataFrame([("mid", "old"), ("new", "mid"), ("odd", "old"), ("new", "odd"), ("old", "old")], "source string, target string")
    p = G.paths(e, n, F.col("id") == "old", F.col("id") == "new", 4)
    assert [r["path"] for r in p.collect()] == [["old", "mid", "new"]]
    s = G.path_scores(p, n).first()
    assert s["impact"] == pytest.approx(math.log(101) + math.log(51) + math.log(11), abs=1e-6)
    w = spark.createDataFrame([("W1", "A", "a", 3), ("W2", None, "a", 9), ("W3", "A", None, 1), ("W4", None, None, 0)], "id string, arxiv string, doi string, rank int")
    g = {r["id"]: r for r in G.identity_groups(w, "id", ["arxiv", "doi"], ["rank"]).collect()}
    assert {g[x]["representative"] for x in ("W1", "W2", "W3")} == {"W2"} and g["W1"]["group_size"] == 3 and g["W1"]["methods"] == ["arxiv", "doi"] and g["W4"]["group_size"] == 1


def test_skew_join(spark):
    big = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i}", i) for i in range(50)] + [(None, 1)], "k string, v long")
    small = big.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    for parts in (3, 1000):
        assert skew_join(big, small, ["k"], "n", parts).count() == 550


def test_flows(spark, tmp_path):
    e = spark.createDataFrame([("r", 1, "go"), ("r", 2, "stop"), ("r", 3, "stop"), ("s", 1, "x")], "run string, seq int, kind string")
    m = spark.createDataFrame([("idle", "go", "on"), ("on", "stop", "idle")], "state string, kind string, next string")
    got = {r["run"]: (r["state"], r["refused"]) for r in L.replayed(e, "run", "seq", "kind", m, "idle").collect()}
    assert got == {"r": ("idle", 1), "s": ("idle", 1)}
    e.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = L.replay_stream(src, "run", "kind", {("idle", "go"): "on", ("on", "stop"): "idle"}, "idle").writeStream.outputMode("update").format("memory").queryName("replayed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["run"]: r["events"] for r in spark.table("replayed").collect()} == {"r": 3, "s": 1}
    b = spark.createDataFrame([("a", "e1", 5.0, 1), ("a", "e1", 5.0, 2), ("a", "e1", 6.0, 3), ("a", "e2", 6.0, 4)], "acc string, id string, amt double, seq int")
    assert [r["verdict"] for r in L.ledger(b, ["acc"], "id", "amt", "seq", 10).orderBy("seq").collect()] == ["accepted", "replay", "conflict", "rejected"]


def test_sources(spark, tmp_path):
    assert T.tick_path("/d", "2025-03-06", "sz2938") == "/d/20250306/002938.parquet"
    assert T.evenly_spaced(31, 5) == [0, 8, 15, 22, 30] and T.evenly_spaced(3, 9) == [0, 1, 2] and T.evenly_spaced(9, 1) == [0]
    feed = b'<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link href="u"/><summary>s</summary><updated>d</updated></entry></feed>'
    assert T.feed_entries(feed) == [{"title": "T", "summary": "s", "url": "u", "published": "d"}] and T.feed_entries(b"<broken") == []
    import io
    import tarfile

    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as t:
        for name, body in (("a.tex", b"\\section{x}"), ("b.png", b"no"), ("c.tex", b"y" * 50)):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    assert [n for n, _ in T.tex_members(buf.getvalue())] == ["c.tex", "a.tex"] and T.tex_members(b"plain") == []
    c = T.Contract(paths=("*/ok.parquet",), blocked=("ret60s",))
    c.check("/x/ok.parquet", ["close"])
    for path, cols in (("/x/no.parquet", ["close"]), ("/x/ok.parquet", ["ret60s"])):
        with pytest.raises(PermissionError):
            c.check(path, cols)
    p = str(tmp_path / "m.json")
    (tmp_path / "m.json").write_text(json.dumps([{"factor_name": "f", "daily_ic": "x", "n_obs": "7"}, {"factor_name": "", "daily_ic": 0.5}]))
    assert [(r["factor_name"], r["daily_ic"], r["n_obs"]) for r in T.metrics(spark, p).collect()] == [("f", None, 7), (None, 0.5, None)]


def test_greedy_selections(spark):
    from tickweave.operators import greedy as Y

    df = spark.createDataFrame([(1, 9.0, 5.0, "a"), (2, 8.0, 6.0, "a"), (3, 7.0, 100.0, "b"), (4, 6.0, 1.0, None), (5, None, 1.0, "c"), (6, 9.0, 1.0, "a")], "id int, s double, c double, t string")
    assert [r["id"] for r in Y.portfolio(df, "id", "s", "c", "t", 3, 20.0, 2).orderBy("rank").collect()] == [1, 6, 4]
    e = spark.createDataFrame([("x", 1), ("x", 2), ("y", 2), ("y", 3), ("y", 4), ("z", 1)], "p string, t int")
    assert [tuple(r) for r in Y.coverage(e, "p", "t", 5).orderBy("rank").collect()] == [("y", 1, 3), ("x", 2, 1)]
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0]), (3, 0, [1.0, 0.1]), (4, 0, None), (5, 1, [1.0, 0.0]), (6, 0, [0.0, 0.0])], "vec_id long, label int, e array<double>")
    got = {r["vec_id"]: r["cluster"] for r in G.greedy_clusters(v, "label", "vec_id", "e", 0.55).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 2, 5: 0, 6: 3}
    assert G.greedy_clusters(v.filter("false"), "label", "vec_id", "e", 0.5).count() == 0
