"""Similarity joins and graph operators over edge tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tickweave.operators.components import components
from tickweave.runtime import spread_join, written

#: Rows of one block of the all-pairs product.
BLOCK_ROWS = 1024


def cosine_pairs(vectors: DataFrame, ident: str, vector: str, least: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, score) of every two vectors, a < b, of a cosine of ``least`` or more. Null, empty and zero vectors
    have no pairs; a vector of another length is an error.

    An exact all-pairs search: unit vectors go into blocks of about ``block_rows``, each two blocks meet in one
    task as a matrix product, and only pairs above the limit leave it. Blocks are sets against sets, replicated
    once for each other block; no row is compared through a join row of its own."""
    v = vectors.select(F.col(ident).alias("id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v")).filter(F.size("v") > 0)
    n = max(1, -(-v.count() // block_rows))
    b = v.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    left = b.select("id", "v", F.col("block").alias("i"), F.explode(F.sequence("block", F.lit(n - 1))).alias("j"))
    right = b.select(F.col("id").alias("rid"), F.col("v").alias("rv"), F.explode(F.sequence(F.lit(0), "block")).alias("ri"), F.col("block").alias("rj"))
    kind = v.schema["id"].dataType.simpleString()

    def unit(ids: pa.ChunkedArray, vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        m = np.array(vectors.to_pylist(), float)
        size = np.linalg.norm(m, axis=1)
        ok = size > 0
        return np.array(ids.to_pylist())[ok], m[ok] / size[ok, None]

    def meet(l: pa.Table, r: pa.Table) -> pa.Table:
        if not l.num_rows or not r.num_rows:
            t = l.schema.field("id").type if "id" in l.schema.names else r.schema.field("rid").type
            return pa.table({"a": pa.array([], t), "b": pa.array([], t), "score": pa.array([], pa.float64())})
        (p, x), (q, y) = unit(l.column("id"), l.column("v")), unit(r.column("rid"), r.column("rv"))
        s = x @ y.T if len(x) and len(y) else np.zeros((len(x), len(y)))
        i, j = np.nonzero(s >= least)
        a, c, w = p[i], q[j], s[i, j]
        keep = a < c if l.column("i")[0].as_py() == l.column("j")[0].as_py() else np.ones(len(a), bool)
        a, c, w = a[keep], c[keep], w[keep]
        return pa.table({"a": np.where(a < c, a, c), "b": np.where(a < c, c, a), "score": w})

    return left.groupBy("i", "j").cogroup(right.groupBy("ri", "rj")).applyInArrow(meet, f"a {kind}, b {kind}, score double")


def set_cosine_pairs(items: DataFrame, ident: str, item: str, least: float) -> DataFrame:
    """(a, b, common, score) of every two sets, a < b, of a cosine |A & B| / sqrt(|A| |B|) of ``least`` (above 0).

    Prefix filter: items in order of rarity; two such sets share one of the first |A| - ceil(least^2 |A|) + 1 items
    of each. So only those items make candidates; at a high limit the frequent ones hardly ever do, at a low one (an n-th
    of the largest set or less) all do, and the pairs are as many as the definition asks for. Hot items are split."""
    if least <= 0:
        raise ValueError("a limit above 0; at 0 every two sets are a pair")
    x = items.select(F.col(ident).alias("id"), F.col(item).alias("x")).dropna().distinct()
    df = x.groupBy("x").agg(F.count("*").alias("df"))
    sizes = x.groupBy("id").agg(F.count("*").alias("n"))
    r = written(x.join(df, "x").join(sizes, "id").withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("df", "x"))), "ranked-items")
    short = r.filter(F.col("r") <= F.col("n") - F.ceil(F.lit(least * least) * F.col("n") - 1e-9) + 1).select("id", "x", "n")
    l, m = short.select("x", F.col("id").alias("a"), F.col("n").alias("na")), short.select("x", F.col("id").alias("b"), F.col("n").alias("nb"))
    near = F.least("na", "nb") >= F.lit(least * least) * F.greatest("na", "nb") - 1e-9
    cand = spread_join(l, m, "x").filter("a < b").filter(near).select("a", "b", "na", "nb").distinct()
    has = r.select("id", "x")
    common = cand.join(has.withColumnRenamed("id", "a"), "a").join(has.withColumnRenamed("id", "b"), ["b", "x"]).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("common"))
    return common.withColumn("score", F.col("common") / F.sqrt(F.col("na") * F.col("nb"))).filter(F.col("score") >= least - 1e-12).select("a", "b", "common", "score")


def top_k(pairs: DataFrame, k: int, score: str = "score") -> DataFrame:
    """Pairs that are among the ``k`` best of either end, each once; ties go to the larger other end."""
    both = pairs.withColumns({"u": F.col("a"), "v": F.col("b")}).unionByName(pairs.withColumns({"u": F.col("b"), "v": F.col("a")}))
    w = W.partitionBy("u").orderBy(F.desc(score), F.desc("v"))
    return both.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select(*pairs.columns).distinct()


def shared_keys(rows: DataFrame, ident: str, key: str) -> DataFrame:
    """(a, b, shared) of every two things with a common key, a < b, by an equi-join on the key, of which hot ones are split."""
    x = rows.select(F.col(ident).alias("id"), F.lower(F.trim(F.col(key).cast("string"))).alias("k")).filter("id is not null and k != ''").distinct()
    return spread_join(x.withColumnRenamed("id", "a"), x.withColumnRenamed("id", "b"), "k").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def class_shared_keys(rows: DataFrame, ident: str, key: str, least: int) -> DataFrame:
    """(a, b, shared) of every two things with ``least`` common keys or more, a < b. Things of equal keys are a class;
    keys are counted between classes, and only classes near enough meet with their members."""
    x = rows.select(F.col(ident).alias("id"), F.lower(F.trim(F.col(key).cast("string"))).alias("k")).filter("id is not null and k != ''").distinct()
    sets = written(x.groupBy("id").agg(F.array_sort(F.collect_set("k")).alias("keys")), "key-sets").filter(F.size("keys") >= least)
    keys = sets.select("keys").distinct().select("keys", F.explode("keys").alias("k"))
    near = spread_join(keys.withColumnRenamed("keys", "ka"), keys.withColumnRenamed("keys", "kb"), "k").groupBy("ka", "kb").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)
    l, r = (sets.select(F.col("id").alias(i), F.col("keys").alias(k)) for i, k in (("a", "ka"), ("b", "kb")))
    return near.join(l, "ka").join(r, "kb").filter("a < b").select("a", "b", "shared")


def cosine_search(queries: DataFrame, vectors: DataFrame, ident: str, vector: str, least: float, k: int, digits: int = 6, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query, ident, score) of the ``k`` nearest other vectors of each query, at a cosine (to ``digits`` places) of
    ``least`` or more, ties by id. Blocks of queries meet blocks of vectors as matrix products; each gives no more
    than the ``k`` best of a query. Null, empty and zero vectors have none."""
    of = lambda d: d.select(F.col(ident).alias("id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v")).filter(F.size("v") > 0)
    q, v = of(queries), of(vectors)
    nq, nv = (max(1, -(-d.count() // block_rows)) for d in (q, v))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select(F.col("id").alias("query"), F.col("v").alias("qv"), part(nq).alias("qi"), every(nv).alias("qj"))
    right = v.select("id", "v", every(nq).alias("i"), part(nv).alias("j"))
    kind = v.schema["id"].dataType.simpleString()

    def meet(l: pa.Table, r: pa.Table) -> pa.Table:
        out = []
        if l.num_rows and r.num_rows:
            p, q = (np.array(c.to_pylist()) for c in (l.column("query"), r.column("id")))
            x, y = (np.array(c.to_pylist(), float) for c in (l.column("qv"), r.column("v")))
            size = np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
            s = np.round(np.divide(x @ y.T, size, out=np.full(size.shape, -2.0), where=size > 0), digits)
            s[p[:, None] == q[None, :]] = -2.0
            for n, w in enumerate(s):
                at = np.flatnonzero((w >= least) & (w > -2.0))
                out += [(p[n].item(), q[m].item(), float(w[m])) for m in at[np.lexsort((q[at], -w[at]))][:k]]
        return pa.Table.from_pylist([dict(zip(("query", ident, "score"), o)) for o in out], pa.schema([("query", t), (ident, t), ("score", pa.float64())]))

    t = to_arrow_type(v.schema["id"].dataType)
    best = left.groupBy("qi", "qj").cogroup(right.groupBy("i", "j")).applyInArrow(meet, f"query {kind}, {ident} {kind}, score double")
    w = W.partitionBy("query").orderBy(F.desc("score"), ident)
    return best.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r")


def bounded_citations(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target) citations whose two ends are nodes; no loops, each once."""
    n = nodes.select(F.col(nodes.columns[0]).alias("id")).distinct()
    e = refs.select("source", "target").filter("source != target").distinct()
    return e.join(n.withColumnRenamed("id", "source"), "source", "left_semi").join(n.withColumnRenamed("id", "target"), "target", "left_semi")


def undirected(edges: DataFrame, symmetric: Column) -> DataFrame:
    """Symmetric relations with their ends in order, so that both directions are one edge."""
    return edges.withColumns({"source": F.when(symmetric, F.least("source", "target")).otherwise(F.col("source")), "target": F.when(symmetric, F.greatest("source", "target")).otherwise(F.col("target"))})


def merged_graphs(edges: DataFrame) -> DataFrame:
    """CITED_BY turned into CITES, loops dropped, and each (source, target, relation) once with its largest weight."""
    back = F.col("relation") == "CITED_BY"
    e = edges.withColumns({"source": F.when(back, F.col("target")).otherwise(F.col("source")), "target": F.when(back, F.col("source")).otherwise(F.col("target")), "relation": F.when(back, F.lit("CITES")).otherwise(F.col("relation"))})
    return e.filter("source != target").groupBy("source", "target", "relation").agg(F.max("weight").alias("weight"))


def weighted_degrees(edges: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Node, number of edges, sum of weights (negative ones as 0) and that as a share of the group's largest."""
    w = F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(0.0)).alias("w")
    ends = edges.select(*group, F.col("source").alias("node"), w).unionByName(edges.select(*group, F.col("target").alias("node"), w))
    d = ends.groupBy(*group, "node").agg(F.count("*").alias("edge_count"), F.round(F.sum("w"), 6).alias("weighted_degree"))
    top = d.groupBy(*group).agg(F.max("weighted_degree").alias("top")) if group else d.agg(F.max("weighted_degree").alias("top"))
    j = d.join(top, list(group)) if group else d.crossJoin(F.broadcast(top))  # one row
    return j.withColumn("importance", F.round(F.coalesce(F.try_divide("weighted_degree", "top"), F.lit(0.0)), 6)).drop("top")


def paths(edges: DataFrame, nodes: DataFrame, start: Column, goal: Column, max_hops: int) -> DataFrame:
    """(path, hops) from older to newer along reversed citations (source cites target): no node twice, years never
    falling where both are known. Each hop is a join; the frontier holds paths of one length."""
    y = nodes.select(F.col("id").alias("nid"), "year")
    e = edges.filter("source != target").select(F.col("target").alias("u"), F.col("source").alias("v")).distinct()
    e = e.join(y.withColumnsRenamed({"nid": "u", "year": "yu"}), "u").join(y.withColumnsRenamed({"nid": "v", "year": "yv"}), "v")
    e = written(e.filter(F.coalesce(F.col("yv") >= F.col("yu"), F.lit(True))).select("u", "v"), "steps")
    front = nodes.filter(start).select(F.array("id").alias("path"), F.col("id").alias("u")).withColumn("hops", F.lit(0))
    ends = nodes.filter(goal).select(F.col("id").alias("v"), F.lit(True).alias("goal"))
    out = None
    for _ in range(max_hops):
        nxt = front.join(e, "u").filter(~F.array_contains("path", F.col("v"))).select(F.concat("path", F.array("v")).alias("path"), "v", (F.col("hops") + 1).alias("hops"))
        nxt = written(nxt.join(ends, "v", "left"), "paths")
        done = nxt.filter("goal").select("path", "hops")
        out = done if out is None else out.unionByName(done)
        front = nxt.filter("goal is null").select("path", F.col("v").alias("u"), "hops")
    return out


def path_scores(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Impact of each path (sum of ln(1 + citations)) and its score: impact per node plus one over the hops."""
    x = found.withColumn("pid", F.array_join(F.transform("path", lambda p: p.cast("string")), ">"))
    n = nodes.select(F.col("id").alias("nid"), F.log1p(F.greatest(F.coalesce("citation_count", F.lit(0)), F.lit(0)).cast("double")).alias("i"))
    i = x.select("pid", "hops", F.explode("path").alias("nid")).join(n, "nid").groupBy("pid", "hops").agg(F.sum("i").alias("impact"))
    return i.select("pid", "hops", F.round("impact", 6).alias("impact"), F.round(F.col("impact") / (F.col("hops") + 1) + 1 / F.col("hops"), 6).alias("score"))


def edge_faults(edges: DataFrame) -> DataFrame:
    """(source, target, relation, fault) of loops and missing weights."""
    f = F.array_compact(F.array(F.when(F.col("source") == F.col("target"), F.lit("self loop")), F.when(F.col("weight").isNull(), F.lit("missing weight")), F.when(F.col("relation").isNull(), F.lit("missing relation"))))
    return edges.select("source", "target", "relation", F.explode(f).alias("fault"))


def identity_groups(records: DataFrame, ident: str, keys: Sequence[str], rank: Sequence[str]) -> DataFrame:
    """(id, group_size, representative, methods): records joined by any common key value, transitively; the
    representative is the largest in ``rank``. Records without a key stay single.

    Records meet at their key values (a bipartite graph), so a value that a third of all records share makes one
    edge per record, never a pair of records."""
    r = records.select(F.col(ident).alias("rid"), *keys, F.struct(*rank, F.col(ident).alias("__i")).alias("rank"))
    node = lambda k, v: F.concat(F.lit(f"{k}\x1f"), v.cast("string"))
    e = r.select(node("row", F.col("rid")).alias("a"), F.explode(F.array_compact(F.array(*(F.when(F.col(k).isNotNull(), node("key_" + k, F.col(k))) for k in keys)))).alias("b"))
    c = components(e, "a", "b").withColumnRenamed("node", "a")
    g = r.withColumn("a", node("row", F.col("rid"))).join(c, "a", "left").withColumn("g", F.coalesce("component", "a"))
    shared = e.join(c, "a").groupBy("component", "b").agg(F.count("*").alias("n")).filter("n > 1").groupBy(F.col("component").alias("g")).agg(F.array_sort(F.collect_set(F.regexp_extract("b", "^key_([^\x1f]*)\x1f", 1))).alias("methods"))  # one per kind of key
    s = g.groupBy("g").agg(F.count("*").alias("group_size"), F.max("rank").alias("best")).join(shared, "g", "left")
    return g.select("rid", "g").join(s, "g").select(F.col("rid").alias("id"), "group_size", F.col("best.__i").alias("representative"), F.coalesce("methods", F.array().cast("array<string>")).alias("methods"))


def greedy_clusters(vectors: DataFrame, group: str, ident: str, vector: str, least: float) -> DataFrame:
    """(ident, group, cluster): each vector, in order of id, goes to the cluster of its group with the member of the
    highest cosine, if that is ``least`` or more (ties to the earlier), else begins a new one. Null, empty and zero vectors are clusters of their own.

    The order makes it sequential within a group; rows stream through sorted, and a task holds the vectors of a group."""
    src = vectors.select(F.col(ident).alias("i"), F.col(group).alias("g"), F.transform(F.coalesce(vector, F.array().cast(vectors.schema[vector].dataType)), lambda x: x.cast("double")).alias("v"))
    kinds = [src.schema[c].dataType.simpleString() for c in ("i", "g")]

    def run(batches):
        now, m, own, n = None, np.zeros((0, 0)), [], 0  # unit vectors, the first len(own) in use, and their clusters
        for b in batches:
            out = []
            for g, v in zip(b.column("g").to_pylist(), b.column("v").to_pylist()):
                if (g,) != now:
                    now, own, n = (g,), [], 0
                x = np.array(v, float)
                size = np.linalg.norm(x) if len(x) else 0.0
                to = n
                if size > 0:
                    if own:
                        s = m[: len(own)] @ (x / size)
                        if s.max() >= least:
                            to = min(own[i] for i in np.flatnonzero(s == s.max()))
                        if len(own) == len(m):
                            m = np.concatenate([m, np.empty_like(m)])
                    else:
                        m = np.empty((16, len(x)))
                    m[len(own)] = x / size
                    own.append(to)
                out.append(to)
                n += to == n
            yield pa.RecordBatch.from_arrays([b.column("i"), b.column("g"), pa.array(out, pa.int32())], [ident, group, "cluster"])

    return src.repartition("g").sortWithinPartitions("g", "i").mapInArrow(run, f"{ident} {kinds[0]}, {group} {kinds[1]}, cluster int")
