"""Queries of greedy selections and of what is left of joins and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.functions import ids as I
from tickweave.functions import text as X
from tickweave.operators import greedy as Y
from tickweave.plans.corpus_queries import _DOI, _L, _R, _latest, _refs, _works
from tickweave.runtime import table
from tickweave.sources import tables as T


def f15_t42_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Deterministic ids of edges, made in the JVM from sorted fields."""
    r = _refs(spark, folder)
    return r.select("source", "target", I.row_id("edge", {"source": F.col("source"), "target": F.col("target")}, 24).alias("edge_id"))


def g9_g18_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted score of unit-interval features, routed by thresholds, with a feedback adjustment within 0.2."""
    n = table(spark, folder, "graph_nodes").select("rec_id", F.least(F.coalesce("citation_count", F.lit(0)) / 500, F.lit(1.0)).alias("cites"), F.least(F.coalesce("global_impact", F.lit(0.0)), F.lit(1.0)).alias("impact"), F.coalesce(F.col("is_seed").cast("double"), F.lit(0.0)).alias("seed"))
    base = 0.5 * F.col("impact") + 0.3 * F.col("cites") + 0.2 * F.col("seed")
    adjust = F.greatest(F.lit(-0.2), F.least(F.lit(0.2), (F.col("rec_id") % 7 - 3) / 10))
    s = F.round(base + adjust, 6)
    return n.select("rec_id", s.alias("score"), F.when(s >= 0.6, "deep").when(s >= 0.3, "light").otherwise("park").alias("route"))


def g10_portfolio(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    return Y.portfolio(p.select("p_partkey", F.col("p_size").cast("double").alias("s"), F.round(F.col("p_retailprice"), 2).alias("c"), "p_brand"), "p_partkey", "s", "c", "p_brand", 25, 30000.0, 2)


def g11_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Six works that cite most others between them."""
    return Y.coverage(_refs(spark, folder), "source", "target", 6)


def g12_round_robin(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "graph_nodes").select("rec_id", F.coalesce("source", F.lit("?")).alias("source"))
    return Y.round_robin(n, ["source"], "rec_id", 40, "seed-2:").select("rec_id", "source", "turn")


def r11_r12_reserved(spark: SparkSession, folder: str) -> DataFrame:
    """Best forty nodes by citations per year at a given year, at least fifteen of them seeds."""
    n = table(spark, folder, "graph_nodes").select("rec_id", "is_seed", F.round(F.coalesce("citation_count", F.lit(0)) / F.greatest(F.lit(1), 2026 - F.coalesce("year", F.lit(2000))), 6).alias("rate"))
    return Y.reserved(n, F.col("is_seed"), [F.desc("rate"), F.col("rec_id")], 40, 15).select("rec_id", "rate", "special", "tier")


def r21_parents(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "feedback_memory").select("rec_id", F.round(F.coalesce("daily_rankic", F.lit(0.0)), 6).alias("priority"))
    return f.orderBy(F.desc("priority"), F.desc("rec_id")).limit(12)


def r23_balanced(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "feedback_memory").select("rec_id", "daily_rankic", "created_at")
    return Y.balanced(f, F.when(F.col("daily_rankic") > 0, "positive").otherwise("warning"), [F.desc_nulls_last(F.abs("daily_rankic")), F.col("rec_id")], F.col("created_at"), "rec_id", 5, 4, "seed-3:")


def r27_context(spark: SparkSession, folder: str) -> DataFrame:
    """Notes of the records that fit into 2,000 characters, warnings going first."""
    return _context(table(spark, folder, "feedback_memory"))


def _context(feedback: DataFrame) -> DataFrame:
    f = feedback.filter("reason is not null").select("rec_id", "reason", F.coalesce("direction", F.lit("unknown")).alias("tier"))
    return Y.within_size(f, ["positive", "negative", "unknown"], "tier", "rec_id", "reason", 2000).select("rec_id", "tier", F.col("upto").cast("long").alias("upto"))


def j8_views(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes with their node and its sources, one row per source."""
    e = table(spark, folder, "evidence").select("rec_id", "paper_id").filter("paper_id is not null")
    m = table(spark, folder, "graph_nodes").filter("id is not null").groupBy(F.col("id").alias("paper_id")).agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return e.join(m, "paper_id", "left").select("rec_id", "paper_id", F.explode_outer("sources").alias("source"))


def j15_g4_relations(spark: SparkSession, folder: str) -> DataFrame:
    """Verified relations between known works, each once, strongest first."""
    w = _latest(spark, folder).select("id", "cited_by")
    r = _refs(spark, folder).withColumn("relation", F.when(F.length("source") % 2 == 0, "SUPPORTS").otherwise("EXTENDS")).withColumn("verified", F.substring("target", -1, 1).isin("0", "2", "4", "6", "8"))
    x = r.filter("verified").join(w.select(F.col("id").alias("source")), "source", "left_semi").join(w.withColumnRenamed("id", "target"), "target").dropDuplicates(["source", "target", "relation"])
    return x.select("source", "target", "relation", F.coalesce("cited_by", F.lit(0)).alias("weight"))


def t32_keep(spark: SparkSession, folder: str) -> DataFrame:
    """Notes kept by hits of wanted against blocked fields."""
    d = table(spark, folder, "documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    n = lambda ks: sum((F.contains("t", F.lit(k)).cast("int") for k in ks), F.lit(0))
    good, bad = n(("order book", "volume", "spread", "microprice")), n(("forward return", "tanh", "library"))
    return d.select("doc_id", good.alias("wanted"), bad.alias("blocked"), (good > bad).alias("keep"))


def t47_reading(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of each long document to read: the best of three tasks in turn, then in order."""
    d = table(spark, folder, "documents").filter(F.length("text") > 1500).select("doc_id", X.chunks(F.col("text"), 300).alias("c"))
    tasks = ("order book", "volume", "basis points")
    s = F.transform("c", lambda x: F.map_from_arrays(F.array(*map(F.lit, tasks)), F.array(*(F.size(F.split(F.lower(x), t)) - 1 for t in tasks))))
    return d.select("doc_id", F.array_join(F.transform(X.selected_chunks(s, tasks, 6), lambda i: i.cast("string")), ",").alias("chunks"))


def s11_s12_archives(spark: SparkSession, folder: str) -> DataFrame:
    """TeX members of archives made from TeX documents, with an id for each file."""
    import io
    import tarfile

    import pandas as pd

    def pack(batches):
        for b in batches:
            out = []
            for i, t in zip(b["doc_id"], b["text"]):
                buf = io.BytesIO()
                with tarfile.open(fileobj=buf, mode="w:gz") as tar:
                    for name, body in (("main.tex", t.encode("utf-8", "replace")), ("notes.md", b"x")):
                        m = tarfile.TarInfo(name)
                        m.size = len(body)
                        tar.addfile(m, io.BytesIO(body))
                out.append((f"/raw/{i}.tar.gz", buf.getvalue()))
            yield pd.DataFrame(out, columns=["path", "content"])

    d = table(spark, folder, "documents").filter(F.contains("text", F.lit("\\section{")))
    files = d.select("doc_id", "text").mapInPandas(pack, "path string, content binary")
    return T.tex_archives(files).select(F.substring(F.sha1("path"), 1, 16).alias("file_id"), "member", F.length("text").alias("n_chars"))


def u14_u17_updates(spark: SparkSession, folder: str) -> DataFrame:
    """Preprints merged by bare id over deliveries: the last value of each field that is not blank."""
    from tickweave.operators.store import fill_merge

    p = table(spark, folder, "preprints").select(I.arxiv(F.col("arxiv_id")).alias("id"), "rec_id", I.doi(F.col("doi")).alias("doi"), "category", "received_at").filter("id is not null")
    return fill_merge(p, ["id"], ["received_at", "rec_id"], ["doi", "category"], last=True)


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_")}
_has = lambda ks: " + ".join(f"CAST(contains(t, '{k}') AS INTEGER)" for k in ks)
_STEPS = ", ".join(
    f"b{k} AS (SELECT source, count(*) AS c FROM u{k} GROUP BY source ORDER BY c DESC, source LIMIT 1), u{k + 1} AS (SELECT * FROM u{k} WHERE target NOT IN (SELECT target FROM u{k} WHERE source IN (SELECT source FROM b{k})))"
    for k in range(1, 7)
)
_PICKS = " UNION ALL ".join(f"SELECT source AS pick, {k} AS rank, c AS new_targets FROM b{k}" for k in range(1, 7))
ORACLE = {
    "g11_coverage": f"WITH {_R}, u1 AS (SELECT source, target FROM r), {_STEPS} {_PICKS}",
    "g10_portfolio": "WITH RECURSIVE p AS (SELECT p_partkey, round(p_retailprice, 2) AS c, coalesce(p_brand, '?') AS b, row_number() OVER (ORDER BY CAST(p_size AS DOUBLE) DESC, p_partkey) AS i FROM part WHERE p_partkey IS NOT NULL AND p_size IS NOT NULL AND p_retailprice IS NOT NULL), r AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS picked, CAST(0 AS DOUBLE) AS spent, CAST([] AS VARCHAR[]) AS taken UNION ALL SELECT p.i, CASE WHEN ok THEN p_partkey END, CASE WHEN ok THEN spent + c ELSE spent END, CASE WHEN ok THEN list_append(taken, b) ELSE taken END FROM (SELECT p.*, r.spent, r.taken, r.spent + p.c <= 30000 AND len(list_filter(r.taken, lambda x: x = p.b)) < 2 AS ok FROM r JOIN p ON p.i = r.i + 1 WHERE len(r.taken) < 25) p) SELECT picked AS p_partkey, CAST(len(taken) AS INTEGER) AS rank, spent FROM r WHERE picked IS NOT NULL",
    "f15_t42_keys": f"WITH {_L} SELECT source, target, 'edge_' || left(sha256('{{\"source\":\"' || source || '\",\"target\":\"' || target || '\"}}'), 24) AS edge_id FROM r",
    "g9_g18_scores": "WITH s AS (SELECT rec_id, round(CAST(0.5 AS DOUBLE) * least(coalesce(global_impact, 0), 1) + CAST(0.3 AS DOUBLE) * least(coalesce(citation_count, 0) / CAST(500 AS DOUBLE), 1) + CAST(0.2 AS DOUBLE) * CAST(coalesce(is_seed, false) AS INTEGER) + greatest(CAST(-0.2 AS DOUBLE), least(CAST(0.2 AS DOUBLE), (rec_id % 7 - 3) / CAST(10 AS DOUBLE))), 6) AS score FROM graph_nodes) SELECT *, CASE WHEN score >= 0.6 THEN 'deep' WHEN score >= 0.3 THEN 'light' ELSE 'park' END AS route FROM s",
    "g12_round_robin": "WITH x AS (SELECT rec_id, coalesce(source, '?') AS source, CAST(row_number() OVER (PARTITION BY coalesce(source, '?') ORDER BY sha256('seed-2:' || rec_id)) AS INTEGER) AS turn FROM graph_nodes) SELECT * FROM x ORDER BY turn, source LIMIT 40",
    "r11_r12_reserved": "WITH n AS (SELECT rec_id, coalesce(is_seed, false) AS special, round(coalesce(citation_count, 0) / CAST(greatest(1, 2026 - coalesce(year, 2000)) AS DOUBLE), 6) AS rate FROM graph_nodes), f AS (SELECT * FROM n WHERE special ORDER BY rate DESC, rec_id LIMIT 15), u AS (SELECT *, 0 AS tier FROM f UNION ALL SELECT *, 1 FROM n WHERE rec_id NOT IN (SELECT rec_id FROM f)) SELECT rec_id, rate, special, tier FROM u ORDER BY tier, rate DESC, rec_id LIMIT 40",
    "r21_parents": "SELECT rec_id, round(coalesce(daily_rankic, 0), 6) AS priority FROM feedback_memory ORDER BY priority DESC, rec_id DESC LIMIT 12",
    "r23_balanced": "WITH x AS (SELECT rec_id, created_at, row_number() OVER (PARTITION BY coalesce(daily_rankic, 0) > 0 ORDER BY abs(daily_rankic) DESC NULLS LAST, rec_id) AS r FROM feedback_memory), t AS (SELECT rec_id, 'top' AS why FROM x WHERE r <= 5), l AS (SELECT rec_id, 'recent' AS why FROM x ORDER BY created_at DESC NULLS LAST, rec_id LIMIT 1), e AS (SELECT rec_id, 'explore' AS why FROM x WHERE rec_id NOT IN (SELECT rec_id FROM t UNION SELECT rec_id FROM l) ORDER BY sha256('seed-3:' || rec_id) LIMIT 4) SELECT rec_id, max(why) AS why FROM (SELECT * FROM t UNION ALL SELECT * FROM l UNION ALL SELECT * FROM e) GROUP BY 1",
    "r27_context": "WITH x AS (SELECT rec_id, coalesce(direction, 'unknown') AS tier, CAST(sum(length(reason)) OVER (ORDER BY list_position(['positive', 'negative', 'unknown'], coalesce(direction, 'unknown')), rec_id) AS BIGINT) AS upto FROM feedback_memory WHERE reason IS NOT NULL) SELECT * FROM x WHERE upto <= 2000",
    "j8_views": "WITH m AS (SELECT DISTINCT id, source FROM graph_nodes WHERE id IS NOT NULL AND source IS NOT NULL) SELECT e.rec_id, paper_id, m.source FROM evidence e LEFT JOIN m ON id = paper_id WHERE paper_id IS NOT NULL",
    "j15_g4_relations": f"WITH {_L} SELECT source, target, CASE WHEN length(source) % 2 = 0 THEN 'SUPPORTS' ELSE 'EXTENDS' END AS relation, coalesce(cited_by, 0) AS weight FROM r JOIN l ON l.id = target WHERE source IN (SELECT id FROM l) AND right(target, 1) IN ('0', '2', '4', '6', '8')",
    "t32_keep": f"WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), x AS (SELECT doc_id, {_has(('order book', 'volume', 'spread', 'microprice'))} AS wanted, {_has(('forward return', 'tanh', 'library'))} AS blocked FROM d) SELECT *, wanted > blocked AS keep FROM x",
    "u14_u17_updates": f"WITH p AS (SELECT nullif(regexp_replace(trim(regexp_replace(trim(arxiv_id), '(?i)^arxiv:\\s*', '')), '(?i)v\\d+$', ''), '') AS id, rec_id, {_DOI} AS doi, category, received_at FROM preprints) SELECT id, arg_max(doi, ROW(received_at, rec_id)) FILTER (doi IS NOT NULL) AS doi, arg_max(category, ROW(received_at, rec_id)) FILTER (trim(category) <> '') AS category, count(*) AS n_rows FROM p WHERE id IS NOT NULL GROUP BY id",
}
