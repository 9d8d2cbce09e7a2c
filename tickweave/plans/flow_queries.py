"""Queries of sources, sinks and incremental flows; files go into the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.functions import ids as I
from tickweave.operators import expr as E
from tickweave.operators import store as S
from tickweave.plans.daily_queries import _LAB
from tickweave.plans.panels import TICKS, rows
from tickweave.plans.corpus_queries import _DOI, _M, _W, _metrics, _works
from tickweave.runtime import table, work_dir
from tickweave.sources import tables as T
from tickweave.streaming import flows as X


def _place(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def s1_s7_two_phase(spark: SparkSession, folder: str) -> DataFrame:
    """Classify on three columns, then fetch the wide rows of the hits by semi-join; one lazy plan."""
    w = T.snapshot(spark, f"{folder}/works.parquet")
    hit = w.filter("publication_year >= 2016").filter(F.contains(F.lower("title"), F.lit("order"))).select("rec_id")
    return w.join(hit, "rec_id", "left_semi").select("rec_id", "title", "venue", F.col("publication_year").alias("year"), F.size("authors").alias("n_authors"))


def s3_layout(spark: SparkSession, folder: str) -> DataFrame:
    """Ticks written by date and read back for one day: the partition prunes."""
    p = _place(spark, "ticks")
    t = table(spark, folder, "ticks").filter("date is not null").select("date", "tick_id", "close")
    T.write_product(t, p, ["date"])
    back = spark.read.parquet(p)
    return back.filter(F.col("date") == F.lit("2018-01-03").cast("date")).agg(F.count("*").alias("n"), F.min("tick_id").alias("first"), F.max("tick_id").alias("last"))


def s4_metric_files(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics through Parquet, CSV and JSON lines; each reader gives the same."""
    return _metric_files(spark, _metrics(spark, folder))


def _metric_files(spark: SparkSession, metrics: DataFrame) -> DataFrame:
    m = metrics.withColumns({"code": F.col("code").cast("string"), "horizon": F.col("horizon").cast("string")})
    out = None
    for kind in ("parquet", "csv", "jsonl"):
        p = f"{_place(spark, 'metrics')}.{kind}"
        w = m.write.option("header", "true")
        w.parquet(p) if kind == "parquet" else w.csv(p) if kind == "csv" else w.json(p)
        r = T.metrics(spark, p).groupBy("factor_name").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.round(F.avg("daily_rankic"), 6).alias("mean_rankic"), F.sum("n_obs").alias("n_obs"))
        out = r if out is None else out.unionByName(r)
    return out


def s5_s6_json_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Strict and lenient reads of a store into which every tenth line was broken, and the broken lines."""
    p = _place(spark, "lines")
    f = table(spark, folder, "feedback_memory").select("rec_id", "feedback_id", "reason")
    line = F.to_json(F.struct("rec_id", "feedback_id", "reason"))
    f.select(F.when(F.col("rec_id") % 10 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(p)
    schema = f.schema
    good = T.json_lines(spark, p, schema, strict=False).filter("rec_id is not null").agg(F.count("*").alias("n_good"), F.sum("rec_id").alias("sum_good"))
    return good.crossJoin(F.broadcast(T.broken_lines(spark, p, schema).agg(F.count("*").alias("n_broken"))))  # one row each


def _feed_rows(nodes: DataFrame) -> DataFrame:
    xml = F.concat(F.lit("<rss><channel><item><title>"), "title", F.lit("</title><link>https://x.org/"), F.col("rec_id").cast("string"), F.lit("</link><pubDate>Mon, 06 Jan 2025 10:00:00 GMT</pubDate></item></channel></rss>"))
    return T.feeds(nodes.select(F.col("rec_id").cast("string").alias("path"), F.encode(xml, "UTF-8").alias("content"))).select(F.col("path").cast("long").alias("rec_id"), "title", "url")


def s8_feeds(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of an RSS document per node; a missing title is an empty one."""
    return _feed_rows(table(spark, folder, "graph_nodes").select("rec_id", T.xml_text(F.coalesce("title", F.lit(""))).alias("title")))


def s14_s15_products(spark: SparkSession, folder: str) -> DataFrame:
    """One table written as three products; rows of each as read back."""
    w = _works(spark, folder)
    specs = {"retrieval": (None, ["rec_id", "title"]), "identity": (F.col("doi").isNotNull(), ["rec_id", "id", "doi"]), "seeds": (F.col("year") >= 2020, ["rec_id", "year"])}
    out = None
    for name, p in T.products(w, specs, _place(spark, "products")).items():
        r = spark.read.parquet(p).agg(F.lit(name).alias("product"), F.count("*").alias("n"), F.sum("rec_id").alias("ids"))
        out = r if out is None else out.unionByName(r)
    return out


def s16_unfinished(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "graph_nodes").select(F.col("rec_id").cast("string").alias("path"), F.md5(F.coalesce("title", F.lit(""))).alias("sha"))
    done = f.filter(F.col("path").cast("long") % 2 == 0).withColumn("config_hash", F.when(F.col("path").cast("long") % 4 == 0, "old").otherwise("new"))
    return T.unfinished(f, done, "new").select(F.col("path").cast("long").alias("rec_id"))


def s17_s19_stores(spark: SparkSession, folder: str) -> DataFrame:
    """Records appended twice, rewritten with one of each, and split by status."""
    p = _place(spark, "store")
    f = table(spark, folder, "feedback_memory").select("rec_id", F.coalesce("direction", F.lit("unknown")).alias("status"))
    T.append_records(f, p, "memory_id", "2025-01-01T00:00:00Z")
    T.append_records(f.filter("rec_id % 2 = 0"), p, "memory_id", "2025-01-02T00:00:00Z")
    back = S.last_wins(spark.read.json(p), ["rec_id"], ["updated_at"])
    T.rewrite_records(spark, back, p)
    n = T.by_status(spark.read.json(p), "status", _place(spark, "by-status"))
    return n


def s21_channels(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "graph_nodes").select("id", F.coalesce("source", F.lit("?")).alias("source"), "rec_id").filter("id is not null")
    one, counts = T.channel_counts(n, "id", "source")
    return one.groupBy("source").agg(F.count("*").alias("n_first")).join(counts, "source", "right").select("source", F.coalesce("n_first", F.lit(0)).alias("n_first"), "n", "n_ids")


def s13_s23_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every third file of a manifest of the days, from the second on, and evenly spaced ones."""
    m = table(spark, folder, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_date")).distinct()
    part = T.shard(T.manifest_range(m, "1995-01-01", "1995-01-31"), "updated_date", 1, 3).select("updated_date", F.lit("shard").alias("how"))
    every = T.evenly_spaced(31, 5)
    even = spark.createDataFrame([(f"1995-01-{i + 1:02d}", "even") for i in every], "updated_date string, how string")
    return part.unionByName(even)


def s20_s22_experiment(spark: SparkSession, folder: str) -> DataFrame:
    """An experiment's files behind an access contract, read back."""
    from tickweave.operators import daily as D
    from tickweave.plans.daily_queries import _labelled

    T.Contract(paths=("*ticks.parquet",), blocked=E.LABELS).check(f"{folder}/ticks.parquet", ["close", "code"])
    r = _labelled(spark, folder)
    p = _place(spark, "experiment")
    T.experiment(D.evaluate(r, 2), D.rank_ic(r, 2), {"operator": "momentum_sum"}, p)
    return spark.read.parquet(f"{p}/daily_metrics.parquet").agg(F.count("*").alias("n_days"), F.round(F.avg("rank_ic"), 6).alias("mean_ic"))


def h35_h36_formulas(spark: SparkSession, folder: str) -> DataFrame:
    """Formulas in brackets and in infix text, read within bounds, and run on the ticks."""
    from tickweave.plans.panels import tick_panel

    f = {"spread": E.read_sexpr("( safe_div ( sub askP1 bidP1 ) close )"), "trend": E.from_infix("rolling_mean(close, 3) - last_close"), "repaired": E.repair({"op": "ts_mean", "x": "close", "window": "4"})}
    x = E.evaluate(tick_panel(spark, folder), f, keep=["seq"])
    return x.select("seq", *(F.round(k, 9 if k == "spread" else 6).alias(k) for k in f))


def h38_templates(spark: SparkSession, folder: str) -> DataFrame:
    """The two best templates of each family, by type, price and key."""
    p = table(spark, folder, "part").select(F.col("p_brand").alias("family"), "p_type", "p_retailprice", "p_partkey")
    return S.capped(p, ["family"], [F.desc("p_type"), F.desc("p_retailprice"), F.col("p_partkey")], 2).select("family", "p_partkey", "rank")


# flows -----------------------------------------------------------------------------------------------------------


def x1_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a stream of shards, each processed once; a second run finds nothing new."""
    src, out, ck = _place(spark, "shards"), _place(spark, "sums"), _place(spark, "ck")
    e = table(spark, folder, "events").select("event_id", "event_type", "value")
    e.write.mode("append").parquet(src)
    step = lambda b: b.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    for _ in range(2):
        X.incremental_shards(spark, src, e.schema, step, out, ck).awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


def x_windows(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    x = X.windowed_counts(e, "ts", ["event_type"], "value", "6 hours")
    return x.select(F.unix_timestamp("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


_MOVES = (("idle", "view", "open"), ("open", "click", "active"), ("active", "purchase", "done"), ("done", "view", "open"), ("active", "view", "open"))


def x2_replay(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").filter("user_id is not null")
    m = spark.createDataFrame(_MOVES, "state string, kind string, next string")
    return X.replayed(e, "user_id", "event_id", "event_type", m, "idle")


def x3_ledger(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("user_id", (F.col("event_id") % 997).alias("entry"), F.round("value", 2).alias("value"), "event_id")
    return X.ledger(e, ["user_id"], "entry", "value", "event_id", 2000.0).select("event_id", F.round("spent", 2).alias("spent"), "verdict")


def x4_chain(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window as W

    e = table(spark, folder, "events").select("user_id", "event_id")
    w = W.partitionBy("user_id").orderBy("event_id")
    e = e.withColumns({"seq": F.row_number().over(w) + F.when(F.col("event_id") % 500 == 0, 1).otherwise(0), "id": F.concat(F.lit("e"), "event_id"), "prev": F.when(F.col("event_id") % 301 == 0, F.lit("?")).otherwise(F.concat(F.lit("e"), F.lag("event_id").over(w)))})
    return X.chain_faults(e, "user_id", "seq", "id", "prev").select("event_id", "fault")


def x5_transitions(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("user_id", "event_id", "event_type")
    allowed = spark.createDataFrame([(a, b) for a in ("view", "click", "purchase", "signup", "logout") for b in ("view", "click")], "state string, next string")
    return X.transition_faults(e, "user_id", "event_id", "event_type", allowed).groupBy("before", "event_type").agg(F.count("*").alias("n"))


def x7_new_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Preprints of which neither DOI nor title is among the works."""
    keys = lambda d: F.array_compact(F.array(F.concat(F.lit("doi:"), I.doi(F.col("doi"))), F.concat(F.lit("title:"), I.canonical_title(F.col("title")))))
    w, p = (table(spark, folder, n).select("rec_id", "title", "doi").withColumn("keys", keys(None)) for n in ("works", "preprints"))
    return X.new_rows(p, w, "keys").select("rec_id")


def x8_cache(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_id", "fetched_at")
    cache = d.filter("doc_id % 3 = 0").select("doc_id", F.lit("ok").alias("result"))
    return X.cached(d, cache, ["doc_id"], "result", 100, ["fetched_at", "doc_id"]).groupBy("status").agg(F.count("*").alias("n"))


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_")}
_TK = "regexp_replace(regexp_replace(regexp_replace(replace(replace(lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))), '&lt;', '<'), '&amp;', '&'), '\\([^)]*\\)|\\[[^\\]]*\\]|（[^）]*）|【[^】]*】', '', 'g'), '[\\s\\-_–—]+', '', 'g'), '[^0-9a-z\\x{4e00}-\\x{9fff}]+', '', 'g')"
_KINDS = " UNION ALL ".join(f"SELECT factor_name, '{k}' AS kind, count(*) AS n, round(avg(daily_rankic), 6) AS mean_rankic, CAST(sum(n_obs) AS BIGINT) AS n_obs FROM m GROUP BY 1" for k in ("parquet", "csv", "jsonl"))
ORACLE = {
    "s1_s7_two_phase": "SELECT rec_id, title, venue, publication_year AS year, CAST(coalesce(len(authors), NULL) AS INTEGER) AS n_authors FROM works WHERE publication_year >= 2016 AND contains(lower(title), 'order')",
    "s3_layout": "SELECT count(*) AS n, min(tick_id) AS first, max(tick_id) AS last FROM ticks WHERE date = DATE '2018-01-03'",
    "s4_metric_files": f"WITH {_M} {_KINDS}",
    "s5_s6_json_lines": "SELECT count(*) FILTER (rec_id % 10 <> 0) AS n_good, CAST(sum(rec_id) FILTER (rec_id % 10 <> 0) AS BIGINT) AS sum_good, count(*) FILTER (rec_id % 10 = 0) AS n_broken FROM feedback_memory",
    "s14_s15_products": f"WITH {_W} SELECT 'retrieval' AS product, count(*) AS n, CAST(sum(rec_id) AS BIGINT) AS ids FROM w UNION ALL SELECT 'identity', count(*), CAST(sum(rec_id) AS BIGINT) FROM w WHERE doi IS NOT NULL UNION ALL SELECT 'seeds', count(*), CAST(sum(rec_id) AS BIGINT) FROM w WHERE year >= 2020",
    "s16_unfinished": "SELECT rec_id FROM graph_nodes WHERE NOT (rec_id % 2 = 0 AND rec_id % 4 <> 0)",
    "s17_s19_stores": "SELECT coalesce(direction, 'unknown') AS status, count(*) AS n FROM feedback_memory GROUP BY 1",
    "s21_channels": "WITH n AS (SELECT id, coalesce(source, '?') AS source FROM graph_nodes WHERE id IS NOT NULL), f AS (SELECT id, min(source) AS source FROM n GROUP BY 1) SELECT source, coalesce((SELECT count(*) FROM f WHERE f.source = n.source), 0) AS n_first, count(*) AS n, count(DISTINCT id) AS n_ids FROM n GROUP BY source",
    "s13_s23_manifest": "SELECT updated_date, 'shard' AS how FROM (SELECT *, row_number() OVER (ORDER BY updated_date) - 1 AS i FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS updated_date FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-01-31')) WHERE i % 3 = 1 UNION ALL SELECT unnest(['1995-01-01', '1995-01-09', '1995-01-16', '1995-01-23', '1995-01-31']), 'even'",
    "s8_feeds": "SELECT rec_id, regexp_replace(coalesce(title, ''), '^[\\s\\x{a0}\\x{3000}]+|[\\s\\x{a0}\\x{3000}]+$', '', 'g') AS title, 'https://x.org/' || rec_id AS url FROM graph_nodes",
    "s20_s22_experiment": "WITH " + _LAB.replace(">= 5", ">= 2") + " SELECT count(*) AS n_days, round(avg(rank_ic), 6) AS mean_ic FROM ic",
    "h35_h36_formulas": f"WITH {TICKS} SELECT seq, round((askP1 - bidP1) / (close + CAST(1e-12 AS DOUBLE)), 9) AS spread, round(avg(close) {rows(3)} - last_close, 6) AS trend, round(avg(close) {rows(4)}, 6) AS repaired FROM panel",
    "h38_templates": "SELECT * FROM (SELECT p_brand AS family, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_type DESC, p_retailprice DESC, p_partkey) AS INTEGER) AS rank FROM part) WHERE rank <= 2",
    "x1_incremental": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1",
    "x_windows": "SELECT CAST(epoch(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "x2_replay": "WITH RECURSIVE m(s, k, t) AS (VALUES " + ", ".join(str(x) for x in _MOVES) + "), e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE user_id IS NOT NULL), r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, 'idle' AS state, 0 AS refused FROM e UNION ALL SELECT r.user_id, e.i, coalesce(m.t, r.state), r.refused + CAST(m.t IS NULL AS INTEGER) FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1 LEFT JOIN m ON m.s = r.state AND m.k = e.event_type) SELECT user_id, state, refused, CAST(i AS INTEGER) AS events FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS last FROM r) WHERE last = 1",
    "x3_ledger": "WITH e AS (SELECT user_id, event_id % 997 AS entry, round(value, 2) AS value, event_id FROM events), x AS (SELECT *, row_number() OVER (PARTITION BY user_id, entry ORDER BY event_id) = 1 AS f, first_value(value) OVER (PARTITION BY user_id, entry ORDER BY event_id) AS was FROM e), y AS (SELECT *, sum(CASE WHEN f THEN coalesce(value, 0) ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS spent FROM x) SELECT event_id, round(spent, 2) AS spent, CASE WHEN NOT f AND was IS NOT DISTINCT FROM value THEN 'replay' WHEN NOT f THEN 'conflict' WHEN spent > 2000 THEN 'rejected' ELSE 'accepted' END AS verdict FROM y",
    "x4_chain": "WITH e AS (SELECT *, row_number() OVER w + CASE WHEN event_id % 500 = 0 THEN 1 ELSE 0 END AS seq, lag(event_id) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), f AS (SELECT *, lag(event_id) OVER w AS b2, lag(seq) OVER w AS s2 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY seq)), g AS (SELECT event_id, CASE WHEN CASE WHEN event_id % 301 = 0 THEN -1 ELSE before END IS DISTINCT FROM b2 THEN 'broken link' WHEN s2 IS NOT NULL AND seq <> s2 + 1 THEN 'gap' END AS fault FROM f) SELECT * FROM g WHERE fault IS NOT NULL",
    "x5_transitions": "SELECT before, event_type, count(*) AS n FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS NOT NULL AND NOT (before IN ('view', 'click', 'purchase', 'signup', 'logout') AND event_type IN ('view', 'click')) GROUP BY ALL",
    "x7_new_rows": f"WITH p AS (SELECT rec_id, {_TK} AS k, {_DOI} AS d FROM preprints), w AS (SELECT {_TK} AS k, {_DOI} AS d FROM works) SELECT rec_id FROM p WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.k = p.k) AND NOT EXISTS (SELECT 1 FROM w WHERE w.d = p.d)",
    "x8_cache": "WITH d AS (SELECT doc_id, doc_id % 3 = 0 AS c, row_number() OVER (PARTITION BY doc_id % 3 = 0 ORDER BY fetched_at NULLS FIRST, doc_id) AS r FROM documents) SELECT CASE WHEN c THEN 'cached' WHEN r <= 100 THEN 'due' ELSE 'pending' END AS status, count(*) AS n FROM d GROUP BY 1",
}
