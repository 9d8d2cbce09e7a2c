"""Queries of joins, aggregates, selection, de-duplication and graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweave.functions import ids as I
from tickweave.operators import graph as G
from tickweave.operators import store as S
from tickweave.runtime import table


def _works(spark: SparkSession, folder: str) -> DataFrame:
    w = table(spark, folder, "works")
    return w.select("rec_id", I.openalex(F.col("openalex_id")).alias("id"), "title", "authors", F.col("publication_year").alias("year"), I.doi(F.col("doi")).alias("doi"), "venue", F.col("cited_by_count").alias("cited_by"), "referenced_works", "updated_at")


def _refs(spark: SparkSession, folder: str) -> DataFrame:
    w = _works(spark, folder)
    return w.select(F.col("id").alias("source"), F.explode("referenced_works").alias("target")).filter("source is not null and target is not null").distinct()


def _latest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per work id: the last delivered."""
    return S.last_wins(_works(spark, folder).filter("id is not null").drop("authors", "referenced_works"), ["id"], ["updated_at", "rec_id"])


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Stock-level metrics from the line items: a factor per part group and a code per supplier."""
    l = table(spark, folder, "lineitem")
    return l.select(
        F.concat(F.lit("f"), F.col("l_partkey") % 40).alias("factor_name"), F.concat(F.lit("g"), F.col("l_partkey") % 8).alias("factor_field"), F.col("l_suppkey").alias("code"), F.col("l_linenumber").alias("horizon"), F.col("l_orderkey").alias("seq"),
        ((F.col("l_discount") - 0.05) + (F.col("l_extendedprice") % 7) / 1000).alias("daily_ic"), F.when(F.col("l_quantity") > 3, (F.col("l_tax") - 0.04) + (F.col("l_extendedprice") % 11) / 1000).alias("daily_rankic"),
        ((F.col("l_extendedprice") % 13) / 1000 - 0.006).alias("qspread_mean"), F.col("l_quantity").cast("long").alias("n_obs"),
    )


# joins -----------------------------------------------------------------------------------------------------------


def j1_outbound(spark: SparkSession, folder: str) -> DataFrame:
    """Works that the references of the most cited work with known references name, most cited first."""
    w = _latest(spark, folder)
    known = _refs(spark, folder).join(w.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id")).distinct()
    seed = w.join(known, "id", "left_semi").agg(F.max_by("id", F.struct("cited_by", "id")).alias("seed"))
    r = _refs(spark, folder).join(F.broadcast(seed), F.col("source") == F.col("seed"))  # one row
    x = r.select(F.col("target").alias("id")).join(w, "id")
    return x.orderBy(F.desc_nulls_last("cited_by"), F.desc_nulls_last("year"), "id").limit(20).select("id", "year", "cited_by")


def j2_j3_inbound(spark: SparkSession, folder: str) -> DataFrame:
    """Works whose references contain the most referenced id, by array filter and semi-join."""
    refs = _refs(spark, folder)
    n = refs.groupBy("target").agg(F.count("*").alias("n")).agg(F.max_by("target", F.struct("n", "target")).alias("t"))
    ids = _works(spark, folder).join(F.broadcast(n), F.array_contains("referenced_works", F.col("t"))).select("id")  # one row
    return _latest(spark, folder).join(ids.filter("id is not null").distinct(), "id", "left_semi").select("id", "year", "cited_by")


def j4_j5_left(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates with the last metric row of their factor, and the mean of their field."""
    m = _metrics(spark, folder)
    last = m.groupBy("factor_name").agg(F.max_by(F.struct("daily_ic", "n_obs"), F.struct("seq", "code", "horizon", "daily_ic")).alias("m"))
    field = m.groupBy("factor_field").agg(F.avg("daily_ic").alias("field_ic"))
    cand = spark.range(48).select(F.concat(F.lit("f"), F.col("id")).alias("factor_name"), F.concat(F.lit("g"), F.col("id") % 8).alias("factor_field"))
    return cand.join(last, "factor_name", "left").join(field, "factor_field", "left").select("factor_name", F.round("m.daily_ic", 6).alias("daily_ic"), "m.n_obs", F.round("field_ic", 6).alias("field_ic"))


def j6_lineage_delta(spark: SparkSession, folder: str) -> DataFrame:
    """Each feedback record against the first of its factor (the baseline): difference and improvement."""
    f = table(spark, folder, "feedback_memory").select("rec_id", "factor_id", "daily_rankic").filter("factor_id is not null")
    base = f.groupBy("factor_id").agg(F.min(F.struct("rec_id", "daily_rankic")).alias("b"))
    x = f.join(base, "factor_id", "left").filter("rec_id > b.rec_id")
    d = F.col("daily_rankic") - F.col("b.daily_rankic")
    return x.select("rec_id", F.col("b.rec_id").alias("baseline"), F.round(d, 6).alias("delta"), (d > 0).alias("improved"))


def a22_improvement_rate(spark: SparkSession, folder: str) -> DataFrame:
    return j6_lineage_delta(spark, folder).agg(F.count("*").alias("n"), F.round(F.avg(F.col("improved").cast("double")), 6).alias("rate"))


def j7_j9_group_join(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes with the number and the sections of their evidence, by a pre-aggregated left join."""
    n = S.first_seen(table(spark, folder, "graph_nodes").select("rec_id", "id", "role"), ["id"], ["rec_id"]).filter("id is not null")
    e = table(spark, folder, "evidence").filter("paper_id is not null").groupBy(F.col("paper_id").alias("id")).agg(F.count("*").alias("n_quotes"), F.array_join(F.array_sort(F.collect_set("section")), "|").alias("sections"))
    return n.join(e, "id", "left").select("rec_id", "id", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("sections", F.lit("")).alias("sections"))


def j10_r3_embedding_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest of each vector at a cosine of 0.3 or more, each pair once."""
    e = table(spark, folder, "embeddings")
    return G.top_k(G.cosine_pairs(e, "vec_id", "embedding", 0.3), 5).select("a", "b", F.round("score", 5).alias("score"))


def j11_r4_citation_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """Coupling by common references and co-citation, combined by halves, the four best of each work."""
    r = _refs(spark, folder)
    c = G.set_cosine_pairs(r, "source", "target", 0.05).withColumnRenamed("score", "coupling").drop("common")
    k = G.set_cosine_pairs(r, "target", "source", 0.05).withColumnRenamed("score", "cocitation").drop("common")
    x = c.join(k, ["a", "b"], "full").select("a", "b", F.coalesce("coupling", F.lit(0.0)).alias("coupling"), F.coalesce("cocitation", F.lit(0.0)).alias("cocitation"))
    x = x.withColumn("score", F.round((F.col("coupling") + F.col("cocitation")) / 2, 9)).filter("score >= 0.05")
    return G.top_k(x, 4).select("a", "b", F.round("coupling", 6).alias("coupling"), F.round("cocitation", 6).alias("cocitation"), F.round("score", 6).alias("score"))


def j12_r5_author_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Works with common authors, the most common first, four per work in all."""
    w = S.last_wins(_works(spark, folder).filter("id is not null").select("id", "authors", "updated_at", "rec_id"), ["id"], ["updated_at", "rec_id"])
    e = G.shared_keys(w.select("id", F.explode("authors").alias("author")), "id", "author")
    return e.orderBy(F.desc("shared"), "a", "b").limit(4 * w.count())


def j13_keyword_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Customers of one nation and segment whose orders share three priorities (keyword overlap within a topic)."""
    o = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return G.class_shared_keys(o.select(F.col("c_custkey").alias("id"), F.concat_ws("|", "c_nationkey", "c_mktsegment", "o_orderpriority").alias("k")), "id", "k", 3)


def j14_citations(spark: SparkSession, folder: str) -> DataFrame:
    return G.bounded_citations(_refs(spark, folder), _latest(spark, folder).filter("year >= 2015").select("id"))


def j16_j17_ego(spark: SparkSession, folder: str) -> DataFrame:
    """Edges among the most connected node and its first 30 neighbours."""
    c = G.bounded_citations(_refs(spark, folder), _latest(spark, folder).select("id"))
    both = c.select("source", "target").unionByName(c.select(F.col("target").alias("source"), F.col("source").alias("target")))
    seed = both.groupBy("source").agg(F.countDistinct("target").alias("n")).agg(F.max_by("source", F.struct("n", "source")).alias("seed"))
    near = both.join(F.broadcast(seed), F.col("source") == F.col("seed")).select("target").distinct().orderBy("target").limit(30)
    ids = near.select(F.col("target").alias("id")).union(seed.select("seed"))
    return G.bounded_citations(c, ids)


def j18_u1_except(spark: SparkSession, folder: str) -> DataFrame:
    """Customers without orders, as a count and by anti-join."""
    c, o = table(spark, folder, "customer").select("c_custkey"), table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"))
    a = c.subtract(o).agg(F.count("*").alias("n_except"))
    b = c.join(o, "c_custkey", "left_anti").agg(F.countDistinct("c_custkey").alias("n_anti"))
    return a.crossJoin(F.broadcast(b))  # one row each


def j19_lineage(spark: SparkSession, folder: str) -> DataFrame:
    """Each nation and region up to its root by a recursive query, with the change of the key at each step."""
    name = f"nation_{uuid.uuid4().hex}"
    table(spark, folder, "nation").createOrReplaceTempView(name)
    q = f"""WITH RECURSIVE nodes AS (SELECT concat('n', n_nationkey) AS id, concat('r', n_regionkey) AS parent, n_nationkey AS v FROM {name}
      UNION ALL SELECT DISTINCT concat('r', n_regionkey), 'root', n_regionkey FROM {name} UNION ALL SELECT 'root', CAST(NULL AS STRING), 0),
    walk AS (SELECT id AS start, id, parent, v, 0 AS step FROM nodes WHERE id LIKE 'n%' UNION ALL SELECT w.start, n.id, n.parent, n.v, w.step + 1 FROM walk w JOIN nodes n ON n.id = w.parent WHERE w.step < 10)
    SELECT start, id, step, v - lag(v) OVER (PARTITION BY start ORDER BY step) AS delta FROM walk"""
    return spark.sql(q)


def j20_cociters(spark: SparkSession, folder: str) -> DataFrame:
    """Works that are cited together with the most referenced id, by the number of common citers."""
    r = _refs(spark, folder)
    top = r.groupBy("target").agg(F.count("*").alias("n")).agg(F.max_by("target", F.struct("n", "target")).alias("t"))
    citers = r.join(F.broadcast(top), F.col("target") == F.col("t")).select("source")
    return r.join(citers, "source", "left_semi").join(F.broadcast(top), F.col("target") != F.col("t")).groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n"))


def j21_j22_gap(spark: SparkSession, folder: str) -> DataFrame:
    """Positions of the tags of later factors that no accepted record of batch 0 has at that place of that factor
    (position join and anti-join)."""
    f = table(spark, folder, "feedback_memory").select("rec_id", "batch_no", "factor_id", F.posexplode("mechanism_tags").alias("i", "tag"))
    known = f.filter("batch_no = 0").select("factor_id", "i").distinct()
    return f.filter("batch_no > 0").join(known, ["factor_id", "i"], "left_anti").select("rec_id", "i", "tag")


# aggregates ------------------------------------------------------------------------------------------------------


def a1_a2_counts(spark: SparkSession, folder: str) -> DataFrame:
    w = _works(spark, folder)
    return w.agg(F.count("*").alias("n"), F.count_if(F.col("year") >= 2016).alias("n_recent"), F.countDistinct("id").alias("n_ids"))


def a3_a4_summary(spark: SparkSession, folder: str) -> DataFrame:
    return S.metric_summary(_metrics(spark, folder), ["factor_name"], {"daily_ic": "daily_ic", "daily_rankic": "daily_rankic", "qspread": "qspread_mean"}, {"daily_ic": [0.0, 0.01, 0.02, 0.03]}, "n_obs")


def a5_a6_by_field(spark: SparkSession, folder: str) -> DataFrame:
    """By field and horizon, missing values as 0, not rounded (here to 9 places to compare)."""
    x = S.metric_summary(_metrics(spark, folder), ["factor_field", "horizon"], {"daily_rankic": "daily_rankic"}, {"daily_rankic": [0.0015, 0.002]}, "n_obs", digits=9, missing="zero")
    return x.select("factor_field", "horizon", "mean_daily_rankic", "daily_rankic_gt_00015_count", "abs_daily_rankic_gt_0002_ratio", "total_obs", "row_count")


def a9_transitions(spark: SparkSession, folder: str) -> DataFrame:
    """Status changes between deliveries of a node, and their number by year."""
    n = table(spark, folder, "graph_nodes").select("id", "role", "year", "rec_id").filter("id is not null")
    w = W.partitionBy("id").orderBy("rec_id")
    x = n.withColumn("before", F.lag("role").over(w)).filter("before is not null")
    return x.groupBy(F.concat_ws("->", F.coalesce("before", F.lit("?")), F.coalesce("role", F.lit("?"))).alias("transition"), "year").agg(F.count("*").alias("n"))


def a10_confusion(spark: SparkSession, folder: str) -> DataFrame:
    """Share of right labels and the confusion of the sign of the coefficient with the label."""
    f = table(spark, folder, "feedback_memory")
    auto = F.when(F.col("daily_rankic") > 0, "positive").when(F.col("daily_rankic") <= 0, "negative").otherwise("pending")
    return f.groupBy(auto.alias("auto"), F.coalesce("direction", F.lit("unknown")).alias("human")).agg(F.count("*").alias("n"))


def a11_examples(spark: SparkSession, folder: str) -> DataFrame:
    """At most five examples of each source, the first by id, with the number of all."""
    n = table(spark, folder, "graph_nodes").select("rec_id", F.coalesce("source", F.lit("?")).alias("source"))
    x = S.capped(n, ["source"], [F.col("rec_id")], 5)
    return x.join(n.groupBy("source").agg(F.count("*").alias("n")), "source")


def a12_degrees(spark: SparkSession, folder: str) -> DataFrame:
    c = G.bounded_citations(_refs(spark, folder), _latest(spark, folder).select("id")).withColumn("weight", F.lit(1.0))
    return G.weighted_degrees(c)


def a13_memberships(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of each node, their number, the largest impact and the source that has it."""
    n = table(spark, folder, "graph_nodes").filter("id is not null and source is not null")
    g = n.groupBy("id", "source").agg(F.max(F.coalesce("global_impact", F.lit(0.0))).alias("i"))
    return g.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"), F.count("*").alias("n"), F.round(F.max("i"), 6).alias("highest"), F.max_by("source", F.struct("i", "source")).alias("main"))


def a14_a15_consolidated(spark: SparkSession, folder: str) -> DataFrame:
    """Feedback consolidated by expression and direction."""
    f = table(spark, folder, "feedback_memory").withColumn("d", F.coalesce("direction", F.lit("unknown"))).filter("prefix_expression is not null")
    c = S.consolidate(f, ["prefix_expression", "d"], "rec_id", "rec_id", "created_at", lists=["mechanism_tags"], scalars=["reason"])
    return c.select(F.md5("prefix_expression").alias("k"), "d", "occurrence_count", F.array_join(F.transform("source_ids", lambda x: x.cast("string")), ",").alias("ids"), F.array_join("mechanism_tags", "|").alias("tags"), "reason", F.unix_micros(F.col("created_at").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("updated_at").cast("timestamp")).alias("last_us"))


def a16_arms(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "feedback_memory").select(F.coalesce("direction", F.lit("unknown")).alias("arm"), "daily_rankic", "rec_id")
    return S.arm_statistics(f, ["arm"], "daily_rankic", "rec_id").select("arm", "n_trials", F.round("mean_reward", 9).alias("mean_reward"), "n_success", "n_failure", "last_reward")


def a17_tfidf(spark: SparkSession, folder: str) -> DataFrame:
    """The four most distinctive title words of each source."""
    n = table(spark, folder, "graph_nodes").select("source", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit(r"([a-z]{4,})"), F.lit(1)))).alias("t")).filter("source is not null")
    tf = n.groupBy("source", "t").agg(F.count("*").alias("n"))
    df = tf.groupBy("t").agg(F.count("*").alias("df"))
    total = tf.agg(F.countDistinct("source").alias("total"))
    x = tf.join(df, "t").crossJoin(F.broadcast(total)).withColumn("w", F.round(F.col("n") * (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1), 6))  # one row
    return S.capped(x, ["source"], [F.desc("w"), F.col("t")], 4).select("source", "t", "w", "rank")


def a18_a19_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """In how many sources each node is: one, several (bridge) or all."""
    n = table(spark, folder, "graph_nodes").filter("id is not null and source is not null")
    k = n.agg(F.countDistinct("source").alias("total"))
    g = n.groupBy("id").agg(F.countDistinct("source").alias("m")).crossJoin(F.broadcast(k))  # one row
    kind = F.when(F.col("m") == F.col("total"), "all").when(F.col("m") > 1, "bridge").otherwise("one")
    return g.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def a20_a21_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """All and any positive results of each factor, and how many copies it has."""
    f = table(spark, folder, "feedback_memory").filter("factor_id is not null")
    up = F.col("daily_rankic") > 0
    return f.groupBy("factor_id").agg(F.coalesce(F.bool_and(up), F.lit(False)).alias("all_up"), F.coalesce(F.bool_or(up), F.lit(False)).alias("any_up"), (F.count("*") - 1).alias("copies"))


def a23_a26_dashboard(spark: SparkSession, folder: str) -> DataFrame:
    """Histogram in hundredths of the size of the best coefficient of each factor and code."""
    m = _metrics(spark, folder)
    b = S.best_by(m, ["factor_name", "code"], ["daily_ic", "seq", "horizon"], ["daily_ic"])
    return b.groupBy(F.floor(F.round(F.abs("daily_ic") * 100, 6)).alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("daily_ic") > 0).alias("n_positive"))


def a24_a27_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Reasons of the feedback with their numbers and first example."""
    f = table(spark, folder, "feedback_memory")
    return f.groupBy(F.coalesce("reason", F.lit("?")).alias("reason")).agg(F.count("*").alias("n"), F.min("rec_id").alias("first"))


def a25_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return S.nearest_rank(e, ["event_type"], "value", [50, 90, 99])


def a28_store_size(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    g = d.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))
    return g.withColumn("consolidate", (F.col("n") >= 8) | (F.col("chars") >= 24000))


# ranking, sets, merging ------------------------------------------------------------------------------------------


def r1_search_title(spark: SparkSession, folder: str) -> DataFrame:
    w = _works(spark, folder).filter(F.col("title").ilike("%order%") & (F.col("year") >= 2010))
    return w.orderBy(F.desc_nulls_last("cited_by"), F.desc_nulls_last("year"), "rec_id").limit(25).select("rec_id", "title", "year", "cited_by")


def r2_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return _works(spark, folder).filter(F.col("rec_id") == 7).limit(1).select("rec_id", "id", "title")


def r8_semantic(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty nearest vectors of each whose id is divisible by 100, at 0.2 or more, against all rows."""
    e = table(spark, folder, "embeddings")
    return G.cosine_search(e.filter("vec_id % 100 = 0"), e, "vec_id", "embedding", 0.2, 20)


def r13_r16_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Seeds first, then others by impact; one per title, thirty in all, numbered."""
    n = table(spark, folder, "graph_nodes").filter("title is not null").select("rec_id", I.canonical_title(F.col("title")).alias("k"), F.coalesce("is_seed", F.lit(False)).alias("seed"), F.coalesce("global_impact", F.lit(0.0)).alias("impact"))
    one = S.best_by(n, ["k"], ["seed", "impact", "rec_id"], ["rec_id", "seed", "impact"])
    top = S.tiered(one, F.col("seed"), [F.desc("impact"), F.col("rec_id")], 30)
    return top.select("rec_id", "seed", F.row_number().over(W.orderBy(F.desc("seed"), F.desc("impact"), "rec_id")).alias("rank"))  # of thirty rows


def r14_capped(spark: SparkSession, folder: str) -> DataFrame:
    return S.capped(_metrics(spark, folder).select("factor_name", "code", "seq", "horizon", F.round("daily_ic", 9).alias("ic")), ["factor_name"], [F.desc("ic"), F.col("seq"), F.col("horizon"), F.col("code")], 3)


def r17_r18_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Votes of threshold rules per factor and the label they make."""
    s = a3_a4_summary(spark, folder)
    votes = (F.col("mean_daily_ic") > 0.002).cast("int") + (F.col("daily_ic_gt_00_ratio") > 0.5).cast("int") + (F.col("abs_daily_ic_gt_003_ratio") > 0.3).cast("int") + (F.col("mean_qspread") > 0).cast("int")
    return s.select("factor_name", votes.alias("votes"), F.when(votes >= 4, "strong").when(votes == 3, "good").when(votes == 2, "watch").otherwise("weak").alias("label"))


def r19_best_variant(spark: SparkSession, folder: str) -> DataFrame:
    return S.best_by(_metrics(spark, folder), ["factor_field"], ["daily_ic", "seq", "horizon", "code"], ["factor_name", "seq", "horizon"])


def r24_r26_order(spark: SparkSession, folder: str) -> DataFrame:
    """Signals by counts (tags, then text length) and time, a stable order of their places."""
    f = table(spark, folder, "feedback_memory").select("rec_id", F.greatest(F.coalesce(F.size("mechanism_tags"), F.lit(0)), F.lit(0)).alias("n_tags"), F.length(F.coalesce("reason", F.lit(""))).alias("n_reason"))
    return f.orderBy(F.desc("n_tags"), F.desc("n_reason"), "rec_id").limit(50)


def r25_find(spark: SparkSession, folder: str) -> DataFrame:
    """First records whose JSON has both words."""
    f = table(spark, folder, "feedback_memory")
    text = F.lower(F.to_json(F.struct("reason", "label", "mechanism_tags")))
    return f.filter(F.contains(text, F.lit("liquidity")) & F.contains(text, F.lit("flow"))).orderBy("rec_id").limit(30).select("rec_id")


def u2_u3_union_first(spark: SparkSession, folder: str) -> DataFrame:
    """Works and preprints in one list with each title once, the first delivered."""
    a = table(spark, folder, "works").select(F.lit(0).alias("src"), "rec_id", "title")
    b = table(spark, folder, "preprints").select(F.lit(1).alias("src"), "rec_id", "title", "category")
    u = a.unionByName(b, allowMissingColumns=True).withColumn("k", I.canonical_title(F.col("title")))
    return S.first_seen(u, ["k"], ["src", "rec_id"]).select("src", "rec_id", "k", "category")


def u4_u12_library(spark: SparkSession, folder: str) -> DataFrame:
    """Records of later batches whose key the library has (semi) or lacks (anti)."""
    f = table(spark, folder, "feedback_memory").select("rec_id", "batch_no", "canonical_factor_key").filter("canonical_factor_key is not null")
    lib = f.filter("batch_no = 0").select("canonical_factor_key").distinct()
    new = f.filter("batch_no > 0")
    return new.join(lib, "canonical_factor_key", "left_semi").select("rec_id", F.lit("known").alias("state")).unionByName(new.join(lib, "canonical_factor_key", "left_anti").select("rec_id", F.lit("new").alias("state")))


def u5_edges(spark: SparkSession, folder: str) -> DataFrame:
    """First-seen and last-wins reader of each quote."""
    e = table(spark, folder, "evidence").select("evidence_id", "rec_id", "source").filter("evidence_id is not null")
    a = S.first_seen(e, ["evidence_id"], ["rec_id"]).select("evidence_id", F.col("rec_id").alias("first"))
    b = S.last_wins(e, ["evidence_id"], ["rec_id"]).select("evidence_id", F.col("rec_id").alias("last"))
    return a.join(b, "evidence_id")


def u6_u9_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Works merged by id: the last known year, venue and title, the union of the authors."""
    w = _works(spark, folder).filter("id is not null")
    m = S.fill_merge(w, ["id"], ["updated_at", "rec_id"], ["year", "venue"], ["authors"], last=True)
    return m.select("id", "year", "venue", F.array_join("authors", "|").alias("authors"), "n_rows")


def u8_u13_richest(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "graph_nodes").filter("id is not null").select("id", "rec_id", F.length(F.coalesce("abstract", F.lit(""))).alias("rich"), F.coalesce("citation_count", F.lit(0)).alias("cites"))
    return S.richest(n, ["id"], ["rich", "cites"], ["rec_id"]).select("id", "rec_id", "rich", "cites")


def u10_u11_match(spark: SparkSession, folder: str) -> DataFrame:
    """Works equal by DOI, or by title with a common author."""
    w = _works(spark, folder).filter("id is not null").withColumn("k", I.canonical_title(F.col("title")))
    d = w.filter("doi is not null").select(F.col("rec_id").alias("r"), "doi")
    by_doi = d.join(d.withColumnRenamed("r", "s"), "doi").filter("r < s").select("r", "s")
    t = w.select(F.col("rec_id").alias("r"), "k", F.coalesce("authors", F.array().cast("array<string>")).alias("au")).filter("k != ''")
    by_title = t.join(t.withColumnsRenamed({"r": "s", "au": "av"}), "k").filter("r < s").filter(F.arrays_overlap("au", "av")).select("r", "s")
    return by_doi.union(by_title).distinct()


def u15_update(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "feedback_memory").select("rec_id", F.lit(1).alias("usage_count"))
    return S.keyed_update(f, "rec_id", f.filter("rec_id % 3 = 0").select("rec_id"), "usage_count", 2)


# graphs ----------------------------------------------------------------------------------------------------------


def g1_u7_identity(spark: SparkSession, folder: str) -> DataFrame:
    """Works joined by id or DOI, transitively; the representative is the most cited."""
    w = _works(spark, folder)
    g = G.identity_groups(w.select(F.col("rec_id").alias("rid"), F.col("id").alias("openalex"), "doi", F.coalesce("cited_by", F.lit(0)).alias("cited")), "rid", ["openalex", "doi"], ["cited"])
    return g.select(F.col("id").alias("rec_id"), "group_size", "representative", F.array_join("methods", ",").alias("methods"))


def g2_layers(spark: SparkSession, folder: str) -> DataFrame:
    """Layers of one graph: citations, common references and common authors in one edge table, each edge once."""
    w = _latest(spark, folder).select("id")
    direct = G.bounded_citations(_refs(spark, folder), w).withColumns({"relation": F.lit("CITES"), "weight": F.lit(1.0)})
    sim = G.top_k(G.set_cosine_pairs(_refs(spark, folder), "source", "target", 0.2), 5).select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("CITATION_SIMILAR_TO").alias("relation"), F.round("score", 6).alias("weight"))
    au = j12_r5_author_edges(spark, folder).select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("AUTHOR_SHARED_BY").alias("relation"), F.col("shared").cast("double").alias("weight"))
    e = direct.unionByName(sim).unionByName(au)
    return G.merged_graphs(G.undirected(e, F.col("relation") != "CITES"))


def g3_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Evolution paths of at most three hops from the oldest works (before 2008) to the newest (after 2024)."""
    n = _latest(spark, folder).select("id", "year", F.col("cited_by").alias("citation_count"))
    c = G.bounded_citations(_refs(spark, folder), n.select("id"))
    p = G.paths(c, n, F.col("year") < 2008, F.col("year") > 2024, 3)
    return G.path_scores(p, n)


def g5_roles(spark: SparkSession, folder: str) -> DataFrame:
    """Role of each work against the seeds (the most cited ten): seed, prior, derivative or related."""
    n = _latest(spark, folder)
    seeds = n.orderBy(F.desc_nulls_last("cited_by"), "id").limit(10).select(F.col("id").alias("seed"))
    c = G.bounded_citations(_refs(spark, folder), n.select("id"))
    prior = c.join(F.broadcast(seeds), F.col("source") == F.col("seed")).select(F.col("target").alias("id"), F.lit("prior").alias("role"))
    later = c.join(F.broadcast(seeds), F.col("target") == F.col("seed")).select(F.col("source").alias("id"), F.lit("derivative").alias("role"))
    r = seeds.select(F.col("seed").alias("id"), F.lit("a_seed").alias("role")).union(prior).union(later).groupBy("id").agg(F.min("role").alias("role"))
    return n.select("id").join(r, "id", "left").select("id", F.regexp_replace(F.coalesce("role", F.lit("related")), "^a_", "").alias("role"))


def g6_g7_finalised(spark: SparkSession, folder: str) -> DataFrame:
    """The graph cut to its 200 best nodes (seeds kept), with the edges between them, reversed citations turned."""
    n = _latest(spark, folder)
    top = S.tiered(n.select("id", "year", F.coalesce("cited_by", F.lit(0)).alias("c")), F.col("year") == 2015, [F.desc("c"), F.col("id")], 200)
    e = _refs(spark, folder).select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit("CITED_BY").alias("relation"), F.lit(1.0).alias("weight"))
    m = G.merged_graphs(e)
    return G.bounded_citations(m, top.select("id"))


def g8_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors greedily assigned, in order of id, to the cluster of the nearest member, at 0.55 or more (per label)."""
    return G.greedy_clusters(table(spark, folder, "embeddings"), "label", "vec_id", "embedding", 0.55)


def g12_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Stratified sample: per source and role the three records of least hash, a sampling operator."""
    n = table(spark, folder, "graph_nodes").select("rec_id", F.coalesce("source", F.lit("?")).alias("source"), F.coalesce("role", F.lit("?")).alias("role"))
    return S.capped(n, ["source", "role"], [F.sha2(F.concat(F.lit("seed-1:"), F.col("rec_id").cast("string")), 256)], 3).select("rec_id", "source", "role", "rank")


def g13_g14_lineage_state(spark: SparkSession, folder: str) -> DataFrame:
    """Per factor and batch: best so far, generations without a better one, and whether three of them stop it."""
    f = table(spark, folder, "feedback_memory").filter("factor_id is not null").groupBy("factor_id", "batch_no").agg(F.max("daily_rankic").alias("best"))
    w = W.partitionBy("factor_id").orderBy("batch_no")
    before = F.max("best").over(w.rowsBetween(W.unboundedPreceding, -1))
    x = f.withColumn("up", F.coalesce(F.col("best") > before, F.lit(True)))
    run = x.withColumn("block", F.sum(F.col("up").cast("int")).over(w)).withColumn("idle", F.row_number().over(W.partitionBy("factor_id", "block").orderBy("batch_no")) - 1)
    return run.select("factor_id", "batch_no", "best", "idle", (F.col("idle") >= 3).alias("stop"))


def t52_edge_faults(spark: SparkSession, folder: str) -> DataFrame:
    e = _refs(spark, folder).select("source", "target", F.lit("CITES").alias("relation"), F.when(F.col("source") > F.col("target"), F.lit(1.0)).alias("weight"))
    return G.edge_faults(e)


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_")}
_ID = "CASE WHEN regexp_full_match(regexp_replace(regexp_replace(regexp_replace(trim(openalex_id), '/+$', ''), '^.*/', ''), '(?i)^openalex:', ''), '(?i)w\\d+') THEN upper(regexp_replace(regexp_replace(regexp_replace(trim(openalex_id), '/+$', ''), '^.*/', ''), '(?i)^openalex:', '')) END"
_DOI = "nullif(lower(regexp_replace(regexp_extract(trim(doi), '(10\\.\\d{4,9}/\\S+)', 1), '[.,;)]+$', '')), '')"
_W = f"w AS (SELECT rec_id, {_ID} AS id, title, authors, publication_year AS year, {_DOI} AS doi, venue, cited_by_count AS cited_by, referenced_works, updated_at FROM works)"
_R = _W + ", r AS (SELECT DISTINCT id AS source, target FROM (SELECT id, unnest(referenced_works) AS target FROM w) WHERE id IS NOT NULL AND target IS NOT NULL)"
_L = _R + ", l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, rec_id DESC) AS rn FROM w WHERE id IS NOT NULL) WHERE rn = 1)"
_C = _L + ", c AS (SELECT * FROM r WHERE source <> target AND source IN (SELECT id FROM l) AND target IN (SELECT id FROM l))"
_M = "m AS (SELECT 'f' || (l_partkey % 40) AS factor_name, 'g' || (l_partkey % 8) AS factor_field, l_suppkey AS code, l_linenumber AS horizon, l_orderkey AS seq, (l_discount - CAST(0.05 AS DOUBLE)) + (l_extendedprice % 7) / 1000 AS daily_ic, CASE WHEN l_quantity > 3 THEN (l_tax - CAST(0.04 AS DOUBLE)) + (l_extendedprice % 11) / 1000 END AS daily_rankic, (l_extendedprice % 13) / 1000 - CAST(0.006 AS DOUBLE) AS qspread_mean, CAST(l_quantity AS BIGINT) AS n_obs FROM lineitem)"
_MOST = "(SELECT target FROM (SELECT target, count(*) AS n FROM r GROUP BY target) ORDER BY n DESC, target DESC LIMIT 1)"
_TK = "regexp_replace(regexp_replace(regexp_replace(replace(replace(lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))), '&lt;', '<'), '&amp;', '&'), '\\([^)]*\\)|\\[[^\\]]*\\]|（[^）]*）|【[^】]*】', '', 'g'), '[\\s\\-_–—]+', '', 'g'), '[^0-9a-z\\x{4e00}-\\x{9fff}]+', '', 'g')"
_SUM = ", ".join(f"{p} AS {n}" for v in (0.0, 0.01, 0.02, 0.03) for tag, x in (("", "daily_ic"), ("abs_", "abs(daily_ic)")) for k in (f"{tag}daily_ic_gt_{str(v).replace('.', '')}",) for p, n in ((f"count(*) FILTER ({x} > {v})", f"{k}_count"), (f"round(count(*) FILTER ({x} > {v}) / CAST(count({x}) AS DOUBLE), 6)", f"{k}_ratio")))
_A4 = f"s AS (SELECT factor_name, round(avg(daily_ic), 6) AS mean_daily_ic, round(avg(daily_rankic), 6) AS mean_daily_rankic, round(avg(qspread_mean), 6) AS mean_qspread, {_SUM}, CAST(sum(n_obs) AS BIGINT) AS total_obs, count(*) AS row_count FROM m GROUP BY factor_name)"
_SETS = lambda s, t: f"(SELECT a.{s} AS a, b.{s} AS b, count(*) / sqrt(max(na) * max(nb)) AS score FROM (SELECT *, count(*) OVER (PARTITION BY {s}) AS na FROM r) a JOIN (SELECT *, count(*) OVER (PARTITION BY {s}) AS nb FROM r) b ON a.{t} = b.{t} AND a.{s} < b.{s} GROUP BY ALL)"
_TOP = lambda rel, k, cols: f"(SELECT DISTINCT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, v DESC) AS rk FROM (SELECT *, a AS u, b AS v FROM {rel} UNION ALL SELECT *, b AS u, a AS v FROM {rel})) WHERE rk <= {k})"
_AUTH = "au AS (SELECT DISTINCT id, lower(trim(unnest(authors))) AS k FROM l), ae AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM au x JOIN au y ON x.k = y.k AND x.id < y.id WHERE x.k <> '' GROUP BY ALL ORDER BY shared DESC, a, b LIMIT (SELECT 4 * count(*) FROM l))"
ORACLE = {
    "j1_outbound": f"WITH {_L}, s AS (SELECT id FROM l WHERE id IN (SELECT source FROM r WHERE target IN (SELECT id FROM l)) ORDER BY cited_by DESC NULLS LAST, id DESC LIMIT 1) SELECT id, year, cited_by FROM l WHERE id IN (SELECT target FROM r WHERE source IN (SELECT id FROM s)) ORDER BY cited_by DESC NULLS LAST, year DESC NULLS LAST, id LIMIT 20",
    "j2_j3_inbound": f"WITH {_L} SELECT id, year, cited_by FROM l WHERE id IN (SELECT source FROM r WHERE target = {_MOST})",
    "j4_j5_left": f"WITH {_M}, x AS (SELECT factor_name, arg_max(ROW(daily_ic, n_obs), ROW(seq, code, horizon, daily_ic)) AS m FROM m GROUP BY 1), y AS (SELECT factor_field, avg(daily_ic) AS field_ic FROM m GROUP BY 1), c AS (SELECT 'f' || i AS factor_name, 'g' || (i % 8) AS factor_field FROM range(48) t(i)) SELECT factor_name, round(m[1], 6) AS daily_ic, m[2] AS n_obs, round(field_ic, 6) AS field_ic FROM c LEFT JOIN x USING (factor_name) LEFT JOIN y USING (factor_field)",
    "j6_lineage_delta": "WITH b AS (SELECT *, first_value(rec_id) OVER w AS b, first_value(daily_rankic) OVER w AS v FROM feedback_memory WHERE factor_id IS NOT NULL WINDOW w AS (PARTITION BY factor_id ORDER BY rec_id)) SELECT rec_id, b AS baseline, round(daily_rankic - v, 6) AS delta, daily_rankic - v > 0 AS improved FROM b WHERE rec_id > b",
    "a22_improvement_rate": "WITH b AS (SELECT *, first_value(rec_id) OVER w AS b, first_value(daily_rankic) OVER w AS v FROM feedback_memory WHERE factor_id IS NOT NULL WINDOW w AS (PARTITION BY factor_id ORDER BY rec_id)) SELECT count(*) AS n, round(avg(CAST(daily_rankic - v > 0 AS INTEGER)), 6) AS rate FROM b WHERE rec_id > b",
    "j7_j9_group_join": "WITH n AS (SELECT id, min(rec_id) AS rec_id FROM graph_nodes WHERE id IS NOT NULL GROUP BY 1), e AS (SELECT paper_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(section) FILTER (section IS NOT NULL))), '|') AS s FROM evidence WHERE paper_id IS NOT NULL GROUP BY 1) SELECT rec_id, id, coalesce(n, 0) AS n_quotes, coalesce(s, '') AS sections FROM n LEFT JOIN e ON paper_id = id",
    "j10_r3_embedding_top_k": f"WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.e, y.e) AS score FROM v x JOIN v y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.3) SELECT a, b, round(score, 5) AS score FROM {_TOP('p', 5, 'a, b, score')}",
    "j11_r4_citation_top_k": f"WITH {_R}, cp AS (SELECT * FROM {_SETS('source', 'target')} WHERE score >= 0.05), cc AS (SELECT * FROM {_SETS('target', 'source')} WHERE score >= 0.05), x AS (SELECT coalesce(cp.a, cc.a) AS a, coalesce(cp.b, cc.b) AS b, coalesce(cp.score, 0) AS coupling, coalesce(cc.score, 0) AS cocitation, round((coalesce(cp.score, 0) + coalesce(cc.score, 0)) / 2, 9) AS score FROM cp FULL JOIN cc ON cp.a = cc.a AND cp.b = cc.b), y AS (SELECT * FROM x WHERE score >= 0.05) SELECT a, b, round(coupling, 6) AS coupling, round(cocitation, 6) AS cocitation, round(score, 6) AS score FROM {_TOP('y', 4, 'a, b, coupling, cocitation, score')}",
    "j12_r5_author_edges": f"WITH {_L}, {_AUTH} SELECT * FROM ae",
    "j13_keyword_edges": "WITH k AS (SELECT DISTINCT c_custkey AS id, o_orderpriority || c_nationkey || c_mktsegment AS k FROM orders JOIN customer ON o_custkey = c_custkey) SELECT x.id AS a, y.id AS b, count(*) AS shared FROM k x JOIN k y ON x.k = y.k AND x.id < y.id GROUP BY ALL HAVING count(*) >= 3",
    "j14_citations": f"WITH {_L} SELECT source, target FROM r WHERE source <> target AND source IN (SELECT id FROM l WHERE year >= 2015) AND target IN (SELECT id FROM l WHERE year >= 2015)",
    "j16_j17_ego": f"WITH {_C}, b AS (SELECT source, target FROM c UNION SELECT target, source FROM c), s AS (SELECT source FROM (SELECT source, count(*) AS n FROM b GROUP BY 1) ORDER BY n DESC, source DESC LIMIT 1), i AS (SELECT * FROM (SELECT target AS id FROM b WHERE source IN (SELECT * FROM s) ORDER BY 1 LIMIT 30) UNION SELECT * FROM s) SELECT source, target FROM c WHERE source IN (SELECT id FROM i) AND target IN (SELECT id FROM i)",
    "j18_u1_except": "SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS n_except, (SELECT count(DISTINCT c_custkey) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS n_anti",
    "j19_lineage": "WITH p AS (SELECT n_nationkey AS n, n_regionkey AS r FROM nation) SELECT 'n' || n AS start, 'n' || n AS id, 0 AS step, CAST(NULL AS INTEGER) AS delta FROM p UNION ALL SELECT 'n' || n, 'r' || r, 1, r - n FROM p UNION ALL SELECT 'n' || n, 'root', 2, 0 - r FROM p",
    "j20_cociters": f"WITH {_R} SELECT target AS id, count(*) AS n FROM r WHERE source IN (SELECT source FROM r WHERE target = {_MOST}) AND target <> {_MOST} GROUP BY 1",
    "j21_j22_gap": "WITH f AS (SELECT rec_id, batch_no, factor_id, unnest(mechanism_tags) AS tag, generate_subscripts(mechanism_tags, 1) - 1 AS i FROM feedback_memory) SELECT rec_id, CAST(i AS INTEGER) AS i, tag FROM f WHERE batch_no > 0 AND NOT EXISTS (SELECT 1 FROM f g WHERE g.batch_no = 0 AND g.factor_id = f.factor_id AND g.i = f.i)",
    "a1_a2_counts": f"WITH {_W} SELECT count(*) AS n, count(*) FILTER (year >= 2016) AS n_recent, count(DISTINCT id) AS n_ids FROM w",
    "a3_a4_summary": f"WITH {_M}, {_A4} SELECT * FROM s",
    "a5_a6_by_field": f"WITH {_M}, z AS (SELECT *, coalesce(daily_rankic, 0) AS x FROM m) SELECT factor_field, horizon, round(avg(x), 9) AS mean_daily_rankic, count(*) FILTER (x > 0.0015) AS daily_rankic_gt_00015_count, round(count(*) FILTER (abs(x) > 0.002) / CAST(count(*) AS DOUBLE), 9) AS abs_daily_rankic_gt_0002_ratio, CAST(sum(n_obs) AS BIGINT) AS total_obs, count(*) AS row_count FROM z GROUP BY ALL",
    "a9_transitions": "WITH x AS (SELECT *, lag(role) OVER (PARTITION BY id ORDER BY rec_id) AS before FROM graph_nodes WHERE id IS NOT NULL) SELECT before || '->' || coalesce(role, '?') AS transition, year, count(*) AS n FROM x WHERE before IS NOT NULL GROUP BY ALL",
    "a10_confusion": "SELECT CASE WHEN daily_rankic > 0 THEN 'positive' WHEN daily_rankic <= 0 THEN 'negative' ELSE 'pending' END AS auto, coalesce(direction, 'unknown') AS human, count(*) AS n FROM feedback_memory GROUP BY ALL",
    "a11_examples": "WITH x AS (SELECT rec_id, coalesce(source, '?') AS source FROM graph_nodes), y AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY rec_id) AS INTEGER) AS rank, count(*) OVER (PARTITION BY source) AS n FROM x) SELECT source, rec_id, rank, n FROM y WHERE rank <= 5",
    "a12_degrees": f"WITH {_C}, e AS (SELECT source AS node FROM c UNION ALL SELECT target FROM c), d AS (SELECT node, count(*) AS edge_count, CAST(count(*) AS DOUBLE) AS weighted_degree FROM e GROUP BY 1) SELECT *, round(weighted_degree / (SELECT max(weighted_degree) FROM d), 6) AS importance FROM d",
    "a13_memberships": "WITH g AS (SELECT id, source, max(coalesce(global_impact, 0)) AS i FROM graph_nodes WHERE id IS NOT NULL AND source IS NOT NULL GROUP BY ALL) SELECT id, array_to_string(list_sort(list(source)), '|') AS sources, count(*) AS n, round(max(i), 6) AS highest, arg_max(source, ROW(i, source)) AS main FROM g GROUP BY 1",
    "a14_a15_consolidated": "WITH f AS (SELECT *, coalesce(direction, 'unknown') AS d FROM feedback_memory WHERE prefix_expression IS NOT NULL) SELECT md5(prefix_expression) AS k, d, count(*) AS occurrence_count, array_to_string(list_sort(list(DISTINCT rec_id)), ',') AS ids, array_to_string(list_sort(list_distinct(flatten(list(coalesce(mechanism_tags, []))))), '|') AS tags, arg_min(reason, rec_id) FILTER (trim(reason) <> '') AS reason, epoch_us(min(created_at)) AS first_us, epoch_us(max(created_at)) AS last_us FROM f GROUP BY prefix_expression, d",
    "a16_arms": "SELECT coalesce(direction, 'unknown') AS arm, count(*) AS n_trials, round(avg(daily_rankic), 9) AS mean_reward, count(*) FILTER (daily_rankic > 0) AS n_success, count(*) FILTER (NOT coalesce(daily_rankic, 0) > 0) AS n_failure, arg_max(daily_rankic, rec_id) FILTER (daily_rankic IS NOT NULL) AS last_reward FROM feedback_memory GROUP BY 1",
    "a17_tfidf": "WITH n AS (SELECT source, unnest(list_distinct(regexp_extract_all(lower(title), '[a-z]{4,}'))) AS t FROM graph_nodes WHERE source IS NOT NULL), tf AS (SELECT source, t, count(*) AS n FROM n GROUP BY ALL), x AS (SELECT *, count(*) OVER (PARTITION BY t) AS df, (SELECT count(DISTINCT source) FROM tf) AS total FROM tf), y AS (SELECT source, t, round(n * (ln((1 + total) / CAST(1 + df AS DOUBLE)) + 1), 6) AS w FROM x) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY w DESC, t) AS INTEGER) AS rank FROM y) WHERE rank <= 4",
    "a18_a19_overlap": "WITH g AS (SELECT id, count(DISTINCT source) AS m FROM graph_nodes WHERE id IS NOT NULL AND source IS NOT NULL GROUP BY 1) SELECT CASE WHEN m = (SELECT count(DISTINCT source) FROM graph_nodes WHERE id IS NOT NULL) THEN 'all' WHEN m > 1 THEN 'bridge' ELSE 'one' END AS kind, count(*) AS n FROM g GROUP BY 1",
    "a20_a21_verdicts": "SELECT factor_id, coalesce(bool_and(daily_rankic > 0), false) AS all_up, coalesce(bool_or(daily_rankic > 0), false) AS any_up, count(*) - 1 AS copies FROM feedback_memory WHERE factor_id IS NOT NULL GROUP BY 1",
    "a23_a26_dashboard": f"WITH {_M}, b AS (SELECT factor_name, code, arg_max(daily_ic, ROW(daily_ic, seq, horizon)) AS ic FROM m GROUP BY ALL) SELECT CAST(floor(round(abs(ic) * 100, 6)) AS BIGINT) AS bucket, count(*) AS n, count(*) FILTER (ic > 0) AS n_positive FROM b GROUP BY 1",
    "a24_a27_queue": "SELECT coalesce(reason, '?') AS reason, count(*) AS n, min(rec_id) AS first FROM feedback_memory GROUP BY 1",
    "a25_percentiles": "WITH x AS (SELECT event_type, list_sort(list(value) FILTER (value IS NOT NULL)) AS v FROM events GROUP BY 1) SELECT event_type, " + ", ".join(f"v[CAST(least(floor(len(v) * {p} / 100), len(v) - 1) AS BIGINT) + 1] AS p{p}" for p in (50, 90, 99)) + " FROM x",
    "a28_store_size": "SELECT count(*) AS n, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS chars, count(*) >= 8 OR sum(coalesce(length(text), 0)) >= 24000 AS consolidate FROM documents",
    "r1_search_title": f"WITH {_W} SELECT rec_id, title, year, cited_by FROM w WHERE title ILIKE '%order%' AND year >= 2010 ORDER BY cited_by DESC NULLS LAST, year DESC NULLS LAST, rec_id LIMIT 25",
    "r2_lookup": f"WITH {_W} SELECT rec_id, id, title FROM w WHERE rec_id = 7 LIMIT 1",
    "r8_semantic": "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query, x.vec_id, round(list_cosine_similarity(x.e, q.e), 6) AS score FROM v x, v q WHERE q.vec_id % 100 = 0 AND x.vec_id <> q.vec_id) SELECT query, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS r FROM s WHERE score >= 0.2) WHERE r <= 20",
    "r13_r16_seeds": f"WITH n AS (SELECT rec_id, {_TK} AS k, coalesce(is_seed, false) AS seed, coalesce(global_impact, 0) AS impact FROM graph_nodes WHERE title IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seed DESC, impact DESC, rec_id DESC) AS r FROM n) SELECT rec_id, seed, CAST(row_number() OVER (ORDER BY seed DESC, impact DESC, rec_id) AS INTEGER) AS rank FROM o WHERE r = 1 ORDER BY rank LIMIT 30",
    "r14_capped": f"WITH {_M}, x AS (SELECT factor_name, code, seq, horizon, round(daily_ic, 9) AS ic FROM m) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY factor_name ORDER BY ic DESC, seq, horizon, code) AS INTEGER) AS rank FROM x) WHERE rank <= 3",
    "r17_r18_labels": f"WITH {_M}, {_A4}, v AS (SELECT factor_name, CAST(mean_daily_ic > 0.002 AS INTEGER) + CAST(daily_ic_gt_00_ratio > 0.5 AS INTEGER) + CAST(abs_daily_ic_gt_003_ratio > 0.3 AS INTEGER) + CAST(mean_qspread > 0 AS INTEGER) AS votes FROM s) SELECT *, CASE WHEN votes >= 4 THEN 'strong' WHEN votes = 3 THEN 'good' WHEN votes = 2 THEN 'watch' ELSE 'weak' END AS label FROM v",
    "r19_best_variant": f"WITH {_M} SELECT factor_field, b[1] AS factor_name, b[2] AS seq, b[3] AS horizon FROM (SELECT factor_field, arg_max(ROW(factor_name, seq, horizon), ROW(daily_ic, seq, horizon, code)) AS b FROM m GROUP BY 1)",
    "r24_r26_order": "SELECT rec_id, CAST(greatest(coalesce(len(mechanism_tags), 0), 0) AS INTEGER) AS n_tags, CAST(length(coalesce(reason, '')) AS INTEGER) AS n_reason FROM feedback_memory ORDER BY n_tags DESC, n_reason DESC, rec_id LIMIT 50",
    "r25_find": "WITH f AS (SELECT rec_id, lower(coalesce(reason, '') || coalesce(label, '') || array_to_string(coalesce(mechanism_tags, []), ' ')) AS t FROM feedback_memory) SELECT rec_id FROM f WHERE contains(t, 'liquidity') AND contains(t, 'flow') ORDER BY rec_id LIMIT 30",
    "u2_u3_union_first": f"WITH u AS (SELECT 0 AS src, rec_id, title, NULL AS category FROM works UNION ALL SELECT 1, rec_id, title, category FROM preprints), k AS (SELECT *, {_TK} AS k FROM u) SELECT src, rec_id, k, category FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY src, rec_id) AS rn FROM k) WHERE rn = 1 OR k IS NULL",
    "u4_u12_library": "SELECT rec_id, CASE WHEN canonical_factor_key IN (SELECT canonical_factor_key FROM feedback_memory WHERE batch_no = 0 AND canonical_factor_key IS NOT NULL) THEN 'known' ELSE 'new' END AS state FROM feedback_memory WHERE batch_no > 0 AND canonical_factor_key IS NOT NULL",
    "u5_edges": "SELECT evidence_id, min(rec_id) AS first, max(rec_id) AS last FROM evidence WHERE evidence_id IS NOT NULL GROUP BY 1",
    "u6_u9_merge": f"WITH {_W} SELECT id, arg_max(year, ROW(updated_at, rec_id)) FILTER (year IS NOT NULL) AS year, arg_max(venue, ROW(updated_at, rec_id)) FILTER (trim(venue) <> '') AS venue, array_to_string(list_sort(list_distinct(flatten(list(coalesce(authors, []))))), '|') AS authors, count(*) AS n_rows FROM w WHERE id IS NOT NULL GROUP BY id",
    "u8_u13_richest": "SELECT id, rec_id, rich, cites FROM (SELECT id, rec_id, CAST(length(coalesce(abstract, '')) AS INTEGER) AS rich, coalesce(citation_count, 0) AS cites, row_number() OVER (PARTITION BY id ORDER BY length(coalesce(abstract, '')) DESC, coalesce(citation_count, 0) DESC, rec_id) AS rn FROM graph_nodes WHERE id IS NOT NULL) WHERE rn = 1",
    "u10_u11_match": f"WITH {_W}, k AS (SELECT *, {_TK} AS k FROM w WHERE id IS NOT NULL) SELECT x.rec_id AS r, y.rec_id AS s FROM k x JOIN k y ON x.doi = y.doi AND x.rec_id < y.rec_id UNION SELECT x.rec_id, y.rec_id FROM k x JOIN k y ON x.k = y.k AND x.rec_id < y.rec_id WHERE x.k <> '' AND list_has_any(x.authors, y.authors)",
    "u15_update": "SELECT rec_id, CASE WHEN rec_id % 3 = 0 THEN 3 ELSE 1 END AS usage_count FROM feedback_memory",
    "g1_u7_identity": f"WITH RECURSIVE {_W}, reach AS (SELECT rec_id AS a, rec_id AS b FROM w UNION SELECT r.a, y.rec_id FROM reach r JOIN w x ON x.rec_id = r.b JOIN w y ON x.id = y.id OR x.doi = y.doi), g AS (SELECT a, min(b) AS g FROM reach GROUP BY 1), m AS (SELECT g, count(*) AS n, arg_max(rec_id, ROW(coalesce(cited_by, 0), rec_id)) AS rep, concat_ws(',', CASE WHEN count(doi) > count(DISTINCT doi) THEN 'doi' END, CASE WHEN count(id) > count(DISTINCT id) THEN 'openalex' END) AS methods FROM g JOIN w ON rec_id = a GROUP BY g) SELECT a AS rec_id, n AS group_size, rep AS representative, methods FROM g JOIN m USING (g)",
    "g2_layers": f"WITH {_C}, {_AUTH}, sp AS (SELECT * FROM {_SETS('source', 'target')} WHERE score >= 0.2 - 1e-12) SELECT source, target, 'CITES' AS relation, CAST(1 AS DOUBLE) AS weight FROM c UNION ALL SELECT a, b, 'CITATION_SIMILAR_TO', round(score, 6) FROM {_TOP('sp', 5, 'a, b, score')} UNION ALL SELECT a, b, 'AUTHOR_SHARED_BY', CAST(shared AS DOUBLE) FROM ae",
    "g3_paths": f"WITH {_C}, e AS (SELECT DISTINCT c.target AS u, c.source AS v FROM c JOIN l a ON a.id = c.target JOIN l b ON b.id = c.source WHERE coalesce(b.year >= a.year, true)), p1 AS (SELECT [id, v] AS p FROM l JOIN e ON u = id WHERE year < 2008 AND v <> id), p2 AS (SELECT list_append(p, v) AS p FROM p1 JOIN e ON u = p[2] WHERE NOT list_contains(p, v) AND p[2] NOT IN (SELECT id FROM l WHERE year > 2024)), p3 AS (SELECT list_append(p, v) AS p FROM p2 JOIN e ON u = p[3] WHERE NOT list_contains(p, v) AND p[3] NOT IN (SELECT id FROM l WHERE year > 2024)), a AS (SELECT p, len(p) - 1 AS hops FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) WHERE p[-1] IN (SELECT id FROM l WHERE year > 2024)), i AS (SELECT p, hops, sum(ln(1 + greatest(coalesce(cited_by, 0), 0))) AS impact FROM (SELECT p, hops, unnest(p) AS id FROM a) JOIN l USING (id) GROUP BY ALL) SELECT array_to_string(p, '>') AS pid, CAST(hops AS INTEGER) AS hops, round(impact, 6) AS impact, round(impact / (hops + 1) + 1 / CAST(hops AS DOUBLE), 6) AS score FROM i",
    "g5_roles": f"WITH {_C}, s AS (SELECT id FROM l ORDER BY cited_by DESC NULLS LAST, id LIMIT 10) SELECT id, CASE WHEN id IN (SELECT id FROM s) THEN 'seed' WHEN id IN (SELECT source FROM c WHERE target IN (SELECT id FROM s)) THEN 'derivative' WHEN id IN (SELECT target FROM c WHERE source IN (SELECT id FROM s)) THEN 'prior' ELSE 'related' END AS role FROM l",
    "g6_g7_finalised": f"WITH {_L}, t AS (SELECT id FROM l ORDER BY coalesce(year = 2015, false) DESC, coalesce(cited_by, 0) DESC, id LIMIT 200) SELECT source, target FROM r WHERE source <> target AND source IN (SELECT id FROM t) AND target IN (SELECT id FROM t)",
    "g12_sample": "SELECT * FROM (SELECT rec_id, coalesce(source, '?') AS source, coalesce(role, '?') AS role, CAST(row_number() OVER (PARTITION BY coalesce(source, '?'), coalesce(role, '?') ORDER BY sha256('seed-1:' || rec_id)) AS INTEGER) AS rank FROM graph_nodes) WHERE rank <= 3",
    "g13_g14_lineage_state": "WITH f AS (SELECT factor_id, batch_no, max(daily_rankic) AS best FROM feedback_memory WHERE factor_id IS NOT NULL GROUP BY ALL), x AS (SELECT *, coalesce(best > max(best) OVER (PARTITION BY factor_id ORDER BY batch_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS up FROM f), y AS (SELECT *, sum(CAST(up AS INTEGER)) OVER (PARTITION BY factor_id ORDER BY batch_no) AS block FROM x), z AS (SELECT *, CAST(row_number() OVER (PARTITION BY factor_id, block ORDER BY batch_no) - 1 AS INTEGER) AS idle FROM y) SELECT factor_id, batch_no, best, idle, idle >= 3 AS stop FROM z",
    "t52_edge_faults": f"WITH {_R} SELECT source, target, 'CITES' AS relation, unnest(list_filter([CASE WHEN source = target THEN 'self loop' END, CASE WHEN source <= target THEN 'missing weight' END], lambda x: x IS NOT NULL)) AS fault FROM r",
}
