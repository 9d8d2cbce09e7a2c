"""Queries of text and identifier functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.functions import ids as I
from tickweave.functions import text as X
from tickweave.operators.fuzzy import fuzzy_pairs
from tickweave.operators.plugins import encoded
from tickweave.runtime import table, written

PHRASES = ("order flow", "order book", "limit order", "price impact", "queue positions", "fill rates", "volume shocks", "market depth", "noise trading", "hawkes kernels", "alpha decay")
ALIASES = {"limit order": "order book", "order book": "order book", "order flow": "order flow", "signed volume": "order flow", "market depth": "liquidity", "fill rates": "liquidity"}
STOP = ("the", "and", "for", "from", "with", "across", "nature", "structure")
TOPICS = {"liquidity": ("market depth", "fill rates", "spread"), "flow": ("order flow", "volume"), "signals": ("alpha", "momentum", "reversal")}


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "graph_nodes").select("rec_id", "id", "title", "abstract", "year", "authors", "metadata", "added_at", "source", "citation_count")


def _works(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "works").select("rec_id", "openalex_id", "title", "doi", "publication_year", "authors")


def _phrases(nodes: DataFrame, title: Column, abstract: Column) -> DataFrame:
    t, a = X.match_text(title), X.match_text(abstract)
    found, score = X.weighted_hits({"title": (F.col("t"), 4), "abstract": (F.coalesce("a", F.lit("")), 1)}, PHRASES)
    al = X.aliases(F.col("t"), ALIASES)
    return nodes.select("rec_id", t.alias("t"), a.alias("a")).select("rec_id", F.col("t").alias("normal"), F.array_join(found["title"], "|").alias("title_hits"), F.array_join(found["abstract"], "|").alias("abstract_hits"), F.array_join(al["canonical"], "|").alias("canonical"), score.cast("long").alias("score"))


def t1_t7_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """Normal form, phrases per field, aliases and weighted score of each node; a missing text is an empty one."""
    return _phrases(_nodes(spark, folder), F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))


def _decisions(phrases: DataFrame) -> DataFrame:
    profiles = {"loose": 1, "strict": 3}
    x = phrases.withColumn("n", F.size(F.split("title_hits", r"\|")))
    one = lambda least: X.decision_list([(F.col("title_hits") == "", "rejected", "no_phrase"), (F.col("score") >= 4 * least, "accepted", "score"), (F.col("score") > 0, "review", "weak")], ("rejected", "other"))
    before, after = (one(profiles[p]) for p in ("loose", "strict"))
    return x.select("rec_id", before["status"].alias("previous_status"), after["status"].alias("status"), after["reason"].alias("reason"))


def t8_t12_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """A decision list over the phrase score of each node, the profile chosen by name, and the status before and after."""
    return _decisions(t1_t7_phrases(spark, folder))


def t13_t16_t50_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Word-bounded terms, a regex class and a gate of the documents."""
    d = table(spark, folder, "documents").select("doc_id", "text")
    strong, weak = ("order book", "price impact", "microprice"), ("volume", "spread", "ticks")
    s, w = X.word_hits(F.col("text"), strong), X.word_hits(F.col("text"), weak)
    kind = X.regex_class(F.col("text"), [(r"^\s*\[\"", "expression"), (r"\\section", "tex"), (r"(?m)^Question:", "note"), (r"(?m)^[-*•] ", "list")], "prose")
    d = d.select("doc_id", F.size(s).alias("n_strong"), F.size(w).alias("n_weak"), F.coalesce(kind, F.lit("prose")).alias("kind"))
    return d.select("*", ((F.col("n_strong") >= 1) | (F.col("n_weak") >= 2)).alias("relevant"))


def t18_topics(spark: SparkSession, folder: str) -> DataFrame:
    """Topics of each title by keyword hits, the best first, ties by name."""
    n = _nodes(spark, folder).select("rec_id", F.lower("title").alias("t")).filter("t is not null")
    scores = F.array(*(F.struct((-sum((F.contains("t", F.lit(k)).cast("int") for k in ks), F.lit(0))).alias("s"), F.lit(name).alias("topic")) for name, ks in sorted(TOPICS.items())))
    best = F.array_sort(F.filter(scores, lambda x: x.s < 0))
    return n.select("rec_id", F.posexplode(best).alias("rank", "x")).select("rec_id", F.col("rank"), "x.topic", (-F.col("x.s")).alias("score"))


def t19_t24_ids(spark: SparkSession, folder: str) -> DataFrame:
    w = _works(spark, folder)
    d, o = I.doi(F.col("doi")), I.openalex(F.col("openalex_id"))
    r = I.resolved(F.lit(None).cast("string"), d, o)
    return w.select("rec_id", d.alias("doi"), o.alias("openalex_id"), r["canonical"].alias("canonical"), r["method"].alias("method"))


def t21_arxiv(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "preprints").select("rec_id", "arxiv_id", "doi")
    first = I.first_arxiv(F.array(F.concat(F.lit("https://arxiv.org/abs/"), I.arxiv(F.col("arxiv_id"))), F.col("doi")))
    return p.select("rec_id", I.arxiv(F.col("arxiv_id")).alias("arxiv_id"), first.alias("first_arxiv"), I.canonical_id(F.col("arxiv_id"), F.col("doi"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("canonical"))


def t25_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical form of an address made from each node id, with trackers and a fragment."""
    n = _nodes(spark, folder).filter("id is not null")
    raw = F.concat(F.lit("HTTPS://Example.org/"), F.regexp_replace("id", "[^0-9A-Za-z]", ""), F.lit("/?b=2&utm_source=x&a=1&fbclid=z#frag"))
    return n.select("rec_id", I.canonical_url(raw).alias("url"))


def t26_t27_keys(spark: SparkSession, folder: str) -> DataFrame:
    w = _works(spark, folder)
    t = I.canonical_title(F.col("title"))
    keys = I.identity_keys(F.lit(None).cast("string"), I.doi(F.col("doi")), F.lit(None).cast("string"), t, F.lit(None).cast("string"))
    return w.select("rec_id", t.alias("title_key"), F.array_join(keys, ",").alias("keys"))


def t28_embedding_text(spark: SparkSession, folder: str) -> DataFrame:
    n = _nodes(spark, folder)
    e = X.embedding_text(F.col("title"), F.col("abstract"), F.col("authors"))
    return n.select("rec_id", e["text"].alias("text"), e["quality"].alias("quality"))


def t29_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Times read back from RFC 822 and ISO text, and the age and month filters at a given day."""
    n = _nodes(spark, folder).select("rec_id", F.col("added_at").cast("timestamp").alias("ts"))
    text = F.when(F.col("rec_id") % 2 == 0, F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss Z")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX"))
    back = X.timestamp_of(text)
    as_of = F.lit("2025-06-01").cast("timestamp")
    return n.select("rec_id", F.unix_timestamp(back).alias("epoch"), X.recent(back, as_of, 30).alias("recent"), X.month_window(back, F.lit("2025-05-10").cast("date")).alias("in_month"))


def t30_chunks(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_id", "text")
    return d.select("doc_id", F.posexplode(X.chunks(F.col("text"), 400)).alias("chunk_no", "chunk"))


def t31_t33_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The eight quotes of each paper with most keyword hits, ties by id, and whether their section is known."""
    from pyspark.sql import Window as W

    e = table(spark, folder, "evidence").select("rec_id", "paper_id", "quote", "section").filter("paper_id is not null and quote is not null")
    score = sum((F.contains(F.lower("quote"), F.lit(k)).cast("int") for k in ("order", "price", "volume", "spread")), F.lit(0))
    e = e.select("rec_id", "paper_id", score.cast("int").alias("score"), F.col("section").isNull().alias("section_missing"))
    return e.withColumn("rank", F.row_number().over(W.partitionBy("paper_id").orderBy(F.desc("score"), "rec_id"))).filter("rank <= 8")


def t34_t35_json(spark: SparkSession, folder: str) -> DataFrame:
    """Values of the nodes' JSON text: one by path, its kind, and all in one text."""
    n = _nodes(spark, folder)
    m = F.from_json("metadata", "map<string,string>")
    k = X.scalar_kind(F.get_json_object("metadata", "$.track"))
    values = F.array_join(F.array_sort(F.transform(F.map_values(m), lambda v: F.lower(v))), " ")
    return n.select("rec_id", F.get_json_object("metadata", "$.track").alias("track"), k["kind"].alias("kind"), values.alias("flat"))


def _tokens(nodes: DataFrame) -> DataFrame:
    return nodes.select("rec_id", F.array_join(F.array_sort(X.tokens(F.col("title"))), " ").alias("tokens"), F.array_join(X.title_tokens(F.col("title"), STOP), " ").alias("title_tokens"), X.token_estimate(F.col("title")).alias("token_estimate"))


def t36_t37_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens, title tokens and estimated number of tokens of each node; a missing title is an empty one."""
    return _tokens(_nodes(spark, folder).withColumn("title", F.coalesce("title", F.lit(""))))


def t38_hash_embedding(spark: SparkSession, folder: str) -> DataFrame:
    n = _nodes(spark, folder)
    v = I.hash_embedding(F.coalesce("title", F.lit("")), 64)
    return n.select("rec_id", F.transform(v, lambda x: F.round(x, 6)).alias("vector"))


def encoder_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of titles by an encoder that is passed in, here shares of three letters."""
    def make():
        return lambda texts: np.array([[float(t.lower().count(c)) for c in "eox"] for t in texts])

    x = encoded(_nodes(spark, folder), F.col("rec_id"), F.col("title"), make)
    return x.select(F.col("id").alias("rec_id"), *(F.round(F.get("vector", F.lit(i)), 6).alias(f"v{i}") for i in range(3)))


def t39_best_match(spark: SparkSession, folder: str) -> DataFrame:
    """Best work for each preprint title among all works, at a ratio of 0.94 or more, ties to the least. Each title is
    compared once; one that a work has literally needs no other."""
    p = table(spark, folder, "preprints").select("rec_id", F.lower("title").alias("text")).filter("text is not null")
    w = table(spark, folder, "works").select("rec_id", F.lower("title").alias("text")).filter("text is not null")
    one = lambda d: d.groupBy("text").agg(F.min("rec_id").alias("id"))
    a, b = written(one(p), "titles"), written(one(w), "titles")
    same = a.join(b.select("text", F.col("id").alias("b_id")), "text").select(F.col("id").alias("a_id"), "b_id", F.lit(1.0).alias("ratio"))
    x = same.unionByName(fuzzy_pairs(a.join(b, "text", "left_anti"), b, 0.94))
    best = x.groupBy("a_id").agg(F.max(F.struct("ratio", (-F.col("b_id")).alias("w"))).alias("b"))
    return p.join(a.withColumnRenamed("id", "a_id"), "text").join(best, "a_id").select("rec_id", (-F.col("b.w")).alias("work_rec"), F.round("b.ratio", 6).alias("ratio"))


def t40_t49_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Coefficient buckets, a verdict rule, missing-field reasons, positive means and a capped score of the feedback."""
    f = table(spark, folder, "feedback_memory").select("rec_id", "daily_rankic", "direction", "reason", "mechanism_tags", "label")
    faults = X.reasons({"no_reason": F.coalesce(F.trim("reason"), F.lit("")) == "", "no_tags": F.coalesce(F.size("mechanism_tags"), F.lit(0)) <= 0, "no_direction": F.coalesce("direction", F.lit("unknown")) == "unknown"})
    n_tags = F.greatest(F.coalesce(F.size("mechanism_tags"), F.lit(0)), F.lit(0))
    return f.select(
        "rec_id", X.ic_bucket(F.col("daily_rankic")).alias("bucket"), X.accepted(F.col("daily_rankic"), "daily_rankic >= 0.02").alias("verdict"), F.array_join(faults, ",").alias("faults"),
        X.positive_mean(F.array(F.col("daily_rankic") * 100, n_tags.cast("double")), F.lit(0.5)).alias("gate"), F.least(F.lit(10), 3 * n_tags).cast("int").alias("capped"), F.coalesce(X.record_filter(F.col("label"), ["positive", "warning"]), F.lit(False)).alias("stored"),
    )


def s10_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Sections and formulas of TeX documents."""
    d = table(spark, folder, "documents").filter(F.contains("text", F.lit("\\section{"))).select("doc_id", "text")
    return d.select("doc_id", F.size(X.formulas(F.col("text"))).alias("n_formulas"), F.explode(X.latex_sections(F.col("text"))).alias("s")).select("doc_id", "n_formulas", F.col("s.title").alias("title"), F.length("s.text").alias("n_chars"))


# Folding in SQL: canonical forms, wide letters and lower case, which for the texts of these tables is all there is to fold.
_WIDE = "".join(chr(0xFEE0 + i) for i in range(33, 127) if i != 39)
_norm = lambda c: f"trim(regexp_replace(regexp_replace(lower(translate(nfc_normalize(coalesce({c}, '')), '{_WIDE}', '{_WIDE.translate({0xFEE0 + i: i for i in range(33, 127)})}')), '[_\\x{{2010}}\\x{{2011}}\\x{{2013}}\\x{{2014}}-]+', ' ', 'g'), '[^\\pL\\pN]+', ' ', 'g'))"
_hits = lambda c: "list_sort(list_filter([" + ", ".join(f"CASE WHEN contains(' ' || {c} || ' ', ' {p} ') THEN '{p}' END" for p in PHRASES) + "], lambda x: x IS NOT NULL))"
_canon = "list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN contains(' ' || t || ' ', ' {a} ') THEN '{c}' END" for a, c in ALIASES.items()) + "], lambda x: x IS NOT NULL)))"
_P = f"p AS (SELECT rec_id, {_norm('title')} AS t, {_norm('abstract')} AS a FROM graph_nodes), h AS (SELECT rec_id, t AS normal, {_hits('t')} AS th, {_hits('a')} AS ah, {_canon} AS ca FROM p)"
_lower_words = lambda t: f"regexp_matches(lower(text), '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
_DOI_SQL = "nullif(lower(regexp_replace(regexp_extract(trim(doi), '(10\\.\\d{4,9}/\\S+)', 1), '[.,;)]+$', '')), '')"
_OA = "regexp_replace(regexp_replace(regexp_replace(trim(openalex_id), '/+$', ''), '^.*/', ''), '(?i)^openalex:', '')"
_OA_SQL = f"CASE WHEN regexp_full_match({_OA}, '(?i)w\\d+') THEN upper({_OA}) END"
_TITLE_SQL = "regexp_replace(regexp_replace(regexp_replace(replace(replace(lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))), '&lt;', '<'), '&amp;', '&'), '\\([^)]*\\)|\\[[^\\]]*\\]|（[^）]*）|【[^】]*】', '', 'g'), '[\\s\\-_–—]+', '', 'g'), '[^0-9a-z\\x{4e00}-\\x{9fff}]+', '', 'g')"
_sq = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '[\\s\\x{{a0}}\\x{{3000}}]+', ' ', 'g'))"
_tags = "greatest(coalesce(len(mechanism_tags), 0), 0)"
ORACLE = {
    "t1_t7_phrases": f"WITH {_P} SELECT rec_id, normal, array_to_string(th, '|') AS title_hits, array_to_string(ah, '|') AS abstract_hits, array_to_string(ca, '|') AS canonical, CAST(4 * len(th) + len(ah) AS BIGINT) AS score FROM h",
    "t8_t12_decisions": f"WITH {_P}, s AS (SELECT rec_id, len(th) AS n, 4 * len(th) + len(ah) AS score FROM h) SELECT rec_id, CASE WHEN n = 0 THEN 'rejected' WHEN score >= 4 THEN 'accepted' ELSE 'review' END AS previous_status, CASE WHEN n = 0 THEN 'rejected' WHEN score >= 12 THEN 'accepted' ELSE 'review' END AS status, CASE WHEN n = 0 THEN 'no_phrase' WHEN score >= 12 THEN 'score' ELSE 'weak' END AS reason FROM s",
    "t13_t16_t50_terms": "WITH x AS (SELECT doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE " + " + ".join(f"CAST({_lower_words(t)} AS INTEGER)" for t in ("order book", "price impact", "microprice")) + " END AS INTEGER) AS n_strong, CAST(CASE WHEN text IS NULL THEN 0 ELSE " + " + ".join(f"CAST({_lower_words(t)} AS INTEGER)" for t in ("volume", "spread", "ticks")) + " END AS INTEGER) AS n_weak, CASE WHEN regexp_matches(text, '^\\s*\\[\"') THEN 'expression' WHEN contains(text, '\\section') THEN 'tex' WHEN regexp_matches(text, '(?m)^Question:') THEN 'note' WHEN regexp_matches(text, '(?m)^[-*•] ') THEN 'list' ELSE 'prose' END AS kind FROM documents) SELECT *, n_strong >= 1 OR n_weak >= 2 AS relevant FROM x",
    "t18_topics": "WITH s AS (" + " UNION ALL ".join(f"SELECT rec_id, '{n}' AS topic, " + " + ".join(f"CAST(contains(lower(title), '{k}') AS INTEGER)" for k in ks) + " AS score FROM graph_nodes WHERE title IS NOT NULL" for n, ks in TOPICS.items()) + ") SELECT rec_id, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY score DESC, topic) - 1 AS INTEGER) AS rank, topic, CAST(score AS INTEGER) AS score FROM s WHERE score > 0",
    "t19_t24_ids": f"WITH x AS (SELECT rec_id, {_DOI_SQL} AS doi, {_OA_SQL} AS openalex_id FROM works) SELECT *, CASE WHEN doi IS NOT NULL THEN 'doi:' || doi ELSE 'openalex:' || openalex_id END AS canonical, CASE WHEN doi IS NOT NULL THEN 'doi' WHEN openalex_id IS NOT NULL THEN 'openalex' END AS method FROM x",
    "t21_arxiv": "WITH x AS (SELECT rec_id, nullif(regexp_replace(trim(regexp_replace(trim(arxiv_id), '(?i)^arxiv:\\s*', '')), '(?i)v\\d+$', ''), '') AS arxiv_id FROM preprints) SELECT rec_id, arxiv_id, regexp_extract(arxiv_id, '(\\d{4}\\.\\d{4,5})', 1) AS first_arxiv, 'arxiv:' || arxiv_id AS canonical FROM x",
    "t25_urls": "SELECT rec_id, lower('https://example.org' || CASE WHEN regexp_replace(id, '[^0-9A-Za-z]', '', 'g') = '' THEN '' ELSE '/' || regexp_replace(id, '[^0-9A-Za-z]', '', 'g') END || '?b=2&a=1') AS url FROM graph_nodes WHERE id IS NOT NULL",
    "t26_t27_keys": f"WITH x AS (SELECT rec_id, {_TITLE_SQL} AS title_key, {_DOI_SQL} AS doi FROM works) SELECT rec_id, title_key, concat_ws(',', sha256('doi:' || doi), sha256('title:' || nullif(title_key, ''))) AS keys FROM x",
    "t28_embedding_text": f"WITH x AS (SELECT rec_id, {_sq('title')} AS t, {_sq('abstract')} AS a, list_filter(list_transform(coalesce(authors, []), lambda v: trim(regexp_replace(coalesce(v, ''), '\\s+', ' ', 'g'))), lambda v: v <> '') AS k FROM graph_nodes), y AS (SELECT *, list_filter(k, lambda v, i: list_position(list_transform(k, lambda u: lower(u)), lower(v)) = i) AS d FROM x) SELECT rec_id, concat_ws(chr(10), CASE WHEN t <> '' THEN 'Title: ' || t END, CASE WHEN a <> '' THEN 'Abstract: ' || a END, CASE WHEN len(d) > 0 THEN 'Keywords: ' || array_to_string(d, '; ') END) AS text, CASE WHEN t <> '' AND (a <> '' OR len(d) > 0) THEN 'A' WHEN t <> '' THEN 'B' ELSE 'C' END AS quality FROM y",
    "t34_t35_json": "SELECT rec_id, metadata->>'$.track' AS track, CASE WHEN coalesce(trim(metadata->>'$.track'), '') = '' THEN 'null' ELSE 'text' END AS kind, array_to_string(list_sort(list_transform(json_keys(metadata), lambda k: lower(json_extract_string(metadata, '$.\"' || k || '\"')))), ' ') AS flat FROM graph_nodes",
    "t29_dates": "SELECT rec_id, CAST(floor(epoch(added_at)) AS BIGINT) AS epoch, coalesce(date_trunc('second', added_at) >= TIMESTAMP '2025-05-02', true) AS recent, CAST(added_at AS DATE) BETWEEN DATE '2025-05-01' AND DATE '2025-05-31' AS in_month FROM graph_nodes",
    "t31_t33_evidence": "WITH e AS (SELECT rec_id, paper_id, CAST(" + " + ".join(f"CAST(contains(lower(quote), '{k}') AS INTEGER)" for k in ("order", "price", "volume", "spread")) + " AS INTEGER) AS score, section IS NULL AS section_missing FROM evidence WHERE paper_id IS NOT NULL AND quote IS NOT NULL) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, rec_id) AS INTEGER) AS rank FROM e) WHERE rank <= 8",
    "t36_t37_tokens": f"SELECT rec_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9][a-z0-9_-]*|[\\x{{4e00}}-\\x{{9fff}}]+'))), ' ') AS tokens, array_to_string(list_filter(regexp_extract_all(lower(coalesce(title, '')), '[a-z][a-z-]+'), lambda x: length(x) >= 3 AND x NOT IN ({', '.join(repr(s) for s in STOP)})), ' ') AS title_tokens, CAST(greatest(1, round_even(length(coalesce(title, '')) / CAST(4 AS DOUBLE), 0)) AS INTEGER) AS token_estimate FROM graph_nodes",
    "encoder_vectors": "WITH c AS (SELECT rec_id, " + ", ".join(f"CAST(length(lower(coalesce(title, ''))) - length(replace(lower(coalesce(title, '')), '{c}', '')) AS DOUBLE) AS c{i}" for i, c in enumerate("eox")) + " FROM graph_nodes) SELECT rec_id, " + ", ".join(f"round(coalesce(c{i} / nullif(sqrt(c0 * c0 + c1 * c1 + c2 * c2), 0), 0), 6) AS v{i}" for i in range(3)) + " FROM c",
    "t40_t49_scores": f"SELECT rec_id, CASE WHEN daily_rankic IS NOT NULL THEN printf('%.2f', floor(abs(daily_rankic) * 100 + CAST(1e-9 AS DOUBLE)) / 100) END AS bucket, CASE WHEN daily_rankic IS NULL THEN 'inconclusive' WHEN daily_rankic >= 0.02 THEN 'supported' ELSE 'refuted' END AS verdict, concat_ws(',', CASE WHEN coalesce(trim(reason), '') = '' THEN 'no_reason' END, CASE WHEN {_tags} <= 0 THEN 'no_tags' END, CASE WHEN coalesce(direction, 'unknown') = 'unknown' THEN 'no_direction' END) AS faults, round(CASE WHEN daily_rankic > 0 AND {_tags} > 0 THEN (daily_rankic * 100 + {_tags}) / 2 WHEN daily_rankic > 0 THEN daily_rankic * 100 WHEN {_tags} > 0 THEN {_tags} ELSE 0.5 END, 2) AS gate, CAST(least(10, 3 * {_tags}) AS INTEGER) AS capped, coalesce(label IN ('positive', 'warning'), false) AS stored FROM feedback_memory",
}
QUERIES = {f.__name__: f for f in (t1_t7_phrases, t8_t12_decisions, t13_t16_t50_terms, t18_topics, t19_t24_ids, t21_arxiv, t25_urls, t26_t27_keys, t28_embedding_text, t29_dates, t30_chunks, t31_t33_evidence, t34_t35_json, t36_t37_tokens, t38_hash_embedding, encoder_vectors, t39_best_match, t40_t49_scores, s10_documents)}
