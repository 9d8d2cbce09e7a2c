"""Queries of ranked retrieval, profiles, plans and tiers, and of rebuilt abstracts and bounded formulas."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweave.functions import text as X
from tickweave.operators import expr as E
from tickweave.operators import prefix as P
from tickweave.operators import retrieval as R
from tickweave.plans.corpus_queries import _M, _metrics
from tickweave.runtime import table

TERMS = ("price", "impact")
SYNONYMS = {"impact": ("pressure",)}
TAGS, OWN_FIELDS, WORDS = ("liquidity", "momentum"), ("askP1", "bidV6", "close"), ("coverage", "turnover", "small", "stable")
BY_TAG = {"liquidity": ("bidV1", "askV1"), "momentum": ("close", "last_close"), "order_flow": ("volume", "money"), "reversal": ("close",), "volatility": ("askP1", "bidP1")}
BY_WORD = {"turnover": ("volume",), "coverage": ("money", "volume"), "secret": ("ret60s",)}
ALWAYS, ALLOWED = ("close", "volume", "money"), ("close", "last_close", "volume", "money", "bidV1", "askV1", "bidP1", "askP1", "bidV6", "bidP7")
FOCI = ("window", "operator", "field")


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "graph_nodes")
    values = F.array_join(F.map_values(F.from_json("metadata", "map<string,string>")), " ")
    return n.select("rec_id", "id", "title", "abstract", F.lit("").alias("keywords"), F.array_join("authors", " ").alias("authors"), values.alias("metadata"))


def t4_t5_abstracts(spark: SparkSession, folder: str) -> DataFrame:
    """Inverted index of each abstract and the text rebuilt from it, and the names of the authors in one text."""
    words = F.filter(F.split(F.coalesce("abstract", F.lit("")), r"[ \t\n\r\f]+"), lambda w: w != "")
    places = F.transform(F.array_distinct("w"), lambda t: F.filter(F.sequence(F.lit(0), F.size("w")), lambda i: F.get("w", i) == t))
    n = table(spark, folder, "graph_nodes").select("rec_id", words.alias("w"), "authors")
    index = F.map_from_arrays(F.array_distinct("w"), places)
    return n.select("rec_id", X.rebuilt_abstract(index).alias("abstract"), F.size(index).alias("n_tokens"), X.joined_names(F.transform("authors", lambda a: F.struct(a.alias("display_name")))).alias("names"))


def r6_search(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes that have every word of a query with a misspelt one, corrected by the nodes' own vocabulary."""
    x = R.search(_nodes(spark, folder), ["revrsal", "signals"])
    return x.orderBy(F.desc("score"), "title", "rec_id").limit(40).select("rec_id", F.round("score", 6).alias("score"))


def r7_search(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every node for a query without correction."""
    low = R.search(_nodes(spark, folder), TERMS, SYNONYMS, correct=False)
    return low.select("rec_id", F.round("score", 6).alias("score"))


def _records(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "feedback_memory").select("rec_id", "factor_id", "reason", "mechanism_tags", "daily_rankic", "prefix_expression")
    return f.withColumn("fields", F.array_distinct(F.regexp_extract_all(F.coalesce("prefix_expression", F.lit("")), F.lit(r'"((?:ask|bid)[PV]\d+|close|volume|money|last_close)"'), F.lit(1))))


def r9_fields(spark: SparkSession, folder: str) -> DataFrame:
    """The five best fields of each record."""
    v = R.field_votes(_records(spark, folder), "rec_id", F.col("fields"), F.col("mechanism_tags"), F.col("reason"), BY_TAG, BY_WORD, ALWAYS, ALLOWED)
    return v.withColumn("rank", F.row_number().over(W.partitionBy("rec_id").orderBy(F.desc("score"), "field"))).filter("rank <= 5")


def r10_similar(spark: SparkSession, folder: str) -> DataFrame:
    """Likeness of every record to a signal."""
    r = _records(spark, folder)
    s = R.record_likeness(F.col("mechanism_tags"), F.col("fields"), F.col("reason"), F.col("daily_rankic"), TAGS, OWN_FIELDS, WORDS)
    return r.select("rec_id", F.round(s, 5).alias("score")).filter("score > 0")


def a17_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Coherence, distinctiveness and confidence of the titles of each source."""
    n = table(spark, folder, "graph_nodes").select("source", F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit(r"([a-z]{4,})"), F.lit(1)).alias("words"))
    return R.group_profiles(n, "source", "words")


def a7_reliability(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted reliability of each field from fidelity, status, confidence and shares of its metric rows."""
    m = _metrics(spark, folder)
    fidelity = F.when(F.col("horizon") <= 2, 90.0).when(F.col("horizon") <= 4, 60.0).otherwise(35.0)
    parts = {"fidelity": (fidelity, 0.4), "confidence": (F.when(F.col("n_obs") > 10, F.col("n_obs") * 2.0), 0.3), "known": (100 * F.col("daily_rankic").isNotNull().cast("double"), 0.3)}
    return R.reliability(m, ["factor_field"], parts, F.col("daily_rankic").isNull().cast("int") * 3)


def a8_utility(spark: SparkSession, folder: str) -> DataFrame:
    """Tiers of each factor by the mean coefficient of its fields, and their utility."""
    tier = F.when(F.col("horizon") <= 2, "small").when(F.col("horizon") <= 4, "medium").otherwise("large")
    m = _metrics(spark, folder).withColumn("tier", tier).groupBy("factor_name", "code", "tier").agg(F.round(F.avg("daily_ic"), 9).alias("v"))
    return R.tier_utility(m, "factor_name", "tier", "v")


def r22_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Score of each record with each focus; an arm is a direction and a focus, a lineage a direction."""
    f = table(spark, folder, "feedback_memory").select("rec_id", F.coalesce("direction", F.lit("unknown")).alias("lineage"), "daily_rankic", F.element_at(F.array(*map(F.lit, FOCI)), (F.col("rec_id") % 3 + 1).cast("int")).alias("focus"))
    arms = f.groupBy("lineage", "focus").agg(F.count("*").alias("trials"), F.round(F.avg("daily_rankic"), 9).alias("mean"), F.count_if(~(F.coalesce("daily_rankic", F.lit(0.0)) > 0)).alias("failures"))
    arms = arms.withColumn("lineage_trials", F.sum("trials").over(W.partitionBy("lineage")))  # arms, not records
    total = arms.agg(F.sum("trials").alias("total"))
    prior = F.when(F.col("focus") == "field", 0.05).otherwise(0.0)
    arms = arms.crossJoin(F.broadcast(total)).withColumn("arm", R.plan_score(F.lit(0.0), prior, F.col("trials"), F.col("mean"), F.least(F.col("failures"), F.lit(20)), F.col("total"), F.col("lineage_trials")))  # one row
    return f.select("rec_id", "lineage", "daily_rankic").join(arms.select("lineage", "focus", "arm"), "lineage").select("rec_id", "focus", F.round(F.coalesce("daily_rankic", F.lit(0.0)) + F.col("arm"), 6).alias("score"))


def f16_bounded(spark: SparkSession, folder: str) -> DataFrame:
    """Every readable expression as infix text, and whether the bounded dialect takes that text and gives it back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, text in zip(b["rec_id"], b["prefix_expression"]):
                try:
                    infix = E.infix(P.listed(json.loads(text)))
                except (ValueError, TypeError, RecursionError):
                    continue
                tree = E.bounded_infix(infix, BOUND_FIELDS)
                out.append((i, infix, tree is not None, tree is not None and E.infix(tree) == infix))
            yield pd.DataFrame(out, columns=["rec_id", "infix", "taken", "same"])

    f = table(spark, folder, "feedback_memory").select("rec_id", "prefix_expression").filter("prefix_expression is not null")
    return f.mapInPandas(run, "rec_id long, infix string, taken boolean, same boolean")


BOUND_FIELDS = ("close", "volume", "money", "last_close", *(f"{s}{k}{i}" for s in ("ask", "bid") for k in "PV" for i in range(1, 11)))
_has = lambda f, w: f"contains({f}, '{w}')"
_best = lambda ws: "greatest(" + ", ".join(f"CASE WHEN {_has(f, w)} THEN {v} ELSE 0 END" for w in ws for f, v in R.FIELDS.items() if f != "keywords") + ")"
_low = lambda c: f"lower(coalesce({c}, ''))"
_VARIANTS = {t: (t, *SYNONYMS.get(t, ())) for t in TERMS}
_LETTERS = sorted(set("".join(TERMS)))
_SEARCH = (
    "WITH n AS (SELECT rec_id, lower(coalesce(id, '')) AS id, lower(coalesce(title, '')) AS title, lower(coalesce(abstract, '')) AS abstract, lower(coalesce(array_to_string(authors, ' '), '')) AS authors,"
    " lower(coalesce(array_to_string(list_transform(json_keys(metadata), lambda k: json_extract_string(metadata, '$.\"' || k || '\"')), ' '), '')) AS metadata FROM graph_nodes),"
    " s AS (SELECT *, " + ", ".join(f"{_best(v)} AS s{i}, ({' OR '.join(_has('authors', w) for w in v)}) AS a{i}" for i, v in enumerate(_VARIANTS.values()))
    + ", (" + " + ".join(f"CAST(contains(title || '  ' || abstract || ' ' || authors || ' ' || id || ' ' || metadata, '{c}') AS INTEGER)" for c in _LETTERS) + f") / CAST({len(_LETTERS)} AS DOUBLE) AS o FROM n)"
    " SELECT rec_id, round(" + " + ".join(f"s{i} + CASE WHEN a{i} THEN 5 ELSE 0 END" for i in range(len(TERMS))) + " + o * CAST(0.25 AS DOUBLE), 6) AS score FROM s WHERE " + " AND ".join(f"s{i} > 0" for i in range(len(TERMS)))
)
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_REC = "f AS (SELECT rec_id, reason, mechanism_tags, daily_rankic, list_distinct(regexp_extract_all(coalesce(prefix_expression, ''), '\"((?:ask|bid)[PV]\\d+|close|volume|money|last_close)\"', 1)) AS fields FROM feedback_memory)"
_VOTES = " UNION ALL ".join(
    ["SELECT rec_id, unnest(fields) AS field, CAST(3 AS DOUBLE) AS v FROM f", f"SELECT rec_id, unnest({_list(ALWAYS)}), CAST(0.2 AS DOUBLE) FROM f"]
    + [f"SELECT rec_id, unnest({_list(fs)}), 2 FROM f WHERE list_contains(mechanism_tags, '{t}')" for t, fs in BY_TAG.items()]
    + [f"SELECT rec_id, unnest({_list(fs)}), 1 FROM f WHERE contains(lower(reason), '{w}')" for w, fs in BY_WORD.items()]
)
_T = lambda t: f"FILTER (tier = '{t}')"
_TIERS = ", ".join(f"count(v) {_T(t)} AS {t}_count, round(avg(abs(v)) {_T(t)}, 6) AS {t}_abs, round(avg(CAST(abs(v) > CAST(0.02 AS DOUBLE) AS INTEGER)) {_T(t)}, 6) AS {t}_share, round(abs(avg(sign(v)) {_T(t)}), 6) AS {t}_agree" for t in ("small", "medium", "large"))
_full = lambda c: f"least(coalesce({c}, 0) / CAST(0.03 AS DOUBLE), 1)"
ORACLE = {
    "t4_t5_abstracts": "WITH w AS (SELECT rec_id, authors, list_filter(string_split_regex(coalesce(abstract, ''), '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS w FROM graph_nodes) SELECT rec_id, array_to_string(w, ' ') AS abstract, CAST(len(list_distinct(w)) AS INTEGER) AS n_tokens, coalesce(array_to_string(list_transform(authors, lambda a: coalesce(a, '')), ' '), '') AS names FROM w",
    "r7_search": _SEARCH,
    "r9_fields": f"WITH {_REC}, s AS (SELECT rec_id, field, round(sum(v), 4) AS score FROM ({_VOTES}) WHERE field IN ({', '.join(repr(x) for x in ALLOWED)}) GROUP BY ALL) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY score DESC, field) AS INTEGER) AS rank FROM s) WHERE rank <= 5",
    "r10_similar": f"WITH {_REC}, s AS (SELECT rec_id, round(3 * len(list_intersect(coalesce(mechanism_tags, []), {_list(TAGS)})) + 2 * len(list_intersect(fields, {_list(OWN_FIELDS)})) + CAST(0.4 AS DOUBLE) * least(5, " + " + ".join(f"CAST(contains({_low('reason')}, '{w}') AS INTEGER)" for w in sorted(WORDS) if len(w) >= 5) + ") + least(abs(coalesce(daily_rankic, 0)), 1), 5) AS score FROM f) SELECT * FROM s WHERE score > 0",
    "a17_profiles": "WITH r AS (SELECT source, rec_id, unnest(regexp_extract_all(lower(coalesce(title, '')), '[a-z]{4,}')) AS w FROM graph_nodes WHERE source IS NOT NULL), c AS (SELECT source, rec_id, w, count(*) AS n FROM r GROUP BY ALL), z AS (SELECT source, rec_id, sqrt(sum(n * n)) AS size FROM c GROUP BY ALL),"
    " u AS (SELECT source, w, sum(n / size) AS u, sum(n) AS n FROM c JOIN z USING (source, rec_id) GROUP BY ALL), m AS (SELECT source, CAST(count(*) AS DOUBLE) AS m FROM z GROUP BY 1), co AS (SELECT source, CASE WHEN m > 1 THEN (sum(u * u) - m) / (m * (m - 1)) ELSE 1 END AS co FROM u JOIN m USING (source) GROUP BY source, m),"
    " t AS (SELECT source, w, n, n * (ln((1 + (SELECT count(DISTINCT source) FROM graph_nodes)) / CAST(1 + count(*) OVER (PARTITION BY w) AS DOUBLE)) + 1) AS t FROM u), k AS (SELECT source, sqrt(sum(t * t)) AS nt, sqrt(sum(CAST(n AS DOUBLE) * n)) AS nn FROM t GROUP BY 1),"
    " d AS (SELECT a.source, b.source AS other, sum(a.t * b.n) AS dot FROM t a JOIN t b ON a.w = b.w AND a.source <> b.source GROUP BY ALL), x AS (SELECT d.source, max(dot / (p.nt * q.nn)) AS near FROM d JOIN k p ON p.source = d.source JOIN k q ON q.source = d.other GROUP BY 1),"
    " g AS (SELECT source, count(*) AS n_rows FROM graph_nodes WHERE source IS NOT NULL GROUP BY 1) SELECT source, n_rows, round(coalesce(co, 1), 4) AS coherence, round(1 - coalesce(near, 0), 4) AS distinctiveness, round(greatest(0, least(1, CAST(0.6 AS DOUBLE) * coalesce(co, 1) + CAST(0.4 AS DOUBLE) * (1 - coalesce(near, 0)))), 4) AS confidence FROM g LEFT JOIN co USING (source) LEFT JOIN x USING (source)",
    "a7_reliability": f"WITH {_M}, x AS (SELECT factor_field, avg(CASE WHEN horizon <= 2 THEN 90 WHEN horizon <= 4 THEN 60 ELSE 35 END) AS fidelity, avg(CASE WHEN n_obs > 10 THEN n_obs * 2 END) AS confidence, avg(CASE WHEN daily_rankic IS NULL THEN 0 ELSE 100 END) AS known, avg(CASE WHEN daily_rankic IS NULL THEN 3 ELSE 0 END) AS unresolved FROM m GROUP BY 1) SELECT factor_field, round(fidelity, 6) AS fidelity, round(confidence, 6) AS confidence, round(known, 6) AS known, round(unresolved, 6) AS unresolved, round(greatest(0, CAST(0.4 AS DOUBLE) * fidelity + CAST(0.3 AS DOUBLE) * coalesce(confidence, 0) + CAST(0.3 AS DOUBLE) * known - least(unresolved * 6, 35)), 1) AS reliability FROM x",
    "a8_utility": f"WITH {_M}, v AS (SELECT factor_name, code, CASE WHEN horizon <= 2 THEN 'small' WHEN horizon <= 4 THEN 'medium' ELSE 'large' END AS tier, round(avg(daily_ic), 9) AS v FROM m GROUP BY ALL), x AS (SELECT factor_name, {_TIERS} FROM v GROUP BY 1) SELECT *, round(100 * (CAST(0.45 AS DOUBLE) * {_full('small_abs')} + CAST(0.25 AS DOUBLE) * coalesce(small_share, 0) + CAST(0.2 AS DOUBLE) * ({_full('medium_abs')} + {_full('large_abs')}) / 2 + CAST(0.1 AS DOUBLE) * coalesce(small_agree, 0)), 1) AS utility FROM x",
    "r22_plan": "WITH f AS (SELECT rec_id, coalesce(direction, 'unknown') AS lineage, daily_rankic, ['window', 'operator', 'field'][rec_id % 3 + 1] AS focus FROM feedback_memory), a AS (SELECT lineage, focus, count(*) AS n, round(avg(daily_rankic), 9) AS m, count(*) FILTER (NOT coalesce(daily_rankic > 0, false)) AS bad FROM f GROUP BY ALL),"
    " b AS (SELECT *, sum(n) OVER (PARTITION BY lineage) AS ln, (SELECT sum(n) FROM a) AS total FROM a), c AS (SELECT lineage, focus, CASE WHEN focus = 'field' THEN CAST(0.05 AS DOUBLE) ELSE 0 END + coalesce(m, 0) + CAST(0.03 AS DOUBLE) * sqrt(ln(total + 1) / (n + 1)) - CAST(0.01 AS DOUBLE) * least(bad, 20) - least(CAST(0.2 AS DOUBLE), CAST(0.025 AS DOUBLE) * sqrt(ln)) - least(CAST(0.18 AS DOUBLE), CAST(0.04 AS DOUBLE) * sqrt(n)) AS arm FROM b)"
    " SELECT rec_id, focus, round(coalesce(daily_rankic, 0) + arm, 6) AS score FROM f JOIN c USING (lineage)".replace("f JOIN c USING (lineage)", "(SELECT rec_id, lineage, daily_rankic FROM f) JOIN c USING (lineage)"),
}
QUERIES = {f.__name__: f for f in (t4_t5_abstracts, r6_search, r7_search, r9_fields, r10_similar, a17_profiles, a7_reliability, a8_utility, r22_plan, f16_bounded)}
