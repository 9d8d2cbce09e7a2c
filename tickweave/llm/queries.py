"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm import bpe, collapse, incremental, langid, matching, mixing, truncation
from tickweave.runtime import table


def _ends(spark: SparkSession, folder: str) -> DataFrame:
    of = [("graph_nodes", "abstract"), ("evidence", "quote")]
    a, b = (table(spark, folder, t).select(F.lit(t).alias("tab"), F.col("source").cast("string"), F.col("rec_id").cast("long"), F.col(c).cast("string").alias("text")) for t, c in of)
    return a.unionByName(b)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncated(_ends(spark, folder)).filter(F.col("score") >= truncation.THRESHOLD).select("tab", "rec_id")


def p3_sources(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.report(truncation.truncated(_ends(spark, folder)))


def _matches(spark: SparkSession, folder: str) -> DataFrame:
    w, p = table(spark, folder, "works"), table(spark, folder, "preprints")
    digits = F.regexp_extract(F.coalesce(F.col("openalex_id"), F.lit("")), r"[wW](\d+)", 1)
    bare = F.regexp_extract(F.coalesce(F.col("arxiv_id"), F.lit("")), r"(\d{4}\.\d{4,5}|[a-z-]+(?:\.[A-Z]{2})?/\d{7})", 1)
    works = matching.entities(w, F.when(digits != "", F.concat(F.lit("W"), digits)), F.col("title"), F.col("authors"), None, F.col("publication_year"), F.col("doi"), F.struct("updated_at", "rec_id"))
    prints = matching.entities(p, F.nullif(bare, F.lit("")), F.col("title"), None, F.col("author_line"), F.year("submitted"), F.col("doi"), F.struct("received_at", "rec_id"))
    return matching.match(prints, works)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    m = _matches(spark, folder).filter(F.col("confidence") >= matching.THRESHOLD)
    return m.select(F.col("a_id").alias("arxiv_id"), F.col("b_id").alias("openalex_id"))


def p4_matches(spark: SparkSession, folder: str) -> DataFrame:
    return _matches(spark, folder).select(F.col("a_id").alias("arxiv_id"), F.col("b_id").alias("openalex_id"), "confidence")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "feedback_memory")
    r = incremental.readable(t, F.col("rec_id"), F.col("batch_no"), F.col("prefix_expression"), F.col("direction"))
    return incremental.deduplicate(r, incremental.BatchIndex(spark))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return collapse.copies(table(spark, folder, "graph_nodes"), "rec_id", ["id", "title"])


def p6_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return collapse.collapse(table(spark, folder, "graph_nodes"), "rec_id", ["id", "title"])


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, folder, "documents"), F.col("doc_id"), F.col("text"))


def _mix(spark: SparkSession, folder: str, exact: bool) -> tuple[DataFrame, DataFrame]:
    d = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.mix(mixing.sized(d, F.col("doc_id"), F.col("text"), F.col("source")), table(spark, folder, "mix_targets"), exact_shares=exact)


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder, False)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder, False)[1]


def p8_mix_exact(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder, True)[0]


def p8_shares_exact(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder, True)[1]


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    return langid.segments(table(spark, folder, "documents").select("doc_id", "text", "lang"), F.col("doc_id"), F.col("text"), F.col("lang"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return langid.mislabelled(_segments(spark, folder))


def p9_segments(spark: SparkSession, folder: str) -> DataFrame:
    return _segments(spark, folder)


QUERIES = {"p4_found": p4_found, "p4_matches": p4_matches, "p9_found": p9_found, "p9_segments": p9_segments, "p3_found": p3_found, "p3_sources": p3_sources, "p5_found": p5_found, "p6_found": p6_found, "p6_nodes": p6_nodes, "p7_ids": p7_ids, "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_mix_exact": p8_mix_exact, "p8_shares_exact": p8_shares_exact}
ORACLE: dict[str, str] = {}
