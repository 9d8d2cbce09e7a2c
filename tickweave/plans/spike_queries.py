"""Queries of implausible ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.functions.codes import normal_code
from tickweave.operators.spikes import implausible
from tickweave.runtime import table


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "ticks")
    source = F.expr("try_cast(__code as int)")
    t = t.select(normal_code(F.col("code")).alias("__code"), "delay_time", "tick_id", "close", "volume", "askP1", "bidP1")
    return implausible(t, source, F.col("delay_time"), F.col("tick_id"), F.col("close"), F.col("volume"), F.col("askP1"), F.col("bidP1"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder).filter("reasons != 0").select(F.col("id").alias("tick_id"))


def p2_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder).select(F.lpad(F.col("source").cast("string"), 6, "0").alias("code"), F.col("id").alias("tick_id"), F.round("score", 6).alias("score"), "reasons")


QUERIES = {"p2_found": p2_found, "p2_scores": p2_scores}
ORACLE: dict[str, str] = {}
