"""Selections that depend on what was selected before."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweave.runtime import written


def portfolio(df: DataFrame, ident: str, score: str, cost: str, topic: str, n: int, budget: float, per_topic: int) -> DataFrame:
    """The best by score, ties by id, while count, cost and topic limits allow; what doesn't fit is passed over.

    Sorted rows stream to the driver until ``n`` are taken, or the cheapest row fits no more, or every topic is full; it
    holds one batch and the picks. Null scores and costs are out; a null topic is a topic."""
    rows = df.select(ident, score, cost, F.coalesce(F.col(topic).cast("string"), F.lit("?")).alias("topic")).dropna(subset=[ident, score, cost]).orderBy(F.desc(score), ident)
    picks, spent, used = [], 0.0, Counter()
    bounds = rows.agg(F.min(cost).alias("least"), F.countDistinct("topic").alias("topics")).first()
    for r in rows.toLocalIterator():
        if len(picks) >= min(n, per_topic * bounds["topics"]) or spent + bounds["least"] > budget:
            break
        if spent + r[cost] <= budget and used[r["topic"]] < per_topic:
            spent += r[cost]
            used[r["topic"]] += 1
            picks.append((r[ident], len(picks) + 1, float(spent)))
    kind = df.schema[ident].dataType.simpleString()
    return df.sparkSession.createDataFrame(picks, f"{ident} {kind}, rank int, spent double")


def coverage(pairs: DataFrame, pick: str, target: str, n: int) -> DataFrame:
    """``n`` picks, each the one that covers most targets that none before it covers (ties to the smallest).
    A distributed count per pick; the picks alone come to the driver."""
    left = written(pairs.select(F.col(pick).alias("p"), F.col(target).alias("t")).dropna().distinct(), "uncovered")
    out = []
    for i in range(n):
        best = left.groupBy("p").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "p").first()
        if best is None:
            break
        out.append((best["p"], i + 1, best["c"]))
        left = written(left.join(left.filter(F.col("p") == F.lit(best["p"])).select("t"), "t", "left_anti"), "uncovered")
    kind = pairs.schema[pick].dataType.simpleString()
    return pairs.sparkSession.createDataFrame(out, f"pick {kind}, rank int, new_targets long")


def balanced(df: DataFrame, kind: Column, order: Sequence[Column], recent: Column, ident: str, per_kind: int, explore: int, seed: str) -> DataFrame:
    """The best ``per_kind`` of each kind, the most recent, and ``explore`` others by a seeded hash."""
    x = df.withColumn("kind", kind)
    top = x.withColumn("r", F.row_number().over(W.partitionBy("kind").orderBy(*order))).filter(F.col("r") <= per_kind).select(ident, F.lit("top").alias("why"))
    last = x.orderBy(recent.desc_nulls_last(), ident).limit(1).select(ident, F.lit("recent").alias("why"))
    rest = x.join(top.unionByName(last).select(ident), ident, "left_anti").orderBy(F.sha2(F.concat(F.lit(seed), F.col(ident).cast("string")), 256)).limit(explore).select(ident, F.lit("explore").alias("why"))
    return top.unionByName(last).unionByName(rest).groupBy(ident).agg(F.max("why").alias("why"))


def within_size(df: DataFrame, tiers: Sequence[str], tier: str, order: str, text: str, most: int) -> DataFrame:
    """Records that fit into ``most`` characters when tiers go, the last-named first, each from its tail.

    Rows go into parts by their order; a running sum over the parts' sizes and one inside each part make the whole."""
    keep = F.array_position(F.array(*map(F.lit, tiers)), F.col(tier))
    parts = written(df.withColumn("__t", keep).repartitionByRange("__t", order).withColumn("__p", F.spark_partition_id()), "context")
    sizes = parts.groupBy("__p").agg(F.sum(F.length(text)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per part
    begin = sizes.select("__p", before.alias("__before")).filter(F.col("__before") <= most)  # later parts can't fit
    size = F.col("__before") + F.coalesce(F.sum(F.length(text)).over(W.partitionBy("__p").orderBy("__t", order).rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    return parts.join(F.broadcast(begin), "__p").withColumn("upto", size).filter(F.col("upto") <= most).drop("__t", "__p", "__before")


def round_robin(df: DataFrame, strata: Sequence[str], ident: str, n: int, seed: str) -> DataFrame:
    """``n`` rows over the strata in turn, in each by a seeded hash; a sampling operator."""
    h = F.sha2(F.concat(F.lit(seed), F.col(ident).cast("string")), 256)
    x = df.withColumn("turn", F.row_number().over(W.partitionBy(*strata).orderBy(h)))
    return x.orderBy("turn", *strata).limit(n)


def reserved(df: DataFrame, special: Column, order: Sequence[Column], n: int, least: int) -> DataFrame:
    """The best ``n`` of which at least ``least`` are special, if there are so many."""
    x = df.withColumn("special", F.coalesce(special, F.lit(False)))
    first = x.filter("special").orderBy(*order).limit(least).withColumn("tier", F.lit(0))
    rest = x.join(first.select(df.columns[0]), df.columns[0], "left_anti").withColumn("tier", F.lit(1))
    return first.unionByName(rest).orderBy("tier", *order).limit(n)
