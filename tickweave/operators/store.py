"""Keyed stores: de-duplication and merging policies, keyed updates, tiered and capped selection."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in ``order``, nulls first; a row with a null key is kept."""
    return _one(df, keys, order, F.min)


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in ``order``, nulls first; a row with a null key is kept."""
    return _one(df, keys, order, F.max)


def _one(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick: Callable[[Column], Column]) -> DataFrame:
    # Aggregates on the map side: a hot key sends a row per task. Ties of the order fall to the whole row.
    row = F.struct(*(F.col(c) for c in order), F.struct(*(F.col(c) for c in df.columns)).alias("row"))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    best = df.filter(known).groupBy(*keys).agg(pick(row).alias("b")).select("b.row.*")
    return best.select(*df.columns).unionByName(df.filter(~known))


def fill_merge(df: DataFrame, keys: Sequence[str], order: Sequence[str], fill: Sequence[str], union: Sequence[str] = (), last: bool = False) -> DataFrame:
    """One row per key: of each ``fill`` column the first (or last) value that is neither null nor blank, of each
    ``union`` array column the distinct values, sorted."""
    def pick(c: str) -> Column:
        full = F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
        v = F.when(full, F.struct(*order, c))
        return (F.max if last else F.min)(v)[c].alias(c)

    sets = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast(df.schema[c].dataType)))))).alias(c) for c in union]
    return df.groupBy(*keys).agg(*map(pick, fill), *sets, F.count("*").alias("n_rows"))


def richest(df: DataFrame, keys: Sequence[str], richness: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key with the lexicographically largest richness; ties go to the earliest."""
    w = W.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in richness), *order)
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def consolidate(df: DataFrame, keys: Sequence[str], ident: str, seq: str, created: str, usage: str | None = None, lists: Sequence[str] = (), scalars: Sequence[str] = ()) -> DataFrame:
    """Records of one fingerprint merged: occurrence and usage counts summed, ids and lists united, scalars the first
    that is not blank, the earliest and latest times; most occurrences first."""
    one = lambda c: F.min(F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), F.struct(seq, c)))[c].alias(c)
    out = df.groupBy(*keys).agg(
        F.count("*").alias("occurrence_count"), (F.sum(F.coalesce(usage, F.lit(0))) if usage else F.lit(0).cast("long")).alias("usage_count"), F.array_sort(F.collect_set(ident)).alias("source_ids"),
        *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast(df.schema[c].dataType)))))).alias(c) for c in lists), *map(one, scalars),
        F.min(created).alias("created_at"), F.max(created).alias("updated_at"),
    )
    return out


def keyed_update(df: DataFrame, key: str, ids: DataFrame, column: str, by: int) -> DataFrame:
    """``column`` raised by ``by`` where the key is in ``ids``; rows and other columns stay."""
    hit = ids.select(F.col(ids.columns[0]).alias("__k")).distinct().withColumn("__hit", F.lit(True))
    x = df.join(hit, F.col(key) == F.col("__k"), "left")
    return x.withColumn(column, F.when(F.col("__hit"), F.coalesce(column, F.lit(0)) + by).otherwise(F.col(column))).select(*df.columns)


def best_by(df: DataFrame, keys: Sequence[str], by: Sequence[str], value: Sequence[str]) -> DataFrame:
    """Of each key the values at the lexicographic maximum of ``by``."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*value), F.struct(*by)).alias("b")).select(*keys, "b.*")


def capped(df: DataFrame, group: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """At most ``most`` rows of each group, the first in ``order``, with their rank."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def tiered(df: DataFrame, forced: Column, order: Sequence[Column], n: int) -> DataFrame:
    """Forced rows first, then the best others, ``n`` in all; a top-n without a global sort."""
    x = df.withColumn("forced", F.coalesce(forced, F.lit(False)))
    return x.orderBy(F.desc("forced"), *order).limit(n)


def arm_statistics(df: DataFrame, arm: Sequence[str], reward: str, seq: str) -> DataFrame:
    """Trials, mean reward, successes and failures and the last known reward of each arm."""
    return df.groupBy(*arm).agg(F.count("*").alias("n_trials"), F.avg(reward).alias("mean_reward"), F.count_if(F.col(reward) > 0).alias("n_success"), F.count_if(~(F.coalesce(F.col(reward), F.lit(0.0)) > 0)).alias("n_failure"), F.max(F.when(F.col(reward).isNotNull(), F.struct(F.col(seq).alias("s"), F.col(reward).alias("r"))))["r"].alias("last_reward"))


def nearest_rank(df: DataFrame, group: Sequence[str], value: str, shares: Sequence[int], parts: int = 64) -> DataFrame:
    """The value at place floor(n p / 100) (from 0, the last at most) of each group's sorted values, for each p.

    Values are counted, the counts of a group fall into about ``parts`` ranges of values by approximate quantiles, the
    ranges are added up, and exact places follow inside a range: a task holds a range of a group's values, never all."""
    known = df.filter(F.col(value).isNotNull()).select(F.to_json(F.struct(*group)).alias("__g"), *group, F.col(value).alias("__v"))
    cuts = known.groupBy("__g").agg(F.percentile_approx("__v", F.array(*(F.lit(i / parts) for i in range(1, parts))), 1000).alias("__cuts"))
    n = known.groupBy("__g", *group, "__v").agg(F.count("*").alias("__c")).join(cuts, "__g")
    n = n.withColumn("__part", F.size(F.filter("__cuts", lambda x: x < F.col("__v")))).drop("__cuts")
    sums = n.groupBy("__g", "__part").agg(F.sum("__c").alias("__s"))
    by = W.partitionBy("__g")
    sums = sums.select("__g", "__part", (F.sum("__s").over(by.orderBy("__part")) - F.col("__s")).alias("__before"), F.sum("__s").over(by).alias("__n"))  # at most ``parts`` rows of a group
    up = W.partitionBy("__g", "__part").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    x = n.join(sums, ["__g", "__part"]).withColumn("__upto", F.col("__before") + F.sum("__c").over(up))
    at = lambda p: F.least(F.floor(F.col("__n") * p / 100), F.col("__n") - 1)
    return x.groupBy("__g", *group).agg(*(F.min(F.when(F.col("__upto") > at(p), F.col("__v"))).alias(f"p{p}") for p in shares)).drop("__g")


def metric_summary(df: DataFrame, group: Sequence[str], metrics: Mapping[str, str], above: Mapping[str, Sequence[float]], obs: str, digits: int | None = 6, missing: str = "skip") -> DataFrame:
    """Means, rows and observations, and for each threshold of a metric the number and share of values above it, and
    above it in size. Missing and infinite values are skipped, or with ``missing='zero'`` count as 0."""
    from tickweave.runtime import finite

    r = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    m = {k: (finite(F.col(c)) if missing == "skip" else F.coalesce(finite(F.col(c)), F.lit(0.0))) for k, c in metrics.items()}
    aggs = [r(F.avg(c)).alias(f"mean_{k}") for k, c in m.items()]
    for k, levels in above.items():
        for v in levels:
            name = f"{k}_gt_{str(v).replace('.', '')}"
            for tag, x in (("", m[k]), ("abs_", F.abs(m[k]))):
                aggs += [F.count_if(x > v).alias(f"{tag}{name}_count"), r(F.try_divide(F.count_if(x > v).cast("double"), F.count(x))).alias(f"{tag}{name}_ratio")]
    return df.groupBy(*group).agg(*aggs, F.sum(F.coalesce(obs, F.lit(0))).alias("total_obs"), F.count("*").alias("row_count"))
