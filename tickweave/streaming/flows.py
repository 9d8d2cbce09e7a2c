"""Incremental and event-driven flows: shards, replay, ledgers, chains, transitions, age windows, new rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def incremental_shards(spark: SparkSession, source: str, schema: StructType, process: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Every Parquet file of a folder processed exactly once: a file stream with a checkpoint that takes what is
    there and ends. A batch that is repeated after a crash overwrites its own output."""

    def run(batch: DataFrame, epoch: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{target}/batch={epoch}")

    s = spark.readStream.schema(schema).parquet(source)
    return s.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, keys: Sequence[str], value: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums per window; rows later than the watermark are left out. Works on streams and on tables."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def replayed(events: DataFrame, run: str, seq: str, kind: str, moves: DataFrame, start: str) -> DataFrame:
    """State of each run after its events in order, and its refused events. ``moves`` (state, kind, next) is a small
    table of the machine. A fold has no form as an aggregate; a run's log is what one group holds."""
    table = {(r["state"], r["kind"]): r["next"] for r in moves.collect()}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        state, bad = start, 0
        for k in pdf.sort_values(seq, kind="stable")[kind]:
            nxt = table.get((state, k))
            state, bad = (nxt, bad) if nxt is not None else (state, bad + 1)
        return pd.DataFrame({run: [pdf[run].iloc[0]], "state": [state], "refused": [bad], "events": [len(pdf)]})

    return events.select(run, seq, kind).groupBy(run).applyInPandas(fold, f"{run} {events.schema[run].dataType.simpleString()}, state string, refused int, events int")


def replay_stream(events: DataFrame, run: str, kind: str, moves: dict[tuple[str, str], str], start: str) -> DataFrame:
    """The same on a stream, in order of arrival: (run, state, events) after each batch."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, n = state.get if state.exists else (start, 0)
        for pdf in batches:
            for k in pdf[kind]:
                now, n = moves.get((now, k), now), n + 1
        state.update((now, n))
        yield pd.DataFrame({run: [key[0]], "state": [now], "events": [n]})

    kind_of = events.schema[run].dataType.simpleString()
    return events.groupBy(run).applyInPandasWithState(fold, f"{run} {kind_of}, state string, events long", "state string, events long", "update", "NoTimeout")


def ledger(events: DataFrame, account: Sequence[str], event: str, amount: str, seq: str, limit: Column | float) -> DataFrame:
    """Verdict of each ledger event in order: replay (same id and amount as before), conflict (same id, other
    amount), rejected (the running sum of first events would pass the limit) or accepted, with the sum so far.

    The sum counts all first events up to the row; a ledger closes with its first rejection."""
    by_id = W.partitionBy(*account, event).orderBy(seq)
    x = events.withColumns({"first": F.row_number().over(by_id) == 1, "was": F.first(amount).over(by_id)})
    run = F.sum(F.when(F.col("first"), F.coalesce(amount, F.lit(0.0))).otherwise(0.0)).over(W.partitionBy(*account).orderBy(seq).rowsBetween(W.unboundedPreceding, 0))
    cap = limit if isinstance(limit, Column) else F.lit(float(limit))
    verdict = F.when(~F.col("first") & F.col("was").eqNullSafe(F.col(amount)), "replay").when(~F.col("first"), "conflict").when(F.col("spent") > cap, "rejected").otherwise("accepted")
    return x.withColumn("spent", run).withColumn("verdict", verdict).drop("first", "was")


def chain_faults(events: DataFrame, run: str, seq: str, ident: str, previous: str) -> DataFrame:
    """Events whose previous id is not that of the event before, or whose number does not follow."""
    w = W.partitionBy(run).orderBy(seq)
    x = events.withColumns({"__id": F.lag(ident).over(w), "__seq": F.lag(seq).over(w)})
    fault = F.when(~F.col(previous).eqNullSafe(F.col("__id")), "broken link").when(F.col("__seq").isNotNull() & (F.col(seq) != F.col("__seq") + 1), "gap")
    return x.withColumn("fault", fault).filter("fault is not null").drop("__id", "__seq")


def transition_faults(events: DataFrame, run: str, seq: str, state: str, allowed: DataFrame) -> DataFrame:
    """Changes of state that the table (state, next) does not allow."""
    x = events.withColumn("__before", F.lag(state).over(W.partitionBy(run).orderBy(seq))).filter("__before is not null")
    a = allowed.select(F.col("state").alias("__before"), F.col("next").alias(state)).distinct()
    return x.join(a, ["__before", state], "left_anti").withColumnRenamed("__before", "before")


def new_rows(incoming: DataFrame, known: DataFrame, keys: str) -> DataFrame:
    """Rows of which no identity key (array column) is known yet."""
    k = known.select(F.explode(keys).alias("__k")).distinct()
    x = incoming.withColumn("__row", F.xxhash64(F.to_json(F.struct(*incoming.columns))))
    seen = x.select("__row", F.explode(keys).alias("__k")).join(k, "__k", "left_semi").select("__row").distinct()
    return x.join(seen, "__row", "left_anti").drop("__row")


def new_stream_rows(stream: DataFrame, time: str, keys: Sequence[str], late: str = "7 days") -> DataFrame:
    """The first row of each key on a stream, remembered for the watermark's time."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def cached(rows: DataFrame, cache: DataFrame, key: Sequence[str], result: str, most: int, order: Sequence[str]) -> DataFrame:
    """Rows with their cached result; of the others the first ``most`` in order are due, the rest pending (a rate
    limit is the feature)."""
    x = rows.join(cache.select(*key, result), list(key), "left")
    due = x.filter(F.col(result).isNull()).select(*key, *order).distinct().orderBy(*order).limit(most).select(*key).withColumn("__due", F.lit(True))
    y = x.join(due, list(key), "left")
    return y.withColumn("status", F.when(F.col(result).isNotNull(), "cached").when(F.col("__due"), "due").otherwise("pending")).drop("__due")
