"""Irregular readings onto a regular grid: an as-of merge of readings and grid on both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweave.runtime import finite, wall_micros

#: Sessions as (first minute, minute after the last) of the day.
SESSIONS = ((570, 690), (780, 900))
STEP_MIN = 5
GAP_LIMIT_MIN = 30


def regular_grid(
    readings: DataFrame,
    source: Column,
    time: Column,
    value: Column,
    order: Column,
    *,
    sessions: tuple[tuple[int, int], ...] = SESSIONS,
    step_min: int = STEP_MIN,
    gap_limit_min: int = GAP_LIMIT_MIN,
) -> DataFrame:
    """A row per source, day and period for each day on which the source has a reading in the session.

    Columns: source, day (date), minute (start of the period), n_readings, first_value, last_value (of the
    period), grid_value (at the start of the period), status. ``grid_value`` is interpolated linearly in
    time between the last reading at or before the start and the first at or after it, wherever in the
    day they are, if they are at most ``gap_limit_min`` apart; else null. ``status`` is observed (the period
    has a reading), interpolated (none, grid_value known) or missing (none, grid_value null).

    Readings with null source, time or value or a NaN don't exist; an infinite one is a reading, and no grid_value is
    made of it; of several at one time the last in
    ``order`` counts to the left and the first to the right. An empty input gives an empty result.

    Readings shrink to a first and a last per period before anything is sorted (partial aggregation, so a hot
    source or day spreads over all tasks); the merge itself sees at most 24 h / step rows per source and day.
    """
    day_us, step_us = 86_400_000_000, step_min * 60_000_000
    r = readings.select(source.alias("source"), F.to_date(time).alias("day"), wall_micros(time).alias("us"), order.alias("seq"), value.cast("double").alias("value"))
    r = r.filter("source is not null and day is not null and value is not null and not isnan(value)")
    s = F.struct("us", "seq", "value")
    slots = r.groupBy("source", "day", (F.col("us") / step_us).cast("int").alias("slot")).agg(F.count("*").alias("n"), F.min(s).alias("first"), F.max(s).alias("last"))
    starts = [m // step_min for a, b in sessions for m in range(a, b, step_min)]
    inside = F.col("slot").isin(starts)
    days = slots.filter(inside).select("source", "day").distinct()
    empty = days.select("source", "day", F.explode(F.array(*map(F.lit, starts))).alias("slot"), F.lit(0).cast("long").alias("n"), F.lit(None).cast(slots.schema["first"].dataType).alias("first"), F.lit(None).cast(slots.schema["last"].dataType).alias("last"))
    both = slots.unionByName(empty)
    at = W.partitionBy("source", "day").orderBy("slot", F.desc("n"))
    # Of a period with readings both rows are here; the grid's own row is dropped once it is known to be double.
    merged = both.select(
        "*",
        F.last("last", ignorenulls=True).over(at.rowsBetween(W.unboundedPreceding, -1)).alias("before"),
        F.first("first", ignorenulls=True).over(at.rowsBetween(0, W.unboundedFollowing)).alias("after"),
        F.lag("slot").over(at).alias("above"),
        F.max(inside & (F.col("n") > 0)).over(W.partitionBy("source", "day")).alias("open"),
    ).filter(F.col("open") & inside & ((F.col("n") > 0) | F.col("above").isNull() | (F.col("above") != F.col("slot"))))
    start = F.col("slot").cast("long") * step_us
    gap = F.col("after.us") - F.col("before.us")
    grid_value = (
        F.when(F.col("after.us") == start, F.col("after.value"))
        .when((gap <= gap_limit_min * 60_000_000) & (gap > 0), F.col("before.value") + (F.col("after.value") - F.col("before.value")) * ((start - F.col("before.us")) / gap))
    )
    out = merged.select("source", "day", (F.col("slot") * step_min).alias("minute"), F.col("n").alias("n_readings"), F.col("first.value").alias("first_value"), F.col("last.value").alias("last_value"), finite(grid_value).alias("grid_value"))
    assert day_us % step_us == 0
    return out.withColumn("status", F.when(F.col("n_readings") > 0, "observed").when(F.col("grid_value").isNotNull(), "interpolated").otherwise("missing"))
