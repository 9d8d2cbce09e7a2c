"""Implausible values in per-source readings: isolation forests per source, run lengths and physical limits."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.runtime import wall_micros, written

FIELDS = ("close", "volume", "ask", "bid")
PRICES = ("close", "ask", "bid")
#: Rows of one source that train its forest: this many on average, all of a smaller source's.
TRAIN_ROWS = 2048
#: Trees of each feature, rows that grow one, and its depth.
TREES, PER_TREE, DEPTH = 32, 128, 8
#: Features of the forest: deviations from the neighbours, volume against the source's level and its season, runs.
COLUMNS = ("close", "ask", "bid", "level", "season", "run_close", "run_volume", "run_ask", "run_bid")
#: Trees cut between 0 and SPAN natural limits; their mean path is kept in CELLS steps.
SPAN, CELLS = 2.0, 512
#: Rows taken through the sequence features at once, and rows of a source in one scoring group.
BLOCK, CHUNK = 100_000, 50_000
#: All forests together are broadcast up to this size; beyond it they are joined by source.
BROADCAST_BYTES = 64 << 20
PRICE_STEP = 0.01
SLOTS, SLOT_US = 48, 1_800_000_000
#: Score of a reading at its source's natural limit; a reading with this score or more is implausible.
SCORE = 0.5
#: Natural readings beyond the limit that are expected in a whole source: deviations, volumes, runs.
CHANCE, VOLUME_CHANCE, RUN_CHANCE = 0.01, 0.0001, 0.002
#: Least growth of a deviation from its 95 % to its 99 % quantile, in units of the first and a price step.
LEAST_TAIL = 0.35
#: A season of the day counts as much as the source's level when it has this many readings.
SEASON_ROWS = 20
PHYSICAL, END_BITS = 1, {"close": 2, "ask": 4, "bid": 8}
_FEATURES = "source int, id long, bits int, d_close float, d_ask float, d_bid float, log_volume float, log_close float, step float, run_close int, run_volume int, run_ask int, run_bid int, slot int"


# sequence features ---------------------------------------------------------------------------------------------


def _shift(x: np.ndarray, g: np.ndarray, k: int) -> np.ndarray:
    out = np.full(len(x), np.nan)
    a, b = (slice(k, None), slice(None, -k)) if k > 0 else (slice(None, k), slice(-k, None))
    if len(x) > abs(k):
        out[a] = np.where(g[a] == g[b], x[b], np.nan)
    return out


def _median3(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Median of the values that are there."""
    s = np.sort(np.stack([a, b, c]), axis=0)  # NaN comes last
    n = 3 - np.isnan(s).sum(axis=0)
    return np.where(n == 3, s[1], np.where(n == 2, (s[0] + s[1]) / 2, s[0]))


def _deviation(x: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far a value lies from the three before it and the three after it, where both say the same direction
    (the nearer of both); a new level that the next values keep is no deviation. And whether a side is missing."""
    before, after = (x - _median3(*(_shift(x, g, s * k) for k in (1, 2, 3))) for s in (1, -1))
    both = ~np.isnan(before) & ~np.isnan(after)
    d = np.where(both, np.where(before * after > 0, np.where(np.abs(before) < np.abs(after), before, after), 0), np.where(np.isnan(before), after, before))
    return np.nan_to_num(d), ~both


def _runs(x: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Length of the run of equal values that each value is in; negative at the first of the run."""
    first = np.ones(len(x), bool)
    first[1:] = (x[1:] != x[:-1]) | (g[1:] != g[:-1])
    run = np.cumsum(first) - 1
    n = np.bincount(run)[run] if len(x) else np.zeros(0, int)
    return np.where(first, -n, n)


def sequence_features(source, day, us, ids, values: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Rows sorted by source, day, time and id; whole days. A row of the same time and values as one of the two
    before it is a copy: it takes the features of that row and counts for nothing itself."""
    n = len(source)
    g = np.zeros(n, np.int64)
    g[1:] = np.cumsum((source[1:] != source[:-1]) | (day[1:] != day[:-1]))
    of = np.arange(n)
    for k in (2, 1):
        if n > k:
            same = (g[k:] == g[:-k]) & (us[k:] == us[:-k])
            for x in values.values():
                same &= (x[k:] == x[:-k]) | (np.isnan(x[k:]) & np.isnan(x[:-k]))
            of[k:] = np.where(same, np.arange(n - k), of[k:])
    for _ in range(64):  # copies of copies
        if (of[of] == of).all():
            break
        of = of[of]
    own = of == np.arange(n)
    bits = np.zeros(n, np.int32)
    out: dict[str, np.ndarray] = {}
    for f in PRICES:
        x = values[f]
        at = np.flatnonzero(own & (x > 0) & np.isfinite(x))
        d, end = _deviation(np.log(x[at]), g[at])
        out["d_" + f] = np.zeros(n, np.float32)
        out["d_" + f][at] = d
        bits[at] |= END_BITS[f] * end.astype(np.int32)
        if f == "close":
            out["log_close"], out["step"] = np.full(n, np.nan, np.float32), np.zeros(n, np.float32)
            out["log_close"][at] = np.log(x[at])
            out["step"][at] = np.nan_to_num(np.log(x[at]) - _shift(np.log(x[at]), g[at], 1))
    for f in FIELDS:
        x = values[f]
        at = np.flatnonzero(own & np.isfinite(x) & ((x != 0) | (f != "volume")))
        out["run_" + f] = np.zeros(n, np.int32)
        out["run_" + f][at] = _runs(x[at], g[at])
    with np.errstate(divide="ignore", invalid="ignore"):
        out["log_volume"] = np.where((values["volume"] > 0) & np.isfinite(values["volume"]), np.log(values["volume"]), np.nan).astype(np.float32)
    bits |= PHYSICAL * _impossible(values)
    out["bits"], out["slot"] = bits, (us // SLOT_US).astype(np.int32)
    out = {k: v[of] for k, v in out.items()} | {"source": source, "id": ids}
    names = [x.split()[0] for x in _FEATURES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(out[k]) for k in names], names)


def _impossible(v: dict[str, np.ndarray]) -> np.ndarray:
    bad = (v["volume"] < 0) | (v["ask"] < v["bid"])
    for f in PRICES:
        bad |= v[f] <= 0
    for f in FIELDS:
        bad |= np.isinf(v[f])
    return bad.astype(np.int32)


def impossible(close: Column, volume: Column, ask: Column, bid: Column) -> Column:
    """The physical limits as a column: a price at or below zero, a negative volume, an ask below the bid, an
    infinite value. Null and NaN are missing, not impossible."""
    bad = F.lit(False)
    for c in (close, ask, bid):
        bad = bad | F.coalesce((c <= 0) | (F.abs(c) == float("inf")), F.lit(False))
    bad = bad | F.coalesce((volume < 0) | (volume == float("inf")), F.lit(False))
    return bad | F.coalesce((ask < bid) & ~F.isnan(ask) & ~F.isnan(bid), F.lit(False))


def _sequence_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole days of sources, at least BLOCK rows at once where there are so many."""

    def block(t: pa.Table) -> pa.RecordBatch:
        x = [t.column(i).to_numpy(zero_copy_only=False) for i in range(t.num_columns)]
        return sequence_features(*x[:4], {f: np.asarray(v, float) for f, v in zip(FIELDS, x[4:])})

    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < BLOCK:
            continue
        t = pa.Table.from_batches(held)
        s, d = t.column(0).to_numpy(), t.column(1).to_numpy()
        cut = np.flatnonzero((s[1:] != s[:-1]) | (d[1:] != d[:-1]))
        if len(cut):
            end = int(cut[-1]) + 1
            yield block(t.slice(0, end))
            held, rows = t.slice(end).to_batches(), t.num_rows - end
    if rows:
        yield block(pa.Table.from_batches(held))


# forests ---------------------------------------------------------------------------------------------------------


def _average_path(n: np.ndarray) -> np.ndarray:
    m = np.maximum(n, 2).astype(float)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m))


def grow_forest(x: np.ndarray, seed: int) -> np.ndarray:
    """Isolation trees of each column of ``x`` (rows of one source, in natural limits), all grown at once, a level a
    step; the result is the mean path length of a value, per column, in CELLS steps from 0 to SPAN.

    A tree draws one feature (as with one feature per tree in a bagged forest) and PER_TREE of the readings inside
    the natural limit. A node is cut uniformly between its least reading and the end of its box, which at the root
    is SPAN: so cuts also fall into the empty room beyond the readings, and the farther a value lies in it, the
    sooner it is alone. Beyond the readings paths never grow with the value, whatever else a source holds.
    """
    rng = np.random.default_rng(seed)
    trees = x.shape[1] * TREES
    values = np.zeros((trees, PER_TREE))
    for c in range(x.shape[1]):
        inside = x[(x[:, c] <= 1) & (x[:, c] >= 0), c]
        if len(inside):
            values[c * TREES : (c + 1) * TREES] = inside[rng.integers(0, len(inside), (TREES, PER_TREE))]
    gap = 2 * SPAN
    keyed = np.sort(values, axis=1).ravel() + np.repeat(np.arange(trees) * gap, PER_TREE)
    tree, first, last = np.arange(trees), np.arange(trees) * PER_TREE, (np.arange(trees) + 1) * PER_TREE
    lo, hi = np.zeros(trees), np.full(trees, SPAN)
    leaves: list[tuple[np.ndarray, ...]] = []
    for depth in range(DEPTH + 1):
        n = last - first
        low = np.where(n > 0, keyed[np.minimum(first, len(keyed) - 1)] - tree * gap, hi)
        done = (n <= 1) | (depth == DEPTH) | (hi - low < 1e-6)
        leaves.append((tree[done] // TREES, lo[done], hi[done], depth + _average_path(n[done])))
        tree, first, last, lo, hi, low = (v[~done] for v in (tree, first, last, lo, hi, low))
        cut = low + rng.random(len(low)) * (hi - low)
        mid = np.searchsorted(keyed, cut + tree * gap, side="right")
        tree, first, last = np.concatenate([tree, tree]), np.concatenate([first, mid]), np.concatenate([mid, last])
        lo, hi = np.concatenate([lo, cut]), np.concatenate([cut, hi])
    column, lo, hi, path = (np.concatenate(v) for v in zip(*leaves))
    at = np.zeros((x.shape[1], CELLS + 1))
    cell = lambda v: np.ceil(np.minimum(v / SPAN * CELLS, CELLS)).astype(int)
    np.add.at(at, (column, cell(lo)), path)
    np.add.at(at, (column, cell(hi)), -path)
    return (np.cumsum(at, axis=1)[:, :CELLS] / TREES).astype(np.float32)


def forest_score(paths: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Isolation score of each value, by column: 2 to the minus its mean path length over that of a reading at the
    natural limit, so that this reading has SCORE in every source and column."""
    cell = np.clip(x / SPAN * CELLS, 0, CELLS - 1).astype(np.int32)
    limit = np.maximum(paths[:, int(CELLS / SPAN)], 1e-6)
    return np.exp2(-paths[np.arange(x.shape[1]), cell] / limit)


def _tail(low: float, high: float, share: float, power: int = 1) -> float:
    """Value that a ``share`` of the readings exceeds, from the 95 % and 99 % quantiles: the ``power`` of the value
    grows with minus the logarithm of the share (1: exponential tails, 2: normal ones)."""
    return (high**power + (high**power - low**power) * np.log(0.01 / min(share, 0.01)) / np.log(5.0)) ** (1 / power)


def natural_measures(r: dict) -> dict:
    """Units and natural limits of one source from its statistics (``s_`` fields)."""
    n = max(float(r["s_n"]), 1.0)
    close = r["s_log_close"]
    tick = PRICE_STEP / float(np.exp(0.0 if pd.isna(close) else close))
    m: dict = {"unit": {}, "limit": {}}
    step = 0.0 if pd.isna(r["s_step"]) else float(r["s_step"])
    near = max(float(r["s_d_close"][0]), 1e-12) if r["s_d_close"] is not None else 1e-12
    m["wider"] = float(np.clip((step + tick) / (near + tick), 1.0, 3.0))  # one neighbour instead of two sides
    for f in PRICES:
        q = r[f"s_d_{f}"]
        low, high = (float(q[0]), float(q[1])) if q is not None else (0.0, 0.0)
        unit = low + tick
        m["unit"][f] = unit
        m["limit"][f] = _tail(low / unit, max(high / unit, low / unit + LEAST_TAIL), CHANCE / n)
    v = r["s_volume"]
    lo, mid, hi, low, high = (float(y) for y in v) if v is not None else (0.0, 0.0, 2.0, 2.0, 3.0)
    wide = max((hi - lo) / 2, 0.05)
    m["mid"], m["wide"] = mid, wide
    m["limit"]["level"] = _tail(max(low - mid, wide) / wide, max(high - mid, 1.5 * wide) / wide, VOLUME_CHANCE / n, 2)
    season = np.full(SLOTS, mid)
    for slot, x in dict(r["s_season"] or {}).items():
        if x is not None and 0 <= slot < SLOTS:
            season[slot] = mid + (x["mid"] - mid) * x["n"] / (x["n"] + SEASON_ROWS)
    m["season"] = season
    runs = dict(r["s_limit"] or {})
    for i, f in enumerate(FIELDS):
        m["limit"]["run_" + f] = float(runs.get(i) or 6.0)
    return m


def _matrix(x: dict[str, np.ndarray], m: dict) -> np.ndarray:
    """The features in natural limits of the source: the limit is 1."""
    cols = []
    for f in PRICES:
        unit = m["unit"][f] * np.where(x["bits"] & END_BITS[f], m["wider"], 1.0)
        cols.append(np.abs(x["d_" + f]) / (unit * m["limit"][f]))
    level = (x["log_volume"] - m["mid"]) / m["wide"]
    season = (x["log_volume"] - m["season"][np.clip(x["slot"], 0, SLOTS - 1)]) / m["wide"]
    cols += [level / m["limit"]["level"], season / m["limit"]["level"]]
    cols += [x["run_" + f] / m["limit"]["run_" + f] for f in FIELDS]  # negative at the first of a run
    return np.clip(np.nan_to_num(np.stack(cols, axis=1), nan=0.0), 0.0, 1e6).astype(np.float32)


#: Bits of the reasons by column: 2 close, 4 ask, 8 bid, 16 volume, 32 stuck; 1 is physical.
_REASONS = np.array([2, 4, 8, 16, 16, 32, 32, 32, 32], np.int32)


def _judge(x: dict[str, np.ndarray], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Score of each reading, that of the feature that isolates it soonest, and the reasons: the features whose score
    is SCORE or more, and the physical limits."""
    s = forest_score(model["paths"], _matrix(x, model["measures"]))
    why = np.bitwise_or.reduce(np.where(s >= SCORE, _REASONS, 0), axis=1)
    return s.max(axis=1), (why | (x["bits"] & PHYSICAL)).astype(np.int32)


# the operator ----------------------------------------------------------------------------------------------------


def _statistics(features: DataFrame) -> DataFrame:
    """One row per source, of all its rows: quantiles of its deviations and volumes, run limits."""
    q = lambda c, *p: F.percentile_approx(c, F.array(*(F.lit(x) for x in p)) if len(p) > 1 else p[0], 1000)
    base = features.groupBy("source").agg(
        F.count("*").alias("n"),
        *(q(F.abs(f"d_{f}"), 0.95, 0.99).alias(f"d_{f}") for f in PRICES),
        q(F.when(~F.isnan("log_close"), F.col("log_close")), 0.5).alias("log_close"),
        q(F.abs("step"), 0.95).alias("step"),
        q(F.when(~F.isnan("log_volume"), F.col("log_volume")), 0.16, 0.5, 0.84, 0.95, 0.99).alias("volume"),
    )
    season = features.filter(F.col("log_volume").isNotNull() & ~F.isnan("log_volume")).groupBy("source", "slot").agg(F.struct(q("log_volume", 0.5).alias("mid"), F.count("*").alias("n")).alias("x"))
    season = season.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("slot", "x"))).alias("season"))  # at most SLOTS
    runs = features.select("source", F.explode(F.array(*(F.struct(F.lit(i).alias("field"), F.col(f"run_{f}").alias("run")) for i, f in enumerate(FIELDS)))).alias("r")).filter("r.run < 0")
    runs = runs.groupBy("source", F.col("r.field").alias("field"), (-F.col("r.run")).alias("run")).agg(F.count("*").alias("n"))
    tail = runs.groupBy("source", "field").agg(F.expr("percentile(run, array(0.9, 0.99), n)").alias("q"), F.sum("n").alias("n"), F.sum(F.col("run") * F.col("n")).alias("rows"))
    # From the 99 % quantile on natural runs thin out by a factor e every (q99 - q90) / ln 10 readings, and no faster
    # than the share of repeated readings says; the limit is where RUN_CHANCE of them are left in the whole source.
    fold = F.greatest((F.col("q")[1] - F.col("q")[0]) / float(np.log(10)), -1 / F.ln(F.greatest(1 - F.col("n") / F.col("rows"), F.lit(0.02))))
    limit = F.greatest(F.lit(6.0), F.col("q")[1] + fold * F.ln(F.greatest(F.col("n") * 0.01, F.lit(1.0)) / RUN_CHANCE))
    limits = tail.withColumn("limit", limit).groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("field", "limit"))).alias("limit"))  # four
    return base.join(season, "source", "left").join(limits, "source", "left")


def _train(rows: pd.DataFrame) -> pd.DataFrame:
    """The model of one source from its statistics and its bounded sample."""
    m = natural_measures(rows.iloc[0].to_dict())
    x = _matrix({c: rows[c].to_numpy() for c in rows.columns if not c.startswith("s_")}, m)
    source = int(rows["source"].iloc[0])
    return pd.DataFrame({"source": [source], "model": [pickle.dumps({"measures": m, "paths": grow_forest(x, source)})]})


def _models(features: DataFrame) -> DataFrame:
    stats = written(_statistics(features), "spike-statistics")
    slim = stats.select("source", F.col("n").alias("s_n"), *(F.col(c).alias(f"s_{c}") for c in stats.columns if c not in ("source", "n")))
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    sample = features.join(slim, "source").filter(share < TRAIN_ROWS / F.col("s_n"))
    return sample.groupBy("source").applyInPandas(_train, "source int, model binary").join(stats.select("source", "n"), "source")


_OUT = "source int, id long, score double, reasons int"


def _scored(t: pa.Table | pa.RecordBatch, model: dict) -> pa.RecordBatch:
    x = {k: t.column(k).to_numpy(zero_copy_only=False) for k in t.schema.names if k not in ("chunk",)}
    score, why = _judge(x, model)
    return pa.RecordBatch.from_arrays([pa.array(x["source"]), pa.array(x["id"]), pa.array(score.astype(float)), pa.array(why.astype(np.int32))], ["source", "id", "score", "reasons"])


def _score(features: DataFrame, models: DataFrame, broadcast_bytes: int) -> DataFrame:
    size = models.agg(F.sum(F.length("model"))).first()[0] or 0
    if size <= broadcast_bytes:
        known = features.sparkSession.sparkContext.broadcast({r["source"]: bytes(r["model"]) for r in models.select("source", "model").collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loaded: dict[int, dict] = {}
            for b in batches:
                s = b.column(0).to_numpy()
                ends = [*(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)]
                at = 0
                for end in ends if len(s) else []:
                    if s[at] not in loaded:
                        loaded = {s[at]: pickle.loads(known.value[int(s[at])])}  # rows come source by source
                    yield _scored(b.slice(at, end - at), loaded[s[at]])
                    at = end

        return features.mapInArrow(run, _OUT)
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    left = features.join(models.select("source", chunks.alias("chunks")), "source").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).drop("chunks")
    right = models.select("source", "model", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))

    def both(rows: pa.Table, model: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.Table.from_batches([], schema=pa.schema([("source", pa.int32()), ("id", pa.int64()), ("score", pa.float64()), ("reasons", pa.int32())]))
        return pa.Table.from_batches([_scored(rows.combine_chunks(), pickle.loads(model.column("model")[0].as_py()))])

    return left.groupBy("source", "chunk").cogroup(right.groupBy("source", "chunk")).applyInArrow(both, _OUT)


def implausible(ticks: DataFrame, source: Column, time: Column, ids: Column, close: Column, volume: Column, ask: Column, bid: Column, *, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(source, id, score, reasons) of every tick; ``reasons`` is 0 or the sum of 1 impossible in itself, 2, 4, 8
    close, ask or bid isolated from its neighbours, 16 volume isolated from the source's, 32 stuck.

    ``source`` is an integer. Ticks without source or time are held against the physical limits alone and have a
    null score. All others are judged by their source's forest: a reading whose score is SCORE or more has the reasons
    of the features that isolate it. Missing values (null, NaN) are never a reason. A row of the same time and values as one before it
    is a copy and shares its verdict. Empty input: no rows.

    A source's days are independent of each other and lie in different tasks; the statistics of a source are
    quantile sketches and counts that are merged, never its rows; its forest is grown from about TRAIN_ROWS of
    its rows. Forests are broadcast up to ``broadcast_bytes``, else each meets its source's rows in groups of
    about CHUNK.
    """
    t = ticks.select(source.cast("int").alias("source"), F.datediff(F.to_date(time), F.lit("1970-01-01").cast("date")).alias("day"), wall_micros(time).alias("us"), ids.cast("long").alias("id"), *(c.cast("double").alias(f) for c, f in zip((close, volume, ask, bid), FIELDS)))
    whole = F.col("source").isNotNull() & F.col("us").isNotNull()
    order = ["source", "day", "us", "id"]
    features = written(t.filter(whole).repartition("source", "day").sortWithinPartitions(*order).mapInArrow(_sequence_pass, _FEATURES), "spike-features")
    found = _score(features, written(_models(features), "spike-models"), broadcast_bytes)
    rest = t.filter(~whole).select("source", "id", F.lit(None).cast("double").alias("score"), impossible(*(F.col(f) for f in FIELDS)).cast("int").alias("reasons"))
    return found.unionByName(rest)
