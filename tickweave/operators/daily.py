"""Daily returns: features, labels and cross-sectional evaluation."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweave.operators.expr import corr
from tickweave.operators.hf import adjusted_kurtosis, adjusted_skewness

KEYS = ("date", "ticker", "ticker_ord")


def unpivot(wide: DataFrame, date: str = "date") -> DataFrame:
    """Long returns of a wide matrix: date, ticker, ticker_ord (place of the column), ret; NaN is null."""
    names = [c for c in wide.columns if c != date]
    long = wide.unpivot(date, names, "ticker", "ret").withColumn("ret", F.col("ret").try_cast("double"))
    order = F.array_position(F.array(*map(F.lit, names)), F.col("ticker")) - 1
    return long.select(F.col(date).alias("date"), "ticker", order.cast("int").alias("ticker_ord"), F.when(~F.isnan("ret"), F.col("ret")).alias("ret"))


def repeated_dates(wide: DataFrame, date: str = "date") -> DataFrame:
    """Dates that a wide matrix holds more than once; it should hold none."""
    return wide.groupBy(date).agg(F.count("*").alias("n")).filter("n > 1")


def sanitize(r: DataFrame, largest: float = 1.0) -> DataFrame:
    """Infinite and larger returns are null; zeros stay."""
    if not 0 < largest <= 10:
        raise ValueError("the largest return must be in (0, 10]")
    return r.withColumn("ret", F.when(F.abs("ret") <= largest, F.col("ret")))


def _least(x: Column, w, least: int, value: Column) -> Column:
    return F.when(F.count(x).over(w) >= least, value)


def feature(r: DataFrame, operator: str, window: int, least: int | None = None) -> DataFrame:
    """``r`` with a column ``feature``: a trailing statistic of each ticker's returns with at least ``least`` of them."""
    return features(r, [operator], window, least).withColumnRenamed(operator, "feature")


def features(r: DataFrame, operators: Sequence[str], window: int, least: int | None = None) -> DataFrame:
    """``r`` with a column of each operator, all from one pass over each ticker's days.

    A day without a return counts as a return of zero in downside_volatility. The residual takes the
    cross-section's mean off first, which is a second shuffle, by date."""
    least = window if least is None else least
    if not 2 <= least <= window:
        raise ValueError("2 <= least <= window")
    own = W.partitionBy("ticker").orderBy("date")
    w, x = own.rowsBetween(-(window - 1), 0), F.col("ret")
    if "market_residual_momentum" in operators:
        r = r.withColumn("__rest", x - F.avg(x).over(W.partitionBy("date")))
    r = r.withColumn("__before", F.lag(x, 1).over(own))
    before, rest = F.col("__before"), F.col("__rest")
    pairs = F.when(x.isNotNull() & before.isNotNull(), x)
    down = F.pow(F.when(x < 0, x).otherwise(0.0), 2)
    forms: dict[str, Callable[[], Column]] = {
        "momentum_sum": lambda: _least(x, w, least, F.sum(x).over(w)), "reversal_sum": lambda: _least(x, w, least, -F.sum(x).over(w)), "mean_return": lambda: _least(x, w, least, F.avg(x).over(w)),
        "volatility": lambda: _least(x, w, least, F.stddev_samp(x).over(w)), "downside_volatility": lambda: _least(F.lit(1), w, least, F.sqrt(F.avg(down).over(w))), "skewness": lambda: _least(x, w, least, adjusted_skewness(x, w)),
        "kurtosis": lambda: _least(x, w, least, adjusted_kurtosis(x, w)), "max_return": lambda: _least(x, w, least, F.max(x).over(w)), "min_return": lambda: _least(x, w, least, F.min(x).over(w)),
        "autocorrelation_lag1": lambda: _least(pairs, w, least, corr(x, before, w)), "market_residual_momentum": lambda: _least(rest, w, least, F.sum(rest).over(w)),
    }
    for name in operators:
        if name not in forms:
            raise ValueError(f"unknown feature: {name}")
    return r.withColumns({name: forms[name]() for name in operators}).drop("__rest", "__before")


def forward_label(r: DataFrame, horizon: int) -> DataFrame:
    """``r`` with ``label``: the compound return of the next ``horizon`` days; null if one of them is missing."""
    own = W.partitionBy("ticker").orderBy("date")
    x = F.lit(1.0)
    for i in range(1, horizon + 1):
        x = x * (1 + F.lead("ret", i).over(own))
    return r.withColumn("label", x - 1)


def between(r: DataFrame, first: str, last: str) -> DataFrame:
    """Days in a closed range; taken after features and labels, which need the margins."""
    if first > last:
        raise ValueError("the range is reversed")
    return r.filter(F.col("date").between(first, last))


def rank_ic(r: DataFrame, least: int = 2) -> DataFrame:
    """(date, rank_ic, n): correlation of the average ranks of feature and label in each day's complete pairs.
    Days with fewer than ``least`` pairs or a constant side are left out."""
    x = r.filter(F.col("feature").isNotNull() & F.col("label").isNotNull())
    day = W.partitionBy("date")
    rank = lambda c: F.rank().over(day.orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy("date", c)) - 1) / 2
    x = x.select("date", rank("feature").alias("f"), rank("label").alias("l"))
    # Ranks are halves, so these sums are exact, and what does not correlate has 0 and not a trace of rounding.
    part = lambda a, b: F.count("*") * F.sum(F.col(a) * F.col(b)) - F.sum(a) * F.sum(b)
    ic = F.try_divide(part("f", "l"), F.sqrt(part("f", "f")) * F.sqrt(part("l", "l")))
    return x.groupBy("date").agg(ic.alias("rank_ic"), F.count("*").alias("n")).filter((F.col("n") >= least) & F.col("rank_ic").isNotNull())


def quantile_spread(r: DataFrame, least: int = 2, top: float = 0.8, bottom: float = 0.2) -> DataFrame:
    """(date, spread): mean label of the upper fifth of the feature less that of the lower; ties in order of the
    tickers' places."""
    x = r.filter(F.col("feature").isNotNull() & F.col("label").isNotNull())
    day = W.partitionBy("date")
    share = F.row_number().over(day.orderBy("feature", "ticker_ord")) / F.count(F.lit(1)).over(day)
    x = x.select("date", "label", share.alias("share"))
    d = F.avg(F.when(F.col("share") > top, F.col("label"))) - F.avg(F.when(F.col("share") <= bottom, F.col("label")))
    return x.groupBy("date").agg(d.alias("spread"), F.count("*").alias("n")).filter((F.col("n") >= least) & F.col("spread").isNotNull()).drop("n")


def evaluate(r: DataFrame, least: int = 2) -> DataFrame:
    """One row: mean, deviation, ICIR and positive share of the daily rank IC, mean spread, finite share, counts.
    The direction of a factor flips nothing."""
    ic, spread = rank_ic(r, least), quantile_spread(r, least)
    both = F.col("feature").isNotNull() & F.col("label").isNotNull()
    a = ic.agg(F.avg("rank_ic").alias("mean_ic"), F.stddev_samp("rank_ic").alias("std_ic"), F.avg((F.col("rank_ic") > 0).cast("double")).alias("positive_ratio"), F.count("*").alias("n_days"))
    b = spread.agg(F.avg("spread").alias("qspread_mean"))
    c = r.agg(F.try_divide(F.count_if(both).cast("double"), F.count("label")).alias("finite_ratio"), F.count_if(both).alias("n_obs"))
    x = a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))  # one row each
    return x.withColumn("icir", F.try_divide("mean_ic", "std_ic"))


def axis_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Days and tickers that one of two long matrices lacks; aligned ones have none."""
    k = ["date", "ticker"]
    return a.select(*k).exceptAll(b.select(*k)).withColumn("only_in", F.lit("a")).unionByName(b.select(*k).exceptAll(a.select(*k)).withColumn("only_in", F.lit("b")))


@dataclass(frozen=True)
class ExperimentSpec:
    """A registered experiment; its id is a hash of everything that it says."""

    operator: str
    window: int
    horizon: int
    first: str
    last: str
    segment: str = "discovery"
    direction: str = "unknown"
    max_abs_return: float = 1.0

    def __post_init__(self) -> None:
        if self.window < 2 or self.horizon < 1 or self.first > self.last:
            raise ValueError("window >= 2, horizon >= 1 and first <= last")

    @property
    def id(self) -> str:
        text = json.dumps(asdict(self), sort_keys=True, separators=(",", ":"))
        return "exp_" + hashlib.sha256(text.encode()).hexdigest()[:32]

    def run(self, r: DataFrame, locked: bool = False) -> DataFrame:
        if self.segment == "locked_test" and not locked:
            raise PermissionError("the locked test segment needs an explicit flag")
        x = forward_label(feature(sanitize(r, self.max_abs_return), self.operator, self.window), self.horizon)
        return evaluate(between(x, self.first, self.last)).withColumn("experiment_id", F.lit(self.id))
