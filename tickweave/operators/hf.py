"""Helpers of the second dialect (high-frequency proxies). Every helper ends finite: null, NaN and infinities become
0 (ranks 0.5), a quotient by 0 is 0, and exponential averages are recursive (adjust=False)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweave.operators.expr import Panel, corr, ewm_stage, numeric, rank_share

INF = float("inf")


def z0(x: Column) -> Column:
    x = x.cast("double")
    return F.coalesce(F.when(~F.isnan(x) & (F.abs(x) != INF), x), F.lit(0.0))


def num(df: DataFrame, name: str) -> Column:
    return numeric(name) if name in df.columns else F.lit(None).cast("double")


def sum_cols(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def safe_div(a: Column, b: Column) -> Column:
    return z0(F.try_divide(a, b))


class Rolling:
    """The windowed helpers over one panel."""

    def __init__(self, panel: Panel = Panel()):
        self.p = panel

    def w(self, n: int, least: int = 1):
        return self.p.rows(max(least, int(n)))

    def upto(self):
        return self.p.ordered().rowsBetween(W.unboundedPreceding, 0)

    def lag(self, x: Column, k: int) -> Column:
        if k <= 0:
            raise ValueError("a shift must look back")
        return F.lag(x, k).over(self.p.ordered())

    def mean(self, x, n):
        return F.avg(x).over(self.w(n))

    def sum(self, x, n):
        return F.sum(x).over(self.w(n))

    integral = sum

    def std(self, x, n):
        return z0(F.stddev_samp(x).over(self.w(n, 2)))

    def cov(self, x, y, n):
        ok = x.isNotNull() & y.isNotNull()
        return z0(F.covar_samp(F.when(ok, x), F.when(ok, y)).over(self.w(n, 2)))

    def corr(self, x, y, n):
        return z0(corr(x, y, self.w(n, 2)))

    def conditional_mean(self, t, c, n):
        high = F.when(c > F.avg(c).over(self.w(n)), t)
        return z0(F.coalesce(F.avg(high).over(self.w(n)), F.avg(t).over(self.w(n))))

    def beta(self, t, b, n):
        return z0(self.cov(t, b, n) / (F.pow(self.std(b, n), 2) + 1e-6))

    def coherence(self, x, n):
        return F.avg(z0(F.signum(x))).over(self.w(n))

    def path_ratio(self, x, n):
        moved = z0(F.abs(x - self.lag(x, max(1, n))))
        return safe_div(moved, F.abs(F.sum(F.abs(self.diff(x, 1))).over(self.w(n))) + 1e-6)

    def min(self, x, n):
        return z0(F.min(x).over(self.w(n)))

    def max(self, x, n):
        return z0(F.max(x).over(self.w(n)))

    def median(self, x, n):
        return z0(F.percentile(x, 0.5).over(self.w(n)))

    def quantile(self, x, n, q):
        return z0(F.percentile(x, min(1.0, max(0.0, float(q)))).over(self.w(n)))

    def skew(self, x, n):
        return z0(adjusted_skewness(x, self.w(n, 3)))

    def expanding(self, x, how):
        return z0({"mean": F.avg, "min": F.min, "max": F.max}[how](x).over(self.upto()))

    def cumsum(self, x):
        return z0(F.when(x.isNotNull(), F.sum(x).over(self.upto())))

    def rank(self, x):
        return F.coalesce(rank_share(x, self.p), F.lit(0.5))

    def shift(self, x, k):
        return z0(self.lag(x, k))

    def diff(self, x, k):
        return z0(x - self.lag(x, max(1, k)))

    def pct_change(self, x, k):
        f = F.last(x, ignorenulls=True).over(self.upto())
        return z0(F.try_divide(f, self.lag(f, k)) - 1)

    def first(self, x):
        whole = self.p.ordered().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        return F.first(x, ignorenulls=True).over(whole)

    def session_open(self, df):
        first = self.first(num(df, "close"))
        return z0(F.coalesce(F.when(num(df, "daily_open") > 0, num(df, "daily_open")), first))

    def zscore(self, x, n):
        return z0(F.try_divide(x - F.avg(x).over(self.w(n)), F.stddev_samp(x).over(self.w(n, 2))))

    def mid_log_return(self, df):
        last = num(df, "last_close")
        base = F.when(last > 0, last).otherwise(self.lag(num(df, "close"), 1))
        return log(safe_div(mid_price(df), base))

    def volume_weighted(self, x, v, n):
        return safe_div(self.sum(x * v, n), self.sum(v, n) + 1e-6)

    def prepared(self, df, d):
        """``df`` with the changes that vector_zdistance and noise_trace take their windows over, each computed once
        instead of once for every window over it."""
        full = safe_div(depth(df, "bid", d) + depth(df, "ask", d), num(df, "volume") + 1e-6)
        cols = {f"__change_{s}P{i}": self.diff(num(df, f"{s}P{i}"), 1) for i in range(1, d + 1) for s in ("bid", "ask")}
        cols |= {"__mid_return": self.mid_log_return(df), "__change_spread": self.diff(spread(df), 1), "__change_imbalance": self.diff(book_imbalance(df, d), 1), "__change_depth": self.diff(full, 1)}
        return df.withColumns(cols)

    def vector_zdistance(self, df, d, n):
        """``df`` from ``prepared``."""
        parts = [F.pow(self.zscore(x, n), 2) for i in range(1, d + 1) for x in (num(df, f"bidV{i}"), num(df, f"askV{i}"), F.col(f"__change_bidP{i}"), F.col(f"__change_askP{i}"))]
        return z0(F.sqrt(reduce(lambda a, b: a + b, parts)))

    def noise_trace(self, df, n):
        """``df`` from ``prepared``."""
        parts = ("__mid_return", "__change_spread", "__change_imbalance", "__change_depth")
        return z0(reduce(lambda a, b: a + b, (F.pow(self.std(F.col(x), n), 2) for x in parts)))


def adjusted_skewness(x: Column, w) -> Column:
    """Sample-adjusted skewness from three values on; 0 where they are all equal."""
    n = F.count(x).over(w)
    g = F.when(F.stddev_samp(x).over(w) > 0, F.skewness(x).over(w) * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0)
    return F.when(n >= 3, g)


def adjusted_kurtosis(x: Column, w) -> Column:
    """Sample-adjusted excess kurtosis from four values on; 0 where they are all equal."""
    n = F.count(x).over(w).cast("double")
    g = F.when(F.stddev_samp(x).over(w) > 0, ((n + 1) * F.kurtosis(x).over(w) + 6) * (n - 1) / ((n - 2) * (n - 3))).otherwise(0.0)
    return F.when(n >= 4, g)


sign, absolute = (lambda x: z0(F.signum(x))), (lambda x: z0(F.abs(x)))
sqrt, exp, log = (lambda x: z0(F.sqrt(F.greatest(x, F.lit(0.0))))), (lambda x: z0(F.exp(F.least(x, F.lit(20.0))))), (lambda x: z0(F.ln(F.greatest(x, F.lit(1e-12)))))


def clip(x: Column, lo: float, hi: float) -> Column:
    return z0(F.when(x.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))))


def where(c: Column, a: Column, b: Column) -> Column:
    """A null condition is false here, unlike in the first dialect."""
    return z0(F.when(F.coalesce(c, F.lit(False)), a).otherwise(b))


def mid_price(df: DataFrame) -> Column:
    return (num(df, "askP1") + num(df, "bidP1")) / 2


def spread(df: DataFrame) -> Column:
    return safe_div(num(df, "askP1") - num(df, "bidP1"), mid_price(df) + 1e-6)


def depth(df: DataFrame, side: str, d: int) -> Column:
    return sum_cols([num(df, f"{side}V{i}") for i in range(1, d + 1)])


def book_imbalance(df: DataFrame, d: int) -> Column:
    a, b = depth(df, "ask", d), depth(df, "bid", d)
    return safe_div(b - a, b + a + 1e-6)


def lob_pressure(df: DataFrame, d: int, alpha: float) -> Column:
    """Bid less ask sizes, each less by its distance from the best price in spreads, as a share of their sum."""
    gap = F.abs(num(df, "askP1") - num(df, "bidP1"))
    unit = F.when(gap.isNotNull(), F.greatest(gap, F.lit(1e-6)))

    def side(s: str) -> Column:
        far = lambda i: F.abs(num(df, f"{s}P{i}") - num(df, f"{s}P1")) / unit
        return sum_cols([safe_div(num(df, f"{s}V{i}"), 1 + max(0.0, alpha) * far(i)) for i in range(1, max(1, min(10, d)) + 1)])

    bid, ask = side("bid"), side("ask")
    return safe_div(bid - ask, bid + ask + 1e-6)


def space_decay(levels: Sequence[Column], alpha: float) -> Column:
    """Levels weighted by exp(-alpha i), as a share of the weighted sizes."""
    import math

    w = [math.exp(-max(0.0, alpha) * i) for i in range(len(levels))]
    return safe_div(sum_cols([x * k for x, k in zip(levels, w)]), sum_cols([F.abs(x) * k for x, k in zip(levels, w)]) + 1e-6)


def cost_adjusted_score(signal: Column, volatility: Column, cost: Column) -> Column:
    return safe_div(signal, F.abs(volatility) + F.abs(cost) + 1e-6)


def no_trade_band_distance(signal: Column, cost: Column, volatility: Column) -> Column:
    return F.greatest(F.abs(signal) - F.abs(cost) - 0.5 * F.abs(volatility), F.lit(0.0)) * F.signum(signal)


def decays(df: DataFrame, jobs: Sequence[tuple[str, str, float]], panel: Panel = Panel()) -> DataFrame:
    """Add recursive exponential averages: (new column, source column, half-life). An ``ewma`` of weight a has the
    half-life ln 0.5 / ln(1 - a); the decayed interaction of two columns is the average of their product."""
    out = ewm_stage(df, panel, [(o, "ewm_mean", s, h) for o, s, h in jobs], adjust=False)
    return out.withColumns({o: z0(F.col(o)) for o, *_ in jobs})


def half_life(alpha: float) -> float:
    import math

    a = min(1.0, max(1e-6, alpha))
    return 1e-9 if a == 1.0 else math.log(0.5) / math.log(1 - a)


def variants(name: str, x: Column, panel: Panel = Panel(), rolls: Sequence[int] = (5, 20), zs: Sequence[int] = (20,)) -> dict[str, Column]:
    """A factor's columns for one select: base, flipped, rolling means, rolling z-scores and normalised forms."""
    r = Rolling(panel)
    out = {name: z0(x), f"{name}_flip": z0(-x)}
    out |= {f"{name}_roll{n}": r.mean(x, n) for n in rolls}
    out |= {f"{name}_z{n}": r.zscore(x, n) for n in zs}
    out |= {f"{name}_norm{n}": safe_div(x, r.std(x, n)) for n in rolls}
    return out
