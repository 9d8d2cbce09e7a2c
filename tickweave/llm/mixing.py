"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.llm import bpe
from tickweave.runtime import skew_join, written

#: Targets are a configuration table; it is refused above this size.
MAX_SOURCES = 10_000
STEPS, CLOSE, LONGEST = 60, 1e-9, 4.0
#: How gladly the length constraints give way: their relative fault is this times their dual.
SOFT = 0.02
#: Rows of one bucket in which the last copies of a length are picked, and buckets of one length.
BUCKET, BUCKETS = 256, 1 << 16


def source_name(c: Column) -> Column:
    """Plain lower case; null where nothing is left."""
    s = F.lower(F.regexp_replace(c.cast("string"), r"^\s+|\s+$", ""))
    return F.when(s != "", s)


def sized(docs: DataFrame, doc: Column, text: Column, source: Column, folder: str = bpe.TOKENIZERS) -> DataFrame:
    """(doc_id, source, n_tokens) of every document, counted by the public tokenizer; written, since it is read often."""
    return written(bpe.count_tokens(docs, [doc.alias("doc_id"), source_name(source).alias("source")], text, folder=folder), "sizes")


def _targets(targets: DataFrame) -> list:
    rows = targets.groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("most")).filter("source is not null and share > 0").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources to mix")
    return sorted(rows, key=lambda r: r["source"])


def _params(df: DataFrame, rows: list[tuple]) -> DataFrame:
    schema = T.StructType([T.StructField("source", T.StringType())] + [T.StructField(n, T.DoubleType()) for n in ("most", "alpha")])
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))  # a row per target, at most MAX_SOURCES


def _cap() -> Column:
    return F.ln(F.greatest("most", F.lit(1e-300)))


@dataclass
class Tilt:
    """Dual variables: one for each source, two for the length of documents; ``mid`` and ``wide`` scale the length."""

    alpha: dict[str, float]
    beta: tuple[float, float] = (0.0, 0.0)
    mid: float = 0.0
    wide: float = 1.0
    steps: int = 0
    fault: float = 0.0

    def length(self) -> tuple[Column, Column]:
        """Features of a document's length: the scaled logarithm and its square, less their means in the corpus."""
        z = (F.ln(F.col("n_tokens")) - self.mid) / self.wide
        return z, z * z - 1

    def exponent(self) -> Column:
        z1, z2 = self.length()
        return F.col("alpha") + self.beta[0] * z1 + self.beta[1] * z2

    def rate(self) -> Column:
        """Copies of a document: one, tilted exponentially by its source and its length, at most ``most``."""
        return F.exp(F.least(self.exponent(), _cap()))


def balance(hist: DataFrame, most: dict[str, float], tokens: dict[str, float], goal: dict[str, float]) -> Tilt:
    """Entropy balancing: of all rates of documents between 0 and ``most`` the ones nearest, in relative entropy by
    token, to one copy of each, under two kinds of token constraints in one dual. The tokens of each source come to
    its ``goal``, and the length of documents is spread over the tokens of the mix (mean and variance of its
    logarithm) as over those of the corpus, whichever sources the goals favour. The second kind gives way by SOFT,
    so that there is a solution where the sources that are favoured have no other lengths.

    Each Newton step takes one distributed pass over the histogram (source, n_tokens, n): value, gradient and Hessian
    of the dual are sums per source. The Hessian is an arrow (sources meet only in the two length duals), so a step
    costs the driver a few numbers per source. A step that makes the dual worse is halved.
    """
    total = sum(goal.values())
    t = F.col("n_tokens") * F.col("n")
    m = hist.agg(F.sum(t).alias("t"), F.sum(t * F.ln("n_tokens")).alias("a"), F.sum(t * F.ln("n_tokens") ** 2).alias("b")).first()
    if not m["t"] or not total:
        return Tilt({s: -1e6 for s in goal})
    mid = m["a"] / m["t"]
    tilt = Tilt({}, mid=mid, wide=math.sqrt(max(m["b"] / m["t"] - mid**2, 0.0)) or 1.0)
    full = {s for s in goal if goal[s] >= most[s] * tokens[s] * (1 - 1e-12)}
    none = {s for s in goal if goal[s] <= 0}
    free = sorted(set(goal) - full - none)
    fixed = {s: 1e6 for s in full} | {s: -1e6 for s in none}
    x = np.array([math.log(goal[s] / tokens[s]) for s in free] + [0.0, 0.0])
    want = np.array([goal[s] for s in free])
    now: tuple | None = None
    step = np.zeros_like(x)
    for tilt.steps in range(STEPS):
        tilt.alpha, tilt.beta = dict(zip(free, x[:-2].tolist())) | fixed, (float(x[-2]), float(x[-1]))
        f = _dual(hist, tilt, most, free, x, want, total)
        if now is not None and f[0] > now[0] + 1e-12 * total and np.abs(step).max() > 1e-9:
            step = step / 2
            x = now[3] + step
            continue
        now = (*f, x)
        tilt.fault = float(max(np.abs(f[1][:-2] / want).max(initial=0.0), np.abs(f[1][-2:]).max() / total))
        if tilt.fault < CLOSE:
            break
        step = -_arrow(f[2], f[1], min(1e-2, tilt.fault) * want)
        step *= min(1.0, LONGEST / max(np.abs(step).max(), 1e-300))
        x = x + step
    tilt.alpha, tilt.beta = dict(zip(free, now[3][:-2].tolist())) | fixed, (float(now[3][-2]), float(now[3][-1]))
    return tilt


def _dual(hist: DataFrame, tilt: Tilt, most: dict[str, float], free: list[str], x: np.ndarray, want: np.ndarray, total: float) -> tuple[float, np.ndarray, tuple]:
    """Value and gradient of the dual, and its Hessian as (diagonal of sources, sources by lengths, lengths)."""
    r, t = F.col("r"), F.col("n_tokens") * F.col("n")
    z1, z2 = tilt.length()
    y = hist.join(_params(hist, [(s, most[s], a) for s, a in tilt.alpha.items()]), "source").select(
        "source", t.alias("t"), z1.alias("z1"), z2.alias("z2"), tilt.rate().alias("r"), tilt.exponent().alias("e"), _cap().alias("cap"), "most"
    )
    moving = F.when(F.col("e") < F.col("cap"), F.col("t") * r).otherwise(0.0)
    value = F.when(F.col("e") < F.col("cap"), r).otherwise(F.col("most") * (1 + F.col("e") - F.col("cap")))
    a, b = F.col("z1"), F.col("z2")
    sums = y.groupBy("source").agg(
        F.sum(F.col("t") * value).alias("f"), *(F.sum(F.col("t") * r * w).alias(n) for n, w in (("g0", F.lit(1.0)), ("g1", a), ("g2", b))),
        *(F.sum(moving * w).alias(n) for n, w in (("h0", F.lit(1.0)), ("h1", a), ("h2", b), ("h11", a * a), ("h12", a * b), ("h22", b * b))),
    )
    rows = {v["source"]: v for v in sums.collect()}  # a row per target
    at = [rows[s] for s in free]
    beta = x[-2:]
    g = np.array([v["g0"] for v in at] + [sum(v[n] for v in rows.values()) for n in ("g1", "g2")])
    g[:-2] -= want
    g[-2:] += SOFT * total * beta
    f = sum(rows[s]["f"] for s in free) - float(want @ x[:-2]) + SOFT * total / 2 * float(beta @ beta)
    f += sum(beta[0] * v["g1"] + beta[1] * v["g2"] for s, v in rows.items() if s not in free)  # full sources stay as they are
    d = np.array([v["h0"] for v in at])
    e = np.array([[v["h1"], v["h2"]] for v in at]).reshape(-1, 2)
    h = [sum(v[n] for v in at) for n in ("h11", "h12", "h22")]
    return f, g, (d, e, np.array([[h[0], h[1]], [h[1], h[2]]]) + SOFT * total * np.eye(2))


def _arrow(hessian: tuple, g: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Solution of the Newton system by the complement of the sources' diagonal. ``more`` goes on the diagonal: where
    all documents of a source are at their most, its own is 0."""
    d, e, c = hessian
    d = d + more + 1e-300
    w = e / d[:, None]
    low = np.linalg.solve(c - e.T @ w, g[-2:] - w.T @ g[:-2])
    return np.concatenate([g[:-2] / d - w @ low, low])


def _copies(cells: pd.DataFrame) -> pd.DataFrame:
    """Whole copies of all documents of one source, length by length from the longest: what rounding leaves of a
    length's tokens is carried to the next shorter one, so in the end the source misses its goal by less than its
    shortest documents. Rows are lengths, not documents."""
    c = cells.sort_values("n_tokens", ascending=False)
    out = np.zeros(len(c), np.int64)
    carry = 0.0
    for i, (t, n, r, most) in enumerate(zip(c["n_tokens"].tolist(), c["n"].tolist(), c["r"].tolist(), c["most"].tolist())):
        carry += t * n * r
        out[i] = min(max(round(carry / t), 0), int(n * most))
        carry -= t * int(out[i])
    return pd.DataFrame({"source": c["source"], "n_tokens": c["n_tokens"], "n": c["n"], "base": out // c["n"].to_numpy(), "extra": out % c["n"].to_numpy()})


def rounded(used: DataFrame, hist: DataFrame, tilt: Tilt, most: dict[str, float]) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of 1 or more. Documents of one source and length have one rate; the copies
    beyond the whole ones go to those of the least hash. The hashes of a length are counted in buckets, and only the
    bucket in which the last copies fall is ordered."""
    rates = hist.join(_params(hist, [(s, most[s], a) for s, a in tilt.alpha.items()]), "source").withColumn("r", tilt.rate()).select("source", "n_tokens", "n", "r", "most")
    cells = written(rates.groupBy("source").applyInPandas(_copies, "source string, n_tokens long, n long, base long, extra long"), "copies")
    key = ["source", "n_tokens"]
    buckets = F.least(F.greatest(F.col("n") / BUCKET, F.lit(1)), F.lit(BUCKETS)).cast("int")
    bucket = F.floor(F.col("pick") * F.col("buckets")).cast("int")
    x = skew_join(used, cells.withColumn("buckets", buckets), key, "n").withColumn("bucket", bucket)
    x = written(x.select("doc_id", *key, "pick", "n", "base", "extra", "bucket"), "picks")
    order = W.partitionBy(*key).orderBy("bucket")
    full = x.filter("extra > 0").groupBy(*key, "bucket").agg(F.count("*").alias("m"), F.first("extra").alias("extra"), F.first("n").alias("n"))
    edge = full.withColumn("upto", F.sum("m").over(order)).filter("upto >= extra and upto - m < extra").selectExpr(*key, "n", "bucket as edge", "extra - (upto - m) as rest")
    y = skew_join(x.filter("extra > 0").drop("n"), written(edge, "edges"), key, "n")
    sure = y.filter("bucket != edge").withColumn("copies", F.col("base") + (F.col("bucket") < F.col("edge")).cast("long"))
    last = y.filter("bucket = edge").withColumn("place", F.row_number().over(W.partitionBy(*key, "bucket").orderBy("pick"))).withColumn("copies", F.col("base") + (F.col("place") <= F.col("rest")).cast("long"))
    even = x.filter("extra = 0").withColumn("copies", F.col("base"))
    out = ["doc_id", *key, F.col("copies").cast("int").alias("copies")]
    return even.select(*out).unionByName(sure.select(*out)).unionByName(last.select(*out)).filter("copies > 0")


def mix(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None, exact_shares: bool = False, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The chosen documents (doc_id, source, n_tokens, copies of 1 or more), and per target source the shares
    (source, target_share, max_repeats, n_docs, n_tokens, wanted_tokens, used_tokens, actual_share, capped).

    ``sizes`` as from ``sized``; ``targets`` has source, target_share and max_repeats. The whole is
    ``total_tokens``, by default the tokens of all documents of the listed sources; with ``exact_shares`` it is
    the largest at which every source that has documents reaches its share. A source gets its share of the whole,
    or all it has max_repeats times where that is less. Null and unlisted sources and documents without a
    token are not used; a listed source without documents reports 0. Repeated doc_ids are documents of their own.

    Rates come from ``balance``, whole copies from ``rounded``.
    """
    spark = sizes.sparkSession
    want = _targets(targets)
    names = [r["source"] for r in want]
    pick = (F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id(), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    used = written(sizes.filter(F.col("source").isin(names) & (F.col("n_tokens") > 0)).select("doc_id", "source", F.col("n_tokens").cast("long").alias("n_tokens"), pick.alias("pick")), "used")
    hist = written(used.groupBy("source", "n_tokens").agg(F.count("*").alias("n")), "lengths")
    have = {r["source"]: r for r in hist.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("n_tokens")).alias("tokens")).collect()}
    share = {r["source"]: r["share"] for r in want}
    most = {r["source"]: float(max(0, r["most"] or 0)) for r in want}
    whole = float(total_tokens if total_tokens is not None else sum(r["tokens"] for r in have.values()))
    if exact_shares and have:
        whole = min([whole * max(most.values(), default=1) / min(share.values()), *(most[s] * r["tokens"] / share[s] for s, r in have.items() if most[s] > 0)])
    goal = {s: min(share[s] * whole, most[s] * r["tokens"]) for s, r in have.items()}
    tilt = balance(hist, most, {s: float(r["tokens"]) for s, r in have.items()}, goal)
    chosen = rounded(used, hist, tilt, most)
    facts = spark.createDataFrame([(s, share[s], int(most[s]), int(have[s]["docs"]) if s in have else 0, int(have[s]["tokens"]) if s in have else 0, share[s] * whole) for s in names], "source string, target_share double, max_repeats int, n_docs long, n_tokens long, wanted_tokens double")
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"))
    total = got.agg(F.sum("used_tokens").alias("all"))
    report = facts.join(got, "source", "left").crossJoin(F.broadcast(total)).select(  # total is one row
        "source", "target_share", "max_repeats", "n_docs", "n_tokens", "wanted_tokens", F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"),
        F.coalesce(F.col("used_tokens") / F.col("all"), F.lit(0.0)).alias("actual_share"), (F.col("wanted_tokens") > F.col("max_repeats") * F.col("n_tokens") + 0.5).alias("capped"),
    )
    return chosen, report
