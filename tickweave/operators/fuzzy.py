"""Join of texts by difflib's ratio that loses no pair."""

from __future__ import annotations

import difflib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

BLOCK_ROWS = 2048
_LETTERS, _PAIRS = 40, 256  # classes of letters and of pairs of letters; a shared class only weakens the bounds


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(t) for t in texts])
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), n)
    own = row[1:] == row[:-1]
    one = np.bincount(row * _LETTERS + code % _LETTERS, minlength=len(texts) * _LETTERS)
    two = np.bincount((row[1:] * _PAIRS + (code[:-1] * 31 + code[1:]) % _PAIRS)[own], minlength=len(texts) * _PAIRS)
    return one.reshape(-1, _LETTERS), two.reshape(-1, _PAIRS)


def _steps(m: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Counts as ones up to the count, so that a product of two rows is the sum of the smaller counts."""
    return np.concatenate([m[:, c : c + 1] > np.arange(top[c]) for c in range(m.shape[1])], axis=1).astype(np.float32)


def _survivors(t: list[str], u: list[str], least: float) -> tuple[np.ndarray, np.ndarray]:
    (x1, x2), (y1, y2) = _counts(t), _counts(u)
    la, lb = (np.array([len(s) for s in v], float) for v in (t, u))
    top = np.minimum(x1.max(axis=0), y1.max(axis=0))
    common = _steps(np.minimum(x1, top), top) @ _steps(np.minimum(y1, top), top).T
    i, j = np.nonzero(common >= (least / 2 * la[:, None] + least / 2 * lb[None, :] - 0.01).astype(np.float32))
    keep = [np.zeros(0, bool)]
    for s in range(0, len(i), 65536):
        p, q = i[s : s + 65536], j[s : s + 65536]
        m = least / 2 * (la[p] + lb[q])
        keep.append(np.minimum(x2[p], y2[q]).sum(axis=1) >= la[p] - 1 - 2 * (la[p] - m) - (lb[q] - m) - 0.01)
    k = np.concatenate(keep)
    return i[k], j[k]


def fuzzy_pairs(a: DataFrame, b: DataFrame, least: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a_id, b_id, ratio) of all texts of ``a`` and ``b`` (id, text; text not null) at a ratio of ``least`` or more.

    At a ratio of ``least`` the lengths differ by a factor of (2 - least) / least at most, the texts have
    least (|a| + |b|) / 2 letters in common (a bound that is a matrix product), and each letter that is unmatched
    spoils at most two pairs of neighbours. Only texts in near bands of length meet, in blocks, and what passes these
    bounds is left to difflib. Two empty texts are a pair."""
    if not 0 < least < 1:
        raise ValueError("a ratio between 0 and 1")
    kinds = [d.schema["id"].dataType.simpleString() for d in (a, b)]
    ta, tb = (to_arrow_type(d.schema["id"].dataType) for d in (a, b))
    width = math.log((2 - least) / least) * (1 + 1e-9)
    na, nb = (max(1, -(-d.count() // block_rows)) for d in (a, b))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    band = F.floor(F.ln(F.length("text")) / width)
    x = a.filter("text != ''").select(F.col("id").alias("a_id"), F.col("text").alias("t"), band.alias("own"), part(na).alias("i")).select("*", every(nb).alias("j")).select("*", F.explode(F.sequence(F.col("own") - 1, F.col("own") + 1)).alias("band")).drop("own")
    y = b.filter("text != ''").select(F.col("id").alias("b_id"), F.col("text").alias("u"), band.alias("bb"), part(nb).alias("bj")).select("*", every(na).alias("bi"))

    def meet(l: pa.Table, r: pa.Table) -> pa.Table:
        out = ([], [], [])
        if l.num_rows and r.num_rows:
            (p, t), (q, u) = ([c.to_pylist() for c in (z.column(0), z.column(1))] for z in (l.select(["a_id", "t"]), r.select(["b_id", "u"])))
            for i, j in zip(*_survivors(t, u, least)):
                m = difflib.SequenceMatcher(None, t[i], u[j])
                if m.real_quick_ratio() >= least and m.quick_ratio() >= least and (w := m.ratio()) >= least:
                    for o, v in zip(out, (p[i], q[j], w)):
                        o.append(v)
        none = pa.array([], pa.null())
        ids = [pa.array(o) if o else none for o in out[:2]]
        return pa.table({"a_id": ids[0].cast(ta), "b_id": ids[1].cast(tb), "ratio": pa.array(out[2], pa.float64())})

    found = x.groupBy("band", "i", "j").cogroup(y.groupBy("bb", "bi", "bj")).applyInArrow(meet, f"a_id {kinds[0]}, b_id {kinds[1]}, ratio double")
    none = a.filter("text = ''").select(F.col("id").alias("a_id")).join(b.filter("text = ''").select(F.col("id").alias("b_id"))).select("a_id", "b_id", F.lit(1.0).alias("ratio"))
    return found.unionByName(none)
