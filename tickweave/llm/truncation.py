"""Texts cut off by field limits: a hashed logistic regression on how texts end, trained on artificial cuts."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweave.runtime import written

#: Texts that train the model, at most about this many, drawn by a hash of the text.
TRAIN_ROWS = 30_000
#: Longer texts train nothing (their ends look like those of others); they are scored like all.
TRAIN_CHARS = 20_000
HASH = 1 << 18
EPOCHS, BATCH, RATE, DECAY = 6, 512, 0.15, 1e-6
#: A length is a limit of a source if it holds this many times the usual number of its rows about that length,
#: and at least this share of them (so there are at most 250).
LIMIT_TIMES, LIMIT_SHARE = 6.0, 0.004
#: The same share for the bytes of Han and kana texts, of which only every third number is common anyway.
LIMIT_SHARE_CJK = 0.06
THRESHOLD = 0.5
#: What a cut may leave behind it.
MARKS = ("...", "…", "[...]", "[…]", " ...", " …", " [...]", "(...)", "-", "<p", "</", "<br", "&amp", "&am", "&lt", "&n", "\\", "\\u00", "\\u2", "�")
TERMINAL = ".。!?！？"
_CLOSERS = "\"'”’»」』)）"
_TERMINAL_END = re.compile(rf"[{re.escape(TERMINAL)}][{re.escape(_CLOSERS)}]*$")
_GROUP_END = re.compile(r"\s*[\[(（][^\[\]()（）]{1,30}[\])）]$")
_SENTENCE = re.compile(rf"[{re.escape(TERMINAL)}][{re.escape(_CLOSERS)}]*(?=\s|$)|[。！？]")
_LABEL_LINE = re.compile(r"\n\s*\w[\w ]{0,30}[:：][^\n]*$")
_MARKED = re.compile(r"(\.\.\.|…|\[\s*(\.\.\.|…)\s*\]|\(\s*\.\.\.\s*\)|<\/?[a-z]*|&[a-z#0-9]{0,6}|\\(?:u[0-9a-fA-F]{0,4})?|�)$")
_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
_CJK_SQL = r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]"
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")


# how a text ends ---------------------------------------------------------------------------------------------


def _shape(s: str) -> str:
    return re.sub(r"\d", "0", s.lower())


def _room(n: int, limits: list[int]) -> str:
    """Place of a length against the nearest limit: at it, a little below or above, or away."""
    best = min((n - x for x in limits), key=abs, default=None)
    return "away" if best is None or not -8 <= best <= 7 else "at" if best == 0 else "below" if best < 0 else "above"


def end_features(text: str, chars: list[int], bytes_: list[int], place: str | None = None) -> list[int]:
    """Hashes of the closing characters, words and punctuation, of open brackets and of the length against the
    limits of the text's source (``place`` overrides that)."""
    room = place or min(_room(len(text), chars), _room(len(text.encode("utf-8", "replace")), bytes_), key=("at", "below", "above", "away").index)
    body = text.rstrip()
    out = [f"room={room}", f"space={len(text) - len(body) > 0}"]
    mark = _MARKED.search(body)
    out.append(f"mark={mark.group(0) if mark else ''}")
    hyphen = body.endswith("-") and body[-2:-1].isalpha()
    out.append(f"hyphen={hyphen}")
    s = _shape(body[-160:])
    last = s[-1:]
    kind = "terminal" if last in TERMINAL else "closer" if last in _CLOSERS + "]" else "letter" if last.isalpha() else "digit" if last.isdigit() else "other"
    cjk = bool(_CJK.search(s[-8:]))
    out += [f"kind={kind}|{cjk}", f"kind={kind}|{room}", *(f"c{k}={s[-k:]}" for k in (1, 2, 3, 4, 5, 7))]
    bare = s.rstrip(TERMINAL + _CLOSERS) if kind in ("terminal", "closer") else s
    words = _WORD.findall(bare[-120:])
    if words and len(bare) > 120:
        words = words[1:]  # it may be half a word
    tail = words[-4:]
    stop = kind in ("terminal", "closer")
    if not cjk:
        for k in (1, 2, 3, 4):
            if len(tail) >= k:
                out.append(f"w{k}={' '.join(tail[-k:])}|{stop}")
        out.append(f"len={min(len(tail[-1]) if tail else 0, 8)}|{kind}")
    else:
        out += [f"j{k}={bare[-k:]}|{stop}" for k in (2, 3, 4, 6)]
    ends = list(_SENTENCE.finditer(body[-400:]))
    rest = body[-400:][ends[-1].end() :] if ends else body[-400:]
    n = len(rest.strip())
    out.append(f"rest={0 if n == 0 else 1 + min(6, n.bit_length())}|{kind}")
    clause = _shape(rest.strip())
    out += [f"tail={clause[:12]}", f"whole={clause[:40]}"] if n else []
    out.append(f"open={s.count('(') + s.count('（') - s.count(')') - s.count('）') > 0}|{s.count('[') > s.count(']')}|{kind}")
    return [zlib.crc32(f.encode("utf-8", "replace")) % HASH for f in out]


def looks_intact(text: str, chars: list[int], bytes_: list[int]) -> bool:
    """A text that may serve as a whole one: away from the limits, without a mark, and closed by punctuation, a
    reference, a formula or a labelled line. Some others are whole as well; they aren't needed."""
    body = text.rstrip()
    if len(body) < 12 or _MARKED.search(body) or _room(len(text), chars) == "at" or _room(len(text.encode("utf-8", "replace")), bytes_) == "at":
        return False
    if _TERMINAL_END.search(body) or _TERMINAL_END.search(_GROUP_END.sub("", body)) or _LABEL_LINE.search(body):
        return True
    ends = list(_SENTENCE.finditer(body))
    return bool(ends) and " = " in body[ends[-1].end() :] and body[-1].isdigit()


def _examples(text: str, chars: list[int], bytes_: list[int], rng: np.random.Generator) -> list[tuple[list[int], int]]:
    """Whole and cut forms of an intact text."""
    body = text.rstrip()
    bare = body.rstrip(TERMINAL) if body[-1:] in TERMINAL else body
    # A whole text that ends in its full stop or in a reference may have the length of a limit by chance.
    out = [(end_features(text, [], [], "at" if body[-1:] in TERMINAL + _CLOSERS + "]" and rng.random() < 0.3 else "away"), 0)]
    if bare != body and rng.random() < 0.5:
        out.append((end_features(bare, [], [], "away"), 0))
    ends = {m.start() for m in _SENTENCE.finditer(body)} | {m.end() for m in _SENTENCE.finditer(body)} | {len(bare), len(body)}
    for _ in range(2):
        at_limit = [x for x in chars if x < len(body) - 1]
        stops = [m.start() for m in _SENTENCE.finditer(body) if 12 < m.start() < len(body) - 2]
        if stops and chars and rng.random() < 0.15:  # a limit may fall just before a full stop
            out.append((end_features(body[: stops[rng.integers(len(stops))]], [], [], "at"), 1))
            continue
        if at_limit and rng.random() < 0.6:
            cut, place = at_limit[rng.integers(len(at_limit))], "at"
        else:
            cut, place = int(rng.integers(max(6, len(body) // 5), max(8, len(body) - 1))), "away"
        if cut >= len(body) - 1:
            continue
        kept = body[:cut]
        if rng.random() < 0.3 and not _CJK.search(kept[-6:]):
            kept = kept.rsplit(" ", 1)[0]  # cut between words
        r = rng.random()
        inside = len(kept.rstrip()) not in ends
        if r < 0.3:
            kept += MARKS[rng.integers(len(MARKS))]
            place = "above" if place == "at" and rng.random() < 0.5 else place
        elif not inside and place != "at":
            continue  # nothing tells a text cut between two sentences
        elif body[cut - 1 : cut] in TERMINAL:
            continue
        if len(kept.strip()) >= 4:
            out.append((end_features(kept, [], [], place), 1))
    return out


# the model ---------------------------------------------------------------------------------------------------


def train(rows: list[list[int]], labels: np.ndarray, seed: int = 0) -> np.ndarray:
    """Weights of the hashed logistic regression (last: bias); AdaGrad over shuffled batches."""
    rng = np.random.default_rng(seed)
    w, g2 = np.zeros(HASH + 1), np.full(HASH + 1, 1e-8)
    if not len(rows):
        return w
    lens = np.array([len(r) + 1 for r in rows])
    flat = np.concatenate([np.append(r, HASH) for r in rows]).astype(np.int64)
    start = np.cumsum(lens) - lens
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            b = order[at : at + BATCH]
            n = lens[b]
            ids = flat[np.repeat(start[b] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            row = np.repeat(np.arange(len(b)), n)
            p = 1 / (1 + np.exp(-np.bincount(row, w[ids])))
            u, inv = np.unique(ids, return_inverse=True)
            g = np.bincount(inv, (p - labels[b])[row]) / len(b) * 20 + DECAY * w[u]
            g2[u] += g * g
            w[u] -= RATE * g / np.sqrt(g2[u])
    return w


def score(w: np.ndarray, rows: list[list[int]]) -> np.ndarray:
    z = np.array([w[r].sum() for r in rows]) + w[HASH] if rows else np.zeros(0)
    return 1 / (1 + np.exp(-z))


# the operator ------------------------------------------------------------------------------------------------


def source_limits(texts: DataFrame) -> DataFrame:
    """(tab, source, cjk, chars, bytes): the lengths at which the texts of a source pile up, in characters and in bytes,
    for texts in Han or kana and for others (the same field holds fewer of their characters).
    From a histogram of all lengths, in which the copies of a text count once; every length that passes counts."""
    once = texts.filter("text is not null").groupBy("tab", "source", F.col("text").rlike(_CJK_SQL).alias("cjk"), F.xxhash64("text")).agg(F.first(F.length("text")).alias("chars"), F.first(F.octet_length("text")).alias("bytes"))

    def piles(length: Column, name: str) -> DataFrame:
        h = once.groupBy("tab", "source", "cjk", length.alias("l")).agg(F.count("*").alias("n")).filter("l > 20")
        about = W.partitionBy("tab", "source", "cjk").orderBy("l").rangeBetween(-40, 40)
        all_ = W.partitionBy("tab", "source", "cjk")
        h = h.select("*", F.expr("percentile(n, 0.5)").over(about).alias("mid"), F.count("*").over(about).alias("seen"), F.sum("n").over(all_).alias("all"))
        h = h.withColumn("mid", F.when(F.col("seen") < 41, F.lit(1.0)).otherwise(F.col("mid")))
        h = h.filter((F.col("n") >= F.greatest(LIMIT_TIMES * F.col("mid"), F.when(F.col("cjk") & F.lit(name == "bytes"), LIMIT_SHARE_CJK).otherwise(LIMIT_SHARE) * F.col("all"), F.lit(8.0))))
        return h.groupBy("tab", "source", "cjk").agg(F.sort_array(F.collect_list("l")).alias(name))

    both = piles(F.col("chars"), "chars").join(piles(F.col("bytes"), "bytes"), ["tab", "source", "cjk"], "full")
    none = F.array().cast("array<int>")
    return both.select("tab", "source", "cjk", F.coalesce("chars", none).alias("chars"), F.coalesce("bytes", none).alias("bytes"))


def _with_limits(texts: DataFrame) -> DataFrame:
    none = F.array().cast("array<int>")
    lim = written(source_limits(texts), "limits")
    x = texts.withColumn("cjk", F.col("text").rlike(_CJK_SQL)).join(lim, ["tab", "source", "cjk"], "left")
    return x.select("tab", "source", "rec_id", "text", F.coalesce("chars", none).alias("chars"), F.coalesce("bytes", none).alias("bytes"))


def _sample(x: DataFrame) -> pd.DataFrame:
    """About TRAIN_ROWS texts, each at most once, the same for the same input."""
    x = x.filter((F.length("text") > 0) & (F.length("text") <= TRAIN_CHARS))
    total = x.agg(F.approx_count_distinct(F.xxhash64("text"))).first()[0]
    share = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    got = x.filter(share < min(1.0, TRAIN_ROWS / max(total, 1))).groupBy("text").agg(F.first("chars").alias("chars"), F.first("bytes").alias("bytes"))
    return got.limit(2 * TRAIN_ROWS).toPandas().sort_values("text", ignore_index=True)


def fit(x: DataFrame, seed: int = 0) -> np.ndarray:
    """Train on the texts of the sample that look intact, whole and cut."""
    rng = np.random.default_rng(seed)
    ex = [e for t, c, b in _sample(x).itertuples(index=False) if looks_intact(t, list(c), list(b)) for e in _examples(t, list(c), list(b), rng)]
    return train([r for r, _ in ex], np.array([y for _, y in ex], float), seed)


def truncated(texts: DataFrame) -> DataFrame:
    """(tab, source, rec_id, score): the chance that each text was cut off. ``texts`` has tab, source, rec_id and
    text; null and blank texts have score 0. A null source is a source of its own. Copies count each; empty
    input: no rows. The corpus is read for the histogram of lengths, the sample and the scores; nothing but the
    histogram is shuffled."""
    texts = texts.select("tab", F.coalesce("source", F.lit("")).alias("source"), "rec_id", "text")
    x = _with_limits(texts)
    weights = x.sparkSession.sparkContext.broadcast(fit(x).astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, c, y = (b.column(i).to_pylist() for i in (3, 4, 5))
            blank = np.array([not (s and s.strip()) for s in t], bool)
            rows = [[] if e else end_features(s, k, m) for s, k, m, e in zip(t, c, y, blank)]
            p = np.where(blank, 0.0, score(weights.value, rows))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(p.astype(float))], ["tab", "source", "rec_id", "score"])

    return x.mapInArrow(run, "tab string, source string, rec_id long, score double")


def report(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """How often each source truncates: tab, source, n_records, n_truncated, share."""
    cut = (F.col("score") >= threshold).cast("long")
    return scores.groupBy("tab", "source").agg(F.count("*").alias("n_records"), F.sum(cut).alias("n_truncated"), F.avg(cut).alias("share"))
