"""Language of texts and of their segments: averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The languages, and the notations of a label that stand for them.
LANGUAGES = ("en", "zh", "ja", "de", "fr", "es", "pt", "it")
NAMES = {
    "eng": "en", "english": "en", "zho": "zh", "chi": "zh", "cmn": "zh", "chinese": "zh", "mandarin": "zh", "jpn": "ja", "japanese": "ja", "deu": "de", "ger": "de", "german": "de",
    "fra": "fr", "fre": "fr", "french": "fr", "spa": "es", "spanish": "es", "por": "pt", "portuguese": "pt", "ita": "it", "italian": "it",
}
NO_LABEL = ("", "und", "unknown")
#: The training sample: about this many labelled texts of each language, and sentences of each text.
TRAIN_TEXTS, PER_TEXT = 500, 4
BUCKETS, DIM, ORDERS = 1 << 16, 16, (1, 2, 3, 4)
EPOCHS, BATCH, RATE = 4, 64, 40.0
#: A sentence is accepted from the confidence on at which this share of held-out sentences is right.
PRECISION = 0.998
#: A whole sentence has at least so many words, or so many Han or kana characters.
MIN_WORDS, MIN_CJK = 4, 6
SLICE = 400

_CODE = re.compile(
    r"\\begin\{(equation|align|verbatim)\*?\}.*?\\end\{\1\*?\}|\$[^$\n]{0,300}\$|\\[A-Za-z]+\*?(?:\{[^{}\n]*\})?|<\|[^|>\s]{1,30}\|>|https?://\S+"
    r"|\[\s*\"[^\n]*\]|\{\s*\"[^\n]*\}|[(（][^()（）\n]{0,40}\d{4}[)）]",
    re.S,
)
_CUT = re.compile(r"[.!?]+[\"'”’»)\]]*(?=\s|$)|[。！？]+[\"'”’」』）)]*|\n+|\s/\s")
_LETTERS: np.ndarray | None = None


def sentences(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, closed) of the sentences of a text; code, formulas and references are no text. ``closed``:
    it ends in a full stop, a question mark or an exclamation mark."""
    s = _CODE.sub(lambda m: " " * len(m.group()), text)
    out, at = [], 0
    for m in _CUT.finditer(s):
        if s[at : m.end()].strip():
            out.append((at, m.end(), m.group()[0] in ".!?。！？"))
        at = m.end()
    if s[at:].strip():
        out.append((at, len(s), False))
    return out


_CJK_RUN = re.compile(r"[぀-ヿ㐀-鿿]")
_WORDS = re.compile(r"[^\W\d_]{2,}")


def whole(s: str) -> bool:
    return len(_CJK_RUN.findall(s)) >= MIN_CJK or len(_WORDS.findall(s)) >= MIN_WORDS


def _clean(text: str, a: int, b: int) -> str:
    return unicodedata.normalize("NFC", _CODE.sub(" ", text[a:b]).lower())


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character n-grams of letters and blanks, sorted by text, and the number of each text."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.array([chr(c).isalpha() or unicodedata.category(chr(c))[0] == "M" for c in range(0xD800)], bool)
    raw = " ".join(["", *texts, ""])
    c = np.frombuffer(raw.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    owner = np.concatenate([np.repeat(np.arange(len(texts)), lens), [len(texts)]])[: len(c)]
    known = c < len(_LETTERS)
    c = np.where(known & _LETTERS[np.where(known, c, 0)] | (c >= 0xE000), c, 32)
    keep = np.ones(len(c), bool)
    keep[1:] = ~((c[1:] == 32) & (c[:-1] == 32) & (owner[1:] == owner[:-1]))  # blanks fold into one
    c, owner = c[keep], owner[keep]
    ids, who = [], []
    for n in ORDERS:
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.int64)
        for k in range(n):
            h = h * 0x01000193 + c[k : k + m]
        ok = owner[:m] == owner[n - 1 :]
        ok &= (c[:m] != 32) if n == 1 else True
        h = (h * np.int64(0x2545F4914F6CDD1D) >> np.int64(40)) & (BUCKETS - 1)
        ids.append(h[ok])
        who.append(owner[:m][ok])
    if not ids:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    ids, who = np.concatenate(ids), np.concatenate(who)
    order = np.argsort(who, kind="stable")
    ids, who = ids[order], who[order]
    inside = who < len(texts)
    return ids[inside], np.bincount(who[inside], minlength=len(texts))


class Model:
    """Embeddings and softmax, trained; for use the two are one table of logits by bucket."""

    def __init__(self, table: np.ndarray, bias: np.ndarray, heat: float, least: float):
        self.table, self.bias, self.heat, self.least = table, bias, heat, least

    def logits(self, texts: list[str]) -> np.ndarray:
        ids, n = ngrams(texts)
        out = np.zeros((len(texts), len(LANGUAGES)), np.float32)
        some = np.flatnonzero(n)
        if len(some):
            start = (np.cumsum(n) - n)[some]
            out[some] = np.add.reduceat(self.table[ids], start, axis=0) / n[some, None]
        return out + self.bias

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Language number and calibrated confidence."""
        p = _softmax(self.logits(texts) * self.heat)
        best = p.argmax(axis=1) if len(p) else np.zeros(0, int)
        return best, p[np.arange(len(p)), best]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
    return e / e.sum(axis=1, keepdims=True) if len(z) else e


def _descend(texts: list[str], y: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    emb, out, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, len(LANGUAGES))), np.zeros(len(LANGUAGES))
    ids, n = ngrams(texts)
    start = np.cumsum(n) - n
    weight = 1 / np.maximum(np.bincount(y, minlength=len(LANGUAGES)), 1)
    weight = weight / weight[y].mean()
    steps = EPOCHS * max(1, -(-len(texts) // BATCH))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            b = order[at : at + BATCH]
            b = b[n[b] > 0]
            if not len(b):
                continue
            k = n[b]
            i = ids[np.repeat(start[b] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
            u, inv = np.unique(i, return_inverse=True)
            row = np.repeat(np.arange(len(b)), k)
            count = np.bincount(row * len(u) + inv, minlength=len(b) * len(u)).reshape(len(b), len(u)) / k[:, None]
            hidden = count @ emb[u]
            d = _softmax(hidden @ out + bias)
            d[np.arange(len(b)), y[b]] -= 1
            d *= weight[y[b], None]
            rate = RATE * (1 - step / steps) / len(b)
            step += 1
            grad = count.T @ (d @ out.T)
            out -= 0.2 * rate * (hidden.T @ d)
            bias -= 0.02 * rate * d.sum(axis=0)
            emb[u] -= 5 * rate * grad
    return (emb @ out).astype(np.float32), bias.astype(np.float32)


def fit(texts: list[str], labels: np.ndarray, seed: int = 0) -> Model:
    """Train twice: the second time without the sentences of which the first model says that their label is
    wrong. A held-out fifth sets the heat of the softmax and the confidence from which on to accept."""
    if not texts:
        return Model(np.zeros((BUCKETS, len(LANGUAGES)), np.float32), np.zeros(len(LANGUAGES), np.float32), 1.0, 1.1)
    held = np.random.default_rng(seed).random(len(texts)) < 0.2
    pick = lambda m: ([t for t, k in zip(texts, m) if k], labels[m])
    t, y = pick(~held)
    first = Model(*_descend(t, y, seed), 1.0, 0.0)
    ok = first.predict(t)[0] == y
    model = Model(*_descend([s for s, k in zip(t, ok) if k], y[ok], seed + 1), 1.0, 0.0)
    t, y = pick(held)
    if not t:
        return model
    z = model.logits(t)
    sure = _softmax(z)
    ok = (sure.argmax(axis=1) == y) | (sure.max(axis=1) < 0.9) | (sure[np.arange(len(y)), y] > 0.05)  # else the label is wrong
    z, y = z[ok], y[ok]
    heats = np.geomspace(0.25, 8, 41)
    model.heat = float(min(heats, key=lambda h: -np.log(_softmax(z * h)[np.arange(len(y)), y] + 1e-9).mean()))
    p = _softmax(z * model.heat)
    conf, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-conf)
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    last = np.flatnonzero(good >= PRECISION)
    model.least = float(min(max(conf[order][last[-1]], 0.5), 0.9)) if len(last) else 0.9
    return model


# the operator ------------------------------------------------------------------------------------------------


def label_code(label: Column) -> Column:
    """Code of a label in any notation; '' for none, '?' for another language."""
    main = F.lower(F.regexp_extract(F.trim(label), r"^([A-Za-z]*)", 1))
    known = F.create_map(*(F.lit(x) for kv in ({c: c for c in LANGUAGES} | NAMES).items() for x in kv))
    plain = F.lower(F.trim(F.regexp_replace(F.coalesce(label, F.lit("")), r"^\s+|\s+$", "")))
    return F.when(plain.isin(*NO_LABEL), "").otherwise(F.coalesce(F.try_element_at(known, main), F.lit("?")))


def _train_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for code, text in zip(b["code"], b["text"]):
            s = [x for x in (_clean(text, a, e) for a, e, _ in sentences(text)) if whole(x)]
            rng = np.random.default_rng(len(text))
            rows += [(code, s[i][:600]) for i in rng.permutation(len(s))[:PER_TEXT]]
        yield pd.DataFrame(rows, columns=["code", "sentence"])


def train(docs: DataFrame, text: Column, label: Column, seed: int = 0) -> Model:
    """From TRAIN_TEXTS distinct labelled texts of each language at most, those of the least hash, however often a text
    is repeated: about twice as many are drawn by their hash and rid of copies before they are ordered."""
    key = F.xxhash64("text")
    x = docs.select(label_code(label).alias("code"), text.alias("text")).filter(F.col("code").isin(*LANGUAGES) & (F.length("text") > 0))
    n = {r["code"]: r["n"] for r in x.groupBy("code").agg(F.approx_count_distinct(key).alias("n")).collect()}  # at most eight
    share = F.pmod(key, F.lit(1 << 30)) / float(1 << 30)
    take = F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for k, c in n.items() for v in (k, 2 * TRAIN_TEXTS / max(c, 1)))), F.col("code")), F.lit(0.0)) if n else F.lit(0.0)
    drawn = x.filter(share < take).groupBy("code", "text").agg(F.first(share).alias("share"))
    least = drawn.withColumn("place", F.row_number().over(W.partitionBy("code").orderBy("share", "text"))).filter(F.col("place") <= TRAIN_TEXTS)
    got = least.select("code", "text").mapInPandas(_train_rows, "code string, sentence string").toPandas().sort_values(["sentence", "code"], ignore_index=True)
    return fit(got["sentence"].tolist(), got["code"].map({c: i for i, c in enumerate(LANGUAGES)}).to_numpy(int), seed)


_SEGMENTS = "doc_id {id}, code string, seg_no int, start int, stop int, lang_code string, confidence double, whole int"


def segments(docs: DataFrame, doc: Column, text: Column, label: Column, *, model: Model | None = None) -> DataFrame:
    """The segments of each text: neighbouring sentences of one language.

    Columns: doc_id, code (of the label), seg_no, start and stop (characters), lang_code (null: rejected),
    confidence (the mean of the sentences that gave the language, by their length), whole (number of accepted whole sentences). Null, blank and figures-only
    texts have no segments. Whole texts are read; nothing is shuffled, and only the training sample, of bounded
    size, comes to the driver.
    """
    model = model or train(docs, text, label)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(doc.alias("doc_id"), label_code(label).alias("code"), text.cast("string").alias("text")).filter(F.length("text") > 0)
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for big in batches:
            for at in range(0, big.num_rows, SLICE):
                b = big.slice(at, SLICE)
                texts = b.column(2).to_pylist()
                spans = [(i, *s) for i, t in enumerate(texts) for s in sentences(t)]
                clean = [_clean(texts[i], a, e) for i, a, e, _ in spans]
                best, conf = m.predict(clean)
                rows: list[list] = []
                for (i, a, e, closed), c, l, p in zip(spans, clean, best.tolist(), conf.tolist()):
                    if not _WORDS.search(c) and not _CJK_RUN.search(c):
                        continue
                    full = whole(c)
                    lang = LANGUAGES[l] if p >= m.least and full else None
                    prev = rows[-1] if rows and rows[-1][0] == i else None
                    if prev and (lang is None or prev[3] == lang or prev[3] is None):
                        if lang is not None:
                            known = prev[6] if prev[3] else 0
                            prev[4], prev[6] = (prev[4] * known + p * len(c)) / (known + len(c)), known + len(c)
                        prev[2], prev[3] = e, prev[3] or lang
                        prev[5] += int(lang is not None)
                    else:
                        rows.append([i, a, e, lang, p, int(lang is not None), len(c)])
                who = np.array([r[0] for r in rows], np.int64)
                first = np.ones(len(who), bool)
                first[1:] = who[1:] != who[:-1]
                no = np.arange(len(who)) - np.maximum.accumulate(np.where(first, np.arange(len(who)), 0)) if len(who) else who
                cols = [b.column(0).take(pa.array(who)), b.column(1).take(pa.array(who)), pa.array(no.astype(np.int32))]
                cols += [pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.string()), (4, pa.float64()), (5, pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "code", "seg_no", "start", "stop", "lang_code", "confidence", "whole"])

    return src.mapInArrow(run, _SEGMENTS.format(id=kind))


def languages(seg: DataFrame) -> DataFrame:
    """(doc_id, code, langs, confidence): the languages in which a text has an accepted whole sentence."""
    s = seg.filter("whole > 0").groupBy("doc_id", "code", "lang_code").agg(F.max("confidence").alias("confidence"), F.sum("whole").alias("n"))
    return s.groupBy("doc_id", "code").agg(F.sort_array(F.collect_list("lang_code")).alias("langs"), F.min("confidence").alias("confidence"), F.max_by("lang_code", F.struct("n", "lang_code")).alias("main"))


def mislabelled(seg: DataFrame) -> DataFrame:
    """(doc_id, lang_code): a row per language of each text whose label is missing or names another language, or
    that has several. Texts without a language are left out."""
    x = languages(seg)
    wrong = (F.size("langs") > 1) | (F.col("code") != F.col("langs")[0])
    return x.filter(wrong).select("doc_id", F.explode("langs").alias("lang_code"))
