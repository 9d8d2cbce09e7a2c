"""Ranked retrieval: search with spelling correction, field and record recommendation, group profiles, plans, tiers."""

from __future__ import annotations

import difflib
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the fields that a search looks into, of a corrected word, of common characters and of an
#: author, and the least ratio of a correction.
FIELDS = {"title": 5.0, "keywords": 4.0, "abstract": 3.0, "authors": 6.0, "id": 2.0, "metadata": 1.0}
CORRECTED, OVERLAP, AUTHOR, LEAST_RATIO = 0.82, 0.25, 5.0, 0.78
#: Fixed value: what a word of the vocabulary is.
WORD = r"([a-z0-9][a-z0-9_-]*|[一-鿿]+)"


def _ratio(term: Column, word: Column) -> Column:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        m = difflib.SequenceMatcher()
        out = []
        for x, y in zip(a, b):
            m.set_seq2(x)  # the term, whose index is kept from word to word
            m.set_seq1(y)
            out.append(m.ratio() if m.real_quick_ratio() >= LEAST_RATIO and m.quick_ratio() >= LEAST_RATIO else 0.0)
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(run, "double")(term, word)


def corrections(rows: DataFrame, terms: Sequence[str], fields: Sequence[str] = tuple(FIELDS)) -> dict[str, str]:
    """The most similar word of the rows' vocabulary for each term, if its ratio is LEAST_RATIO or more; of equal ones
    the last by text. The vocabulary stays distributed: words of a length that can't reach the ratio are dropped
    before it is computed, and one word a term comes back."""
    if not terms:
        return {}
    words = rows.select(F.explode(F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", *fields), F.lit(WORD), F.lit(1)))).alias("word")).distinct()
    asked = F.broadcast(rows.sparkSession.createDataFrame([(t,) for t in terms], "term string"))  # the words of a query
    long = F.length("term") + F.length("word")
    x = words.join(asked, 2 * F.least(F.length("term"), F.length("word")) >= LEAST_RATIO * long)
    best = x.withColumn("r", _ratio(F.col("term"), F.col("word"))).filter(F.col("r") >= LEAST_RATIO).groupBy("term").agg(F.max(F.struct("r", "word"))["word"].alias("word"))
    return {r["term"]: r["word"] for r in best.collect()}


def search_scores(rows: DataFrame, terms: Sequence[str], synonyms: Mapping[str, Sequence[str]] | None = None, corrected: Mapping[str, str] | None = None) -> tuple[Column, Column]:
    """(score, matched terms) of a row whose FIELDS are lower-case texts: for each term the weight of the best field
    that holds it or a synonym, else CORRECTED times that of its correction; OVERLAP times the share of the query's
    characters in the row; AUTHOR for each term among the authors."""
    score, matched = F.lit(0.0), F.lit(0)
    for t in dict.fromkeys(terms):
        variants = [t, *(synonyms or {}).get(t, ())]
        best = lambda words: F.greatest(*(F.when(F.contains(f, F.lit(w)), v).otherwise(0.0) for w in words for f, v in FIELDS.items()))
        exact = best(variants)
        fixed = best([corrected[t]]) * CORRECTED if corrected and t in corrected else F.lit(0.0)
        got = F.when(exact > 0, exact).otherwise(fixed)
        author = F.lit(False)
        for w in variants:
            author = author | F.contains("authors", F.lit(w))
        score = score + got + F.when((got > 0) & author, AUTHOR).otherwise(0.0)
        matched = matched + (got > 0).cast("int")
    letters = sorted(set("".join(terms)))
    whole = F.concat_ws(" ", *FIELDS)
    common = sum((F.contains(whole, F.lit(c)).cast("int") for c in letters), F.lit(0))
    return score + OVERLAP * common / max(len(letters), 1), matched


def search(rows: DataFrame, terms: Sequence[str], synonyms: Mapping[str, Sequence[str]] | None = None, correct: bool = True) -> DataFrame:
    """Rows that match every term, with ``score``; without terms none. Null fields are empty texts."""
    if not terms:
        return rows.filter("false").withColumn("score", F.lit(0.0))
    low = rows.withColumns({f: F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in FIELDS})
    score, matched = search_scores(low, terms, synonyms, corrections(low, terms) if correct else None)
    return low.withColumns({"score": score, "__n": matched}).filter(F.col("__n") == len(dict.fromkeys(terms))).drop("__n")


def field_votes(signals: DataFrame, ident: str, own: Column, tags: Column, text: Column, by_tag: Mapping[str, Sequence[str]], by_word: Mapping[str, Sequence[str]], always: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """(ident, field, score): 3 for a field of the signal's own, 2 for each of its tags and 1 for each word of its
    text that hint at the field, 0.2 for one that always serves; allowed fields alone."""
    entry = lambda fields, v: F.transform(fields, lambda f: F.struct(f.alias("field"), F.lit(v).alias("v")))
    none = F.array().cast("array<string>")
    lit = lambda xs: F.array(*map(F.lit, xs)) if xs else none
    parts = [entry(F.coalesce(own, none), 3.0), entry(lit(always), 0.2)]
    parts += [F.when(F.array_contains(F.coalesce(tags, none), F.lit(t)), entry(lit(fs), 2.0)) for t, fs in by_tag.items()]
    parts += [F.when(F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(w)), entry(lit(fs), 1.0)) for w, fs in by_word.items()]
    x = signals.select(ident, F.explode(F.flatten(F.array_compact(F.array(*parts)))).alias("e")).filter(F.col("e.field").isin(*allowed))
    return x.groupBy(ident, F.col("e.field").alias("field")).agg(F.round(F.sum("e.v"), 4).alias("score"))


def record_likeness(tags: Column, fields: Column, text: Column, metric: Column, own_tags: Sequence[str], own_fields: Sequence[str], terms: Sequence[str]) -> Column:
    """3 for each common tag, 2 for each common field, 0.4 for each term of five letters or more in the text (five at
    most), and the size of the metric up to 1."""
    none = F.array().cast("array<string>")
    common = lambda c, xs: F.size(F.array_intersect(F.coalesce(c, none), F.array(*map(F.lit, xs)) if xs else none))
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = sum((F.contains(low, F.lit(t)).cast("int") for t in sorted(set(terms)) if len(t) >= 5), F.lit(0))
    return 3.0 * common(tags, own_tags) + 2.0 * common(fields, own_fields) + 0.4 * F.least(F.lit(5), hit) + F.least(F.abs(F.coalesce(metric, F.lit(0.0))), F.lit(1.0))


def group_profiles(rows: DataFrame, group: str, words: str) -> DataFrame:
    """(group, n_rows, coherence, distinctiveness, confidence) from the words of a group's rows.

    Coherence is the mean cosine of the word counts of every two rows that have words (1 for fewer than two). It needs
    no pair: the sum over pairs is (|sum of unit vectors|^2 - rows) / 2. Distinctiveness is 1 less the highest cosine of
    the group's weighted counts with another group's counts; groups meet by their words, as counts, not rows."""
    x = rows.filter(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.monotonically_increasing_id().alias("row"), F.col(words).alias("ws"))
    x = x.select("g", "row", F.explode("ws").alias("w"))
    c = x.groupBy("g", "row", "w").agg(F.count("*").alias("n"))
    size = c.groupBy("g", "row").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("size"))
    unit = c.join(size, ["g", "row"]).groupBy("g", "w").agg(F.sum(F.col("n") / F.col("size")).alias("u"), F.sum("n").alias("n"))
    m = size.groupBy("g").agg(F.count("*").alias("m"))
    whole = unit.groupBy("g").agg(F.sum(F.col("u") * F.col("u")).alias("s")).join(m, "g")
    pairs = F.col("m") * (F.col("m") - 1) / 2
    coherence = whole.select("g", F.when(pairs > 0, (F.col("s") - F.col("m")) / 2 / pairs).otherwise(1.0).alias("coherence"))
    groups = rows.filter(F.col(group).isNotNull()).agg(F.countDistinct(group).alias("k"))
    df = unit.groupBy("w").agg(F.count("*").alias("df"))
    own = unit.join(df, "w").crossJoin(F.broadcast(groups)).select("g", "w", "n", (F.col("n") * (F.ln((1 + F.col("k")) / (1 + F.col("df"))) + 1)).alias("t"))  # one row
    norms = own.groupBy("g").agg(F.sqrt(F.sum(F.col("t") ** 2)).alias("nt"), F.sqrt(F.sum(F.col("n") ** 2)).alias("nn"))
    dots = own.select("g", "w", "t").join(own.select(F.col("g").alias("h"), "w", "n"), "w").filter("g != h").groupBy("g", "h").agg(F.sum(F.col("t") * F.col("n")).alias("dot"))
    near = dots.join(norms.select("g", "nt"), "g").join(norms.select(F.col("g").alias("h"), "nn"), "h").groupBy("g").agg(F.max(F.col("dot") / (F.col("nt") * F.col("nn"))).alias("near"))
    out = rows.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n_rows")).join(coherence, "g", "left").join(near, "g", "left")
    co, di = F.coalesce("coherence", F.lit(1.0)), 1 - F.coalesce("near", F.lit(0.0))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * co + 0.4 * di))
    return out.select(F.col("g").alias(group), "n_rows", F.round(co, 4).alias("coherence"), F.round(di, 4).alias("distinctiveness"), F.round(sure, 4).alias("confidence"))


def plan_score(quality: Column, prior: Column, trials: Column, mean: Column, failures: Column, total: Column, lineage_trials: Column, c: float = 0.03) -> Column:
    """Score of a parent and a focus: quality and prior, the mean reward with an upper confidence bound, less a
    hundredth for each failure, less penalties for trials of the lineage (0.20 at most) and of the focus (0.18)."""
    bound = F.when(total > 0, c * F.sqrt(F.ln(total + 1) / (trials + 1))).otherwise(c)
    return quality + prior + F.coalesce(mean, F.lit(0.0)) + bound - 0.01 * failures - F.least(F.lit(0.20), 0.025 * F.sqrt(lineage_trials)) - F.least(F.lit(0.18), 0.04 * F.sqrt(trials))


def reliability(rows: DataFrame, group: Sequence[str], parts: Mapping[str, tuple[Column, float]], unresolved: Column, each: float = 6.0, most: float = 35.0) -> DataFrame:
    """(group, the mean of each part, unresolved, score): parts between 0 and 100 with their weights, less ``each`` for
    each unresolved one a row, ``most`` at most; never below 0. A part without a value counts as 0."""
    x = rows.groupBy(*group).agg(*(F.avg(v).alias(k) for k, (v, _) in parts.items()), F.avg(unresolved).alias("unresolved"))
    score = sum((w * F.coalesce(k, F.lit(0.0)) for k, (_, w) in parts.items()), F.lit(0.0)) - F.least(F.col("unresolved") * each, F.lit(most))
    return x.select(*group, *(F.round(k, 6).alias(k) for k in parts), F.round("unresolved", 6).alias("unresolved"), F.round(F.greatest(F.lit(0.0), score), 1).alias("reliability"))


def tier_utility(values: DataFrame, group: str, tier: str, value: str) -> DataFrame:
    """(group, count, mean size, share above 0.02 and agreement of signs per tier, utility) of small, medium and large
    tiers: utility weighs size, share and agreement in the small tier and size in the others, in hundredths."""
    one = lambda name: F.when(F.col(tier) == name, F.col(value))
    aggs = []
    for t in ("small", "medium", "large"):
        v = one(t)
        aggs += [F.count(v).alias(f"{t}_count"), F.round(F.avg(F.abs(v)), 6).alias(f"{t}_abs"), F.round(F.avg((F.abs(v) > 0.02).cast("double")), 6).alias(f"{t}_share"), F.round(F.abs(F.avg(F.signum(v))), 6).alias(f"{t}_agree")]
    x = values.groupBy(group).agg(*aggs)
    full = lambda c: F.least(F.coalesce(c, F.lit(0.0)) / 0.03, F.lit(1.0))
    u = 0.45 * full("small_abs") + 0.25 * F.coalesce("small_share", F.lit(0.0)) + 0.20 * (full("medium_abs") + full("large_abs")) / 2 + 0.10 * F.coalesce("small_agree", F.lit(0.0))
    return x.withColumn("utility", F.round(100 * u, 1))
