"""Text: normal forms, phrases, classification by phrases, tokens, chunks, dates, JSON."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_DASHES = r"[_\u2010\u2011\u2013\u2014-]+"
CJK = r"[\u4e00-\u9fff]"


def match_form(text: str | None) -> str:
    s = unicodedata.normalize("NFKC", text or "").casefold()
    return re.sub(r"[^\w]+", " ", re.sub(_DASHES, " ", s)).strip()


def match_text(c: Column) -> Column:
    """Form for phrase matching: one case, dashes and anything but letters and digits as single blanks. ASCII text
    stays inside the JVM; the rest needs Unicode folding, which is no built-in."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(match_form, na_action="ignore")

    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[_-]+", " "), r"[^0-9a-z]+", " "))
    folded = F.pandas_udf(run, "string")(F.when(~c.rlike(r"^[\x00-\x7F]*$"), c))
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), plain).otherwise(folded)


def has_phrase(normal: Column, phrase: str) -> Column:
    """Whole words of a normal form; a Han phrase anywhere in it."""
    p = match_form(phrase)
    return F.contains(normal, F.lit(p)) if re.search(CJK, p) else F.contains(F.concat(F.lit(" "), normal, F.lit(" ")), F.lit(f" {p} "))


def hits(normal: Column, phrases: Sequence[str]) -> Column:
    """Sorted array of the phrases that a normal form has."""
    return F.array_sort(F.array_compact(F.array(*(F.when(has_phrase(normal, p), F.lit(p)) for p in phrases))))


def aliases(normal: Column, alias: Mapping[str, str]) -> Column:
    """struct(canonical, evidence): sorted canonical names of the aliases found, and the aliases."""
    pairs = F.array_compact(F.array(*(F.when(has_phrase(normal, a), F.struct(F.lit(c).alias("c"), F.lit(a).alias("a"))) for a, c in alias.items())))
    return F.struct(F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p.c))).alias("canonical"), F.array_sort(F.transform(pairs, lambda p: p.a)).alias("evidence"))


def weighted_hits(fields: Mapping[str, tuple[Column, int]], phrases: Sequence[str]) -> tuple[dict[str, Column], Column]:
    """Hits per field, and the score: weight times number of hits, summed."""
    found = {k: hits(c, phrases) for k, (c, _) in fields.items()}
    return found, sum((F.size(found[k]) * w for k, (_, w) in fields.items()), F.lit(0))


def decision_list(rules: Sequence[tuple[Column, str, str]], otherwise: tuple[str, str]) -> Column:
    """struct(status, reason) of the first rule that holds; null conditions don't hold."""
    out = None
    for cond, status, reason in rules:
        v = F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
        out = F.when(F.coalesce(cond, F.lit(False)), v) if out is None else out.when(F.coalesce(cond, F.lit(False)), v)
    last = F.struct(F.lit(otherwise[0]).alias("status"), F.lit(otherwise[1]).alias("reason"))
    return last if out is None else out.otherwise(last)


def reasons(faults: Mapping[str, Column]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in faults.items())))


def word_hits(text: Column, terms: Sequence[str]) -> Column:
    """Terms that stand in a lower-case text with no letter or digit beside them."""
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(low.rlike(rf"(?<![a-z0-9]){re.escape(t.lower())}(?![a-z0-9])"), F.lit(t)) for t in terms)))


def regex_class(text: Column, cascade: Sequence[tuple[str, str]], otherwise: str) -> Column:
    out = None
    for pattern, name in cascade:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise(otherwise)


def rebuilt_abstract(index: Column) -> Column:
    """Text of a map from token to positions; negative positions are left out, equal ones go by token."""
    flat = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(F.filter(F.coalesce(e.value, F.array().cast("array<int>")), lambda p: p >= 0), lambda p: F.struct(p.alias("p"), e.key.alias("t")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(flat), lambda s: s.t), " "), F.lit(""))


def joined_names(items: Column, field: str = "display_name") -> Column:
    return F.coalesce(F.array_join(F.transform(items, lambda x: F.coalesce(x[field], F.lit(""))), " "), F.lit(""))


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def first_seen(values: Column) -> Column:
    """Distinct values by lower case without blanks, each as first seen, in order."""
    clean = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), squeezed), lambda v: v != "")
    return F.filter(clean, lambda v, i: ~F.exists(F.slice(clean, 1, i), lambda u: F.lower(u) == F.lower(v)))


def embedding_text(title: Column, abstract: Column, keywords: Column) -> Column:
    """struct(text, quality): A with title and abstract or keywords, B with a title, else C."""
    t, a, k = squeezed(title), squeezed(abstract), first_seen(keywords)
    line = lambda label, v: F.when(v != "", F.concat(F.lit(label), v))
    text = F.concat_ws("\n", line("Title: ", t), line("Abstract: ", a), F.when(F.size(k) > 0, F.concat(F.lit("Keywords: "), F.array_join(k, "; "))))
    return F.struct(text.alias("text"), F.when((t != "") & ((a != "") | (F.size(k) > 0)), "A").when(t != "", "B").otherwise("C").alias("quality"))


def tokens(c: Column) -> Column:
    """Distinct words (with digits, dashes and underscores) and runs of Han, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9][a-z0-9_-]*|[\u4e00-\u9fff]+)"), F.lit(1)))


def title_tokens(c: Column, stop: Sequence[str], least: int = 3) -> Column:
    """Words of letters of at least ``least``, repeated ones too, without stop words."""
    w = F.regexp_extract_all(F.lower(c), F.lit(r"([a-z][a-z-]+)"), F.lit(1))
    return F.filter(w, lambda x: (F.length(x) >= least) & ~x.isin(*stop))


#: Fixed value: where a text falls into sentences.
_SENTENCE_END = r"(?<=[。！？.!?])\s+|\n{2,}"


def split_sentences(text: str | None) -> list[str]:
    return [p.strip() for p in re.split(_SENTENCE_END, text or "") if p.strip()]


def chunks(text: Column, max_chars: int = 1800) -> Column:
    """Sentences packed in order into chunks of at most ``max_chars``; a longer sentence is a chunk of its own. The
    greedy packing carries state from sentence to sentence, hence Arrow batches."""

    def pack(t: str | None) -> list[str]:
        out: list[list[str]] = []
        size = 0
        for s in split_sentences(t):
            if not out or (size + len(s) > max_chars and out[-1]):
                out.append([])
                size = 0
            out[-1].append(s)
            size += len(s)
        return ["\n".join(x) for x in out]

    def run(s: pd.Series) -> pd.Series:
        return s.map(pack)

    return F.pandas_udf(run, "array<string>")(text)


def selected_chunks(scored: Column, tasks: Sequence[str], n: int) -> Column:
    """Indexes of chunks to read: for each task in turn its best max(2, n / tasks) not yet taken, then in order.
    ``scored`` is an array of maps from task to score."""

    def pick(rows: list) -> list[int]:
        got: list[int] = []
        each = max(2, n // max(1, len(tasks)))
        for t in tasks:
            best = sorted((-(dict(r).get(t) or 0), i) for i, r in enumerate(rows) if i not in got)
            got += [i for s, i in best[:each] if s < 0][: max(0, n - len(got))]
        got += [i for i in range(len(rows)) if i not in got][: max(0, n - len(got))]
        return got

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda r: pick(list(r)) if r is not None else [])

    return F.pandas_udf(run, "array<int>")(scored)


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """Share of matching blocks of two texts; not an edit distance, hence no built-in."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def timestamp_of(c: Column) -> Column:
    """UTC time of an ISO 8601 or RFC 822 text, else null."""
    rfc = F.regexp_replace(c, r"^[A-Za-z]{3}, ", "")
    rfc = F.regexp_replace(rfc, r" (GMT|UTC|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))


def recent(ts: Column, as_of: Column, days: int) -> Column:
    """Not older than ``days``; undated passes."""
    return F.coalesce(ts >= as_of - F.make_dt_interval(F.lit(days)), F.lit(True))


def month_window(ts: Column, month: Column) -> Column:
    """Inside the month of the day ``month``."""
    first = F.trunc(month, "month")
    return (F.to_date(ts) >= first) & (F.to_date(ts) <= F.last_day(first))


def scalar_kind(c: Column) -> Column:
    """struct(kind, number): what a text stands for: null, boolean, int, float or text."""
    t = F.trim(c)
    kind = F.when(t.isNull() | (t == ""), "null").when(F.lower(t).isin("true", "false"), "boolean").when(t.try_cast("long").isNotNull() & ~F.contains(t, F.lit(".")), "int").when(t.try_cast("double").isNotNull(), "float").otherwise("text")
    return F.struct(kind.alias("kind"), t.try_cast("double").alias("number"))


def flattened(c: Column) -> Column:
    """Values of a nested column in one lower-case text."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.to_json(c), r'"[^"]*":', " ")), r'[\[\]{}",]+', " "))


def ic_bucket(c: Column) -> Column:
    """Lower bound of the hundredth that the size of a coefficient lies in, as text."""
    return F.when(c.isNotNull(), F.format_string("%.2f", F.floor(F.abs(c) * 100 + 1e-9) / 100))


def accepted(value: Column, rule: str) -> Column:
    """supported, refuted or (for a missing value or an unreadable rule) inconclusive, by ``metric op number``."""
    m = re.fullmatch(r"\s*[\w.]+\s*(>=|<=|==|!=|>|<)\s*(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)\s*", rule)
    if not m:
        return F.lit("inconclusive")
    x = F.lit(float(m[2]))
    test = {">=": value >= x, "<=": value <= x, ">": value > x, "<": value < x, "==": value == x, "!=": value != x}[m[1]]
    return F.when(value.isNull() | F.isnan(value), "inconclusive").when(test, "supported").otherwise("refuted")


def record_filter(column: Column, expected, is_array: bool = False) -> Column:
    """Filter of a record store: common element for two lists, membership for one, equality for none."""
    many = isinstance(expected, (list, tuple))
    if is_array:
        return F.arrays_overlap(column, F.array(*map(F.lit, expected if many else [expected])))
    return column.isin(*expected) if many else column == F.lit(expected)


def positive_mean(scores: Column, otherwise: Column) -> Column:
    """Mean of the positive scores, else ``otherwise``, to two places."""
    pos = F.filter(scores, lambda x: x > 0)
    return F.round(F.when(F.size(pos) > 0, F.aggregate(pos, F.lit(0.0), lambda a, x: a + x) / F.size(pos)).otherwise(otherwise), 2)


def token_estimate(c: Column) -> Column:
    """A quarter of the length, half to even, at least one."""
    return F.greatest(F.lit(1), F.bround(F.length(c) / 4, 0).cast("int"))


def stripped_html(c: Column) -> Column:
    """Text of an HTML document: no scripts and styles, block tags as line ends."""
    t = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?i)<(/?(p|div|br|li|h[1-6]|tr|section|article))\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")


def latex_sections(c: Column) -> Column:
    """Array of struct(title, text) of a TeX source without its comments."""
    clean = F.regexp_replace(c, r"(?m)(?<!\\)%.*$", "")
    parts = F.slice(F.split(clean, r"\\(?:sub)*section\*?\{"), F.lit(2), F.size(F.split(clean, r"\\(?:sub)*section\*?\{")))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^([^}]*)\}", 1).alias("title"), F.trim(F.regexp_replace(p, r"^[^}]*\}", "")).alias("text")))


def formulas(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?s)\\begin\{(?:equation|align)\*?\}\s*(.*?)\s*\\end\{(?:equation|align)\*?\}"), F.lit(1))
