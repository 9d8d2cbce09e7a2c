"""Duplicates hidden by formatting: collapse raw rows, canonicalise the survivors, group again."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.runtime import skew_join, written


def canonical_text(s: str) -> str:
    """Only letters and digits, in one case and one Unicode notation."""
    s = "".join(c for c in s if unicodedata.category(c) != "Cf")
    s = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", s).casefold())
    return "".join(c for c in s if c.isalnum())


def _canonical_series(texts: pd.Series) -> pd.Series:
    return texts.map(canonical_text, na_action="ignore")


_ASCII = r"^[\x00-\x7F]*$"


def _plain(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^0-9A-Za-z]", ""))


def survivors(df: DataFrame, rec: str, fields: list[str]) -> DataFrame:
    """The distinct raw rows: f0.. (raw), c0.. (canonical), first (smallest ``rec``), n (rows).

    Byte-identical rows go first, counted on the map side; only what survives is canonicalised, plain
    ASCII inside the JVM and the rest in Arrow batches. Rows with a null field are left out.
    """
    f = [f"f{i}" for i in range(len(fields))]
    raw = df.select(F.col(rec).alias("rec"), *(F.col(x).cast("string").alias(y) for x, y in zip(fields, f))).dropna(subset=["rec", *f])
    d = raw.groupBy(*f).agg(F.min("rec").alias("first"), F.count("*").alias("n"))
    ascii_row = F.lit(True)
    for x in f:
        ascii_row = ascii_row & F.col(x).rlike(_ASCII)
    d = written(d, "survivors")
    canonical = F.pandas_udf(_canonical_series, "string")
    easy = d.filter(ascii_row).select("*", *(_plain(F.col(x)).alias(f"c{i}") for i, x in enumerate(f)))
    hard = d.filter(~ascii_row).select("*", *(canonical(F.col(x)).alias(f"c{i}") for i, x in enumerate(f)))
    return easy.unionByName(hard)


def collapse(df: DataFrame, rec: str, fields: list[str]) -> DataFrame:
    """One row per record: first_id (smallest ``rec``), the ``fields`` of that row, n_copies, n_notations.

    Two rows are one record if every field is equal when only letters and digits count. A field without any
    letter or digit equals any other such field. Null fields: the row is in no record. Empty input: no rows.
    """
    s = survivors(df, rec, fields)
    c, f = [[f"{k}{i}" for i in range(len(fields))] for k in "cf"]
    g = s.groupBy(*c).agg(F.min(F.struct("first", *f)).alias("x"), F.sum("n").alias("n_copies"), F.count("*").alias("n_notations"))
    return g.select(F.col("x.first").alias("first_id"), *(F.col(f"x.f{i}").alias(x) for i, x in enumerate(fields)), "n_copies", "n_notations")


def copies(df: DataFrame, rec: str, fields: list[str]) -> DataFrame:
    """(first_id, copy_id) of each row of a record but its first. Rules as in ``collapse``.

    The way back from records to rows is two joins by keys of which one side is unique; keys that hold more
    than a thousandth of the rows are joined by a broadcast of at most a thousand rows.
    """
    c, f = [[f"{k}{i}" for i in range(len(fields))] for k in "cf"]
    s = written(survivors(df, rec, fields), "canonical")
    g = s.groupBy(*c).agg(F.min("first").alias("first_id"), F.sum("n").alias("rows"), F.count("*").alias("notations")).filter("rows > 1").drop("rows")
    m = written(skew_join(s, g, c, "notations").select(*f, "first_id", "n"), "notations")
    raw = df.select(F.col(rec).alias("copy_id"), *(F.col(x).cast("string").alias(y) for x, y in zip(fields, f))).dropna()
    return skew_join(raw, m, f, "n").filter("copy_id != first_id").select("first_id", "copy_id")
