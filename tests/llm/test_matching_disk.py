"""The matching keeps on disk what is still to be read, and its parts and passes change no pair."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tickweave.runtime import work_dir

M = pytest.importorskip("tickweave.llm.matching")


def _entities(spark, mark, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    rows = [(f"{mark}{i}", " ".join(r.sample(words, 6)), [] if i % 3 == 0 else [f"Xan Bo{r.randrange(9)}", f"Yor Ke{r.randrange(9)}"], r.choice([None, 2010, 2012])) for i in range(60)]
    d = spark.createDataFrame(rows, "id string, title string, names array<string>, year int")
    return M.written(M.entities(d, F.col("id"), F.col("title"), F.col("names"), None, F.col("year"), F.lit(None).cast("string"), F.struct(F.lit(1).alias("t"))), "e")


def _tables(spark, name):
    return {p.name for p in Path(work_dir(spark).removeprefix("file:")).glob(f"{name}-*")}


@pytest.mark.filterwarnings("ignore:belief propagation")
def test_each_round_replaces_the_last(spark, monkeypatch):
    monkeypatch.setattr(M, "ROUNDS", 3)
    pairs = spark.createDataFrame([(f"a{i}", f"b{j}", 1.0 + (i * 7 + j) % 3) for i in range(6) for j in range(6)], "a string, b string, s double")
    before = _tables(spark, "beliefs")
    assert M.propagate(pairs).count() == 36
    assert len(_tables(spark, "beliefs") - before) == 1


def test_parts_and_passes_change_nothing(spark, monkeypatch):
    a, b = _entities(spark, "A", 1), _entities(spark, "B", 2)
    pairs = M.candidates(a, b)
    rows = lambda d: sorted(map(tuple, d.collect()))
    whole, found = rows(M.evidence(pairs, a, b)), rows(M._title_keys(a, b))
    assert rows(M.evidence(pairs, a, b, len(whole) // 2)) == whole and len(whole) > 100
    monkeypatch.setattr(M, "PASS", 7)
    assert rows(M._title_keys(a, b)) == found and len(found) == len(set(found)) > 50
