"""Batches leave little in the driver, and the session as it was."""

import pytest

D = pytest.importorskip("tickweave.llm.incremental")


def test_batches_are_released_and_settings_restored(spark, monkeypatch):
    rows = [(1, 0, "x", "f", [1.0]), (2, 1, "x", "f", [1.0]), (3, 1, "x", "f", [9.0]), (4, 2, "x", "f", [9.1])]
    records = spark.createDataFrame(rows, "rec_id long, batch_no int, direction string, skeleton string, numbers array<double>")
    name, seen, released, free = "spark.sql.codegen.wholeStage", [], [], D._release

    class Index(D.BatchIndex):
        def probe(self, classes):
            seen.append(spark.conf.get(name))
            return super().probe(classes)

    monkeypatch.setattr(D, "_release", lambda s: (released.append(1), free(s)))
    before = spark.conf.get(name)
    assert {tuple(r) for r in D.deduplicate(records, Index(spark)).collect()} == {(1, 2), (3, 4)}
    assert seen == ["false", "false"] and spark.conf.get(name) == before and len(released) == 4
