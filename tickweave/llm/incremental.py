"""Duplicates of new batches against all that was accepted, over an incremental inverted index."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.operators.prefix import canonical_skeleton
from tickweave.runtime import skew_join, work_dir, written

#: Numbers may differ by this share of the larger one; buckets are a hair wider, so that such numbers lie in
#: the same bucket or in neighbouring ones.
TENTH = 10
_WIDTH = "(ln(10.0D / 9.0D) * (1 + 1e-9D))"
#: Postings of one partition of a segment, partitions of a segment, segments before small ones are merged, and
#: postings of one token that a task reads.
PART_ROWS, MAX_PARTS, MAX_SEGMENTS, HOT = 2000, 4096, 16, 10_000


def readable(df: DataFrame, rec: Column, batch: Column, expression: Column, direction: Column) -> DataFrame:
    """rec_id, batch_no, direction, skeleton, numbers of each readable record; null direction is ``unknown``.
    Records with a null id or batch or an unreadable expression are left out. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = [canonical_skeleton(t) for t in b.column(3).to_pylist()]
            b = b.filter(pa.array([f is not None for f in forms], pa.bool_()))
            forms = [f for f in forms if f]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([f[0] for f in forms], pa.string()), pa.array([f[1] for f in forms], pa.list_(pa.float64()))], ["rec_id", "batch_no", "direction", "skeleton", "numbers"])

    src = df.select(rec.cast("long").alias("rec_id"), batch.cast("int").alias("batch_no"), F.coalesce(direction.cast("string"), F.lit("unknown")).alias("direction"), expression.cast("string").alias("e"))
    return src.dropna(subset=["rec_id", "batch_no", "e"]).mapInArrow(run, "rec_id long, batch_no int, direction string, skeleton string, numbers array<double>")


def _tokens(classes: DataFrame) -> DataFrame:
    """A row per class and token: a token is a number in its place of the form, known by its sign and the bucket of
    its size; ``form`` is a second hash of the form. A class without numbers has one token."""
    x = classes.selectExpr("rec_id", "numbers", "xxhash64(1, skeleton, direction) as form", "xxhash64(direction, skeleton) as base", "posexplode_outer(numbers) as (pos, v)")
    return x.selectExpr("*", "coalesce(int(signum(v)), 9) as sign", f"case when v != 0 then int(floor(ln(abs(v)) / {_WIDTH})) else 0 end as bucket").drop("v")


def _postings(classes: DataFrame) -> DataFrame:
    """(token, acc_id, form, numbers): 128 bits of hashes say which form and bucket; the form itself is not kept."""
    return _tokens(classes).selectExpr("xxhash64(base, pos, sign, bucket) as token", "rec_id as acc_id", "form", "numbers")


def _looked(classes: DataFrame) -> DataFrame:
    """(rec_id, form, n, pos, token): the tokens that a nearly equal class must have, three buckets for each number."""
    near = "explode(case when sign in (-1, 1) then array(bucket - 1, bucket, bucket + 1) else array(bucket) end) as bucket"
    return _tokens(classes).selectExpr("rec_id", "form", "numbers as n", "base", "pos", "sign", near).selectExpr("rec_id", "form", "n", "pos", "xxhash64(base, pos, sign, bucket) as token")


def _part(parts: int) -> str:
    """Partition of a token: its high bits (``parts`` is a power of two from 2 on)."""
    return f"int(shiftrightunsigned(token, {64 - (parts.bit_length() - 1)}))"


class BatchIndex:
    """An inverted index in a folder, in segments that are written once.

    An append writes one segment: its ``postings`` (token, class, form hash, numbers) and, beside them, its ``tokens``
    with the number of their postings, both partitioned by the high bits of the token into about PART_ROWS postings
    each, so that the number of partitions grows with the index. A row in ``manifest`` makes the segment visible.
    Where there are more than MAX_SEGMENTS, the smaller half is merged into one.

    A class is all records of one direction, skeleton and numbers; it is known by the smallest accepted rec_id. Two
    nearly equal classes share every token up to a neighbouring bucket, so of a probing class the prefix of one
    token, its rarest, is enough. A probe reads the counts and then the postings of the partitions its tokens fall in.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, part_rows: int = PART_ROWS):
        self.spark, self.folder, self.part_rows = spark, folder or f"{work_dir(spark)}/batch-index-{uuid.uuid4().hex}", part_rows

    _POSTINGS = "token long, acc_id long, form long, numbers array<double>, part int"
    _COUNTS = "token long, df long, part int"
    _MANIFEST = "segment string, parts int, rows long, merged array<string>"

    def segments(self) -> list[tuple[str, int, int]]:
        """(name, partitions, postings) of each visible segment, the oldest first."""
        try:
            rows = self.spark.read.schema(self._MANIFEST).parquet(f"{self.folder}/manifest").collect()  # a row per append
        except AnalysisException:  # nothing appended yet
            return []
        gone = {m for r in rows for m in r["merged"]}
        return sorted((r["segment"], r["parts"], r["rows"]) for r in rows if r["segment"] not in gone)

    def append(self, classes: DataFrame) -> None:
        """Add the postings of accepted classes (rec_id, direction, skeleton, numbers)."""
        rows = classes.agg(F.sum(F.greatest(F.size("numbers"), F.lit(1)))).first()[0] or 0
        if rows:
            self._write(_postings(classes), rows, [])
        old = self.segments()
        if len(old) > MAX_SEGMENTS:
            small = sorted(old, key=lambda x: x[2])[: len(old) // 2 + 1]
            self._write(self._read("postings", self._POSTINGS, None, small).drop("part"), sum(x[2] for x in small), [x[0] for x in small])

    def _write(self, postings: DataFrame, rows: int, merged: list[str]) -> None:
        name, parts = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}", 2
        while parts * self.part_rows < rows and parts < MAX_PARTS:
            parts *= 2
        # Rebalancing splits the partition of a hot token over several tasks.
        p = postings.withColumn("part", F.expr(_part(parts))).hint("rebalance", "part").sortWithinPartitions("part", "token")
        save = lambda d, kind: d.write.option("compression", "zstd").partitionBy("part").parquet(f"{self.folder}/{name}/{kind}")
        save(p, "postings")
        mine = self._read("postings", self._POSTINGS, None, [(name, parts, rows)])
        save(mine.groupBy("part", "token").agg(F.count("*").alias("df")).hint("rebalance", "part"), "tokens")
        self.spark.createDataFrame([(name, parts, rows, merged)], self._MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def _read(self, kind: str, schema: str, bits: set[int] | None, segments: list[tuple[str, int, int]] | None = None) -> DataFrame:
        """All segments, of each the partitions of the given token bits (of MAX_PARTS)."""
        found = [self.spark.createDataFrame([], schema)]
        for name, parts, _ in self.segments() if segments is None else segments:
            d = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/{kind}")
            if bits is not None:
                wanted = sorted({b // (MAX_PARTS // parts) for b in bits})
                d = d if len(wanted) == parts else d.filter(F.array_contains(F.lit(wanted) if wanted else F.array().cast("array<int>"), F.col("part")))
            found.append(d)
        return reduce(DataFrame.union, found[1:] or found)

    @staticmethod
    def _bits(tokens: DataFrame) -> set[int]:
        return {r[0] for r in tokens.selectExpr(_part(MAX_PARTS)).distinct().collect()}  # at most MAX_PARTS

    def touched(self, classes: DataFrame) -> DataFrame:
        """The postings that a probe of ``classes`` may read."""
        return self._read("postings", self._POSTINGS, self._bits(_looked(classes)))

    def probe(self, classes: DataFrame) -> DataFrame:
        """(rec_id, acc_id, exact): every accepted class of smaller id that a class equals or nearly equals."""
        looked = written(_looked(classes), "looked")
        segments = self.segments()
        counts = self._read("tokens", self._COUNTS, self._bits(looked), segments).select("token", "df")
        prefixes = written(_rarest(looked, counts), "prefixes")
        return _meet(prefixes, self._read("postings", self._POSTINGS, self._bits(prefixes), segments).drop("part"))


def pairs_within(classes: DataFrame) -> DataFrame:
    """(rec_id, acc_id, exact) of every two nearly equal classes of one batch."""
    own = written(_postings(classes), "own")
    return _meet(written(_rarest(_looked(classes), own.groupBy("token").agg(F.count("*").alias("df"))), "prefixes"), own)


def _rarest(looked: DataFrame, counts: DataFrame) -> DataFrame:
    """(rec_id, form, n, token, df): of each class the one place whose buckets have fewest postings, and those of
    its tokens that have some. A class with a place of none equals nothing."""
    places = looked.join(counts, "token", "left").groupBy("rec_id", "pos").agg(
        F.first("form").alias("form"), F.first("n").alias("n"), F.sum(F.coalesce("df", F.lit(0))).alias("cost"), F.collect_list(F.when(F.col("df") > 0, F.struct("token", "df"))).alias("t")
    )  # at most three tokens of each segment
    best = places.groupBy("rec_id").agg(F.min_by(F.struct("form", "n", "cost", "t"), F.struct("cost", "pos")).alias("b")).filter("b.cost > 0")
    return best.select("rec_id", "b.form", "b.n", F.explode("b.t").alias("t")).groupBy("rec_id", "form", "n", "t.token").agg(F.sum("t.df").alias("df"))


def _meet(prefixes: DataFrame, postings: DataFrame, hot: int = HOT) -> DataFrame:
    """Postings of the prefixes' tokens, filtered by length and form, then by every number. Tokens of more than
    ``hot`` postings are spread over as many tasks as that takes."""
    near = f"forall(zip_with(n, numbers, (x, y) -> {TENTH} * abs(x - y) <= greatest(abs(x), abs(y))), z -> z)"
    posted = postings.withColumnRenamed("form", "f")
    most = prefixes.agg(F.max("df")).first()[0] or 0
    if most <= hot:
        met = prefixes.join(posted, "token")
    else:
        salts = -(-most // hot)
        met = prefixes.filter(F.col("df") <= hot).join(posted, "token").drop("token")
        split = prefixes.filter(F.col("df") > hot).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1).cast("int"))))
        met = met.unionByName(split.join(posted.withColumn("salt", F.pmod(F.xxhash64("acc_id"), F.lit(salts)).cast("int")), ["token", "salt"]).drop("token", "salt"))
    return met.filter("acc_id < rec_id and size(n) = size(numbers) and f = form").filter(near).selectExpr("rec_id", "acc_id", "n = numbers as exact").distinct()


def _choice(pairs: DataFrame) -> DataFrame:
    """The accepted class that a class repeats: an equal one, else the nearly equal one of smallest id."""
    return pairs.groupBy("rec_id").agg(F.min(F.struct((~F.col("exact")).cast("int").alias("near"), "acc_id")).alias("x")).selectExpr("rec_id", "x.acc_id as first_id")


def _settled(pairs: DataFrame) -> DataFrame:
    """(rec_id, first_id) of the classes of one batch that repeat an accepted class of the same batch.

    ``pairs`` (rec_id, acc_id, exact) links each class to the earlier ones of its batch that it nearly equals; in
    the order of ids a class is accepted if none of them is. Each round accepts every class without an undecided
    earlier one; the rounds are as many as the longest chain of changing verdicts.
    """
    done: list[DataFrame] = []
    left = written(pairs, "undecided")
    while not left.isEmpty():
        open_ids = left.select(F.col("rec_id").alias("acc_id")).distinct()
        hit = left.join(open_ids, "acc_id", "left_anti")  # links to classes that are now accepted
        new = written(_choice(hit), "settled")
        done.append(new)
        repeats = new.select("rec_id")
        left = written(left.join(repeats, "rec_id", "left_anti").join(repeats.withColumnRenamed("rec_id", "acc_id"), "acc_id", "left_anti"), "undecided")
    return reduce(DataFrame.unionByName, done) if done else left.selectExpr("rec_id", "acc_id as first_id")


@contextmanager
def _small_jobs(spark: SparkSession) -> Iterator[None]:
    """Many small jobs, of which the driver keeps little: plans are run without classes of their own."""
    name = "spark.sql.codegen.wholeStage"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _release(spark: SparkSession) -> None:
    """Free what a batch left in the driver (plans, broadcast tables, classes); else its heap grows to its limit, since
    a batch leaves more than a collection of the young generation takes."""
    gc.collect()  # Python's references to the JVM's objects
    spark.sparkContext._jvm.System.gc()


def deduplicate(records: DataFrame, index: BatchIndex) -> DataFrame:
    """(first_id, dup_id): each record of batch 1 and later that repeats an accepted record of smaller id.

    ``records`` as from ``readable``. Batch 0 is accepted whole; later batches go one after the other against
    the index, which then takes the classes they add. If several accepted records are repeated, ``first_id`` is
    the smallest of an equal form, else the smallest of a nearly equal form. Repeated rows are repeats; records
    that tie on rec_id are one record. Empty input: no rows.
    """
    with _small_jobs(records.sparkSession):
        return _deduplicate(records, index)


def _deduplicate(records: DataFrame, index: BatchIndex) -> DataFrame:
    form = ["direction", "skeleton", "numbers"]
    records = written(records, "readable")
    groups = written(records.groupBy("batch_no", *form).agg(F.min("rec_id").alias("rec_id"), F.count("*").alias("n")), "classes")
    numbers = sorted(r[0] for r in groups.select("batch_no").distinct().collect())  # batches, not records
    verdicts = []
    for no in numbers:
        _release(records.sparkSession)
        classes = groups.filter(F.col("batch_no") == no).select("rec_id", *form)
        if no <= 0:
            index.append(classes)
            continue
        old = written(_choice(index.probe(classes)), "repeats")
        fresh = written(classes.join(old.select("rec_id"), "rec_id", "left_anti"), "fresh")
        within = _settled(pairs_within(fresh))
        verdicts += [old, within]
        index.append(fresh.join(within.select("rec_id"), "rec_id", "left_anti"))
    known = reduce(DataFrame.unionByName, verdicts, records.sparkSession.createDataFrame([], "rec_id long, first_id long"))
    later = groups.filter("batch_no > 0").join(known, "rec_id", "left").withColumn("first_id", F.coalesce("first_id", "rec_id")).drop("rec_id")
    _release(records.sparkSession)
    rows = records.filter("batch_no > 0").withColumnRenamed("rec_id", "dup_id")
    return skew_join(rows, later, ["batch_no", *form], "n").filter("dup_id > first_id").select("first_id", "dup_id").distinct()
