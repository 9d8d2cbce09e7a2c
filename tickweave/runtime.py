"""Session, shared-folder and skew helpers that every operator uses."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "tickweave", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session in UTC with AQE; values that the launcher has set are kept."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = b.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return ship(b.getOrCreate())


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application, wherever they run. Arrow functions name its
    modules, so a cluster whose workers don't have it on their path needs this first."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="tickweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(f"{folder}/tickweave_package.zip", "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(f"{folder}/tickweave_package.zip")  # the driver serves it to the executors
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session, or, only if that is
    unset (tests, one machine), a temporary one that is removed at exit."""
    jsc = spark.sparkContext._jsc.sc()
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        if jsc.getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(given)
        return given
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tickweave-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


_WORK: set[str] = set()


def work_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if path not in _WORK:
        _WORK.add(path)
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may have been stopped before
        pass


def written(df: DataFrame, name: str, clean: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` as a zstd Parquet table in the shared folder and read it again.
    The table survives the loss of executors and is a fraction of a row checkpoint's size.
    ``clean`` removes the shuffle files of the write when it ends, not when the driver next collects its garbage."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(_CLEANUP, None) if clean else None
    if clean:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if clean:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out._written_at = path
    return out


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` returned, when nothing that is still to be computed reads them."""
    for t in tables:
        _remove(t.sparkSession, t._written_at)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def skew_join(big: DataFrame, small: DataFrame, keys: list[str], n: str, parts: int = 1000) -> DataFrame:
    """Inner join of ``big`` with ``small`` (one row per key, ``n`` = rows of the key in ``big``).
    Keys above a ``parts``-th of all rows are joined by broadcast (at most ``parts`` rows), so that no
    task gets a hot key whole; the others by an ordinary shuffle join. Null keys match nothing."""
    total = small.agg(F.sum(n)).first()[0] or 0
    is_hot = F.col(n) > F.lit(total / parts)
    hot = small.filter(is_hot)
    if hot.isEmpty():
        return big.join(small, keys)
    names = F.broadcast(hot.select(*keys))
    return big.join(F.broadcast(hot), keys).unionByName(big.join(names, keys, "left_anti").join(small.filter(~is_hot), keys))


def spread_join(left: DataFrame, right: DataFrame, key: str, hot: int = 10_000) -> DataFrame:
    """Inner join of two sides of which both may repeat a key. Rows of a key that either side has more than ``hot``
    times fall into parts of about ``hot`` on each side, and each two parts meet by themselves, so that no task gets a
    hot key whole. The result is the same for every ``hot``."""
    a, b = (d.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.count("*").alias(n)) for d, n in ((left, "__a"), (right, "__b")))
    many = written(a.join(b, "__k").filter(F.greatest("__a", "__b") > hot), "hot-keys")
    if many.isEmpty():
        return left.join(right, key)
    of = lambda c: F.ceil(F.col(c) / hot).cast("int")
    part = lambda c: F.floor(F.rand(7) * of(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), of(c) - 1))
    on = F.col(key) == F.col("__k")
    # Parts are drawn before rows are repeated, and written: drawn anew for a lost task they would not fit together.
    x = written(left.join(many, on).withColumn("__i", part("__a")).drop("__k", "__a"), "hot-left").withColumn("__j", every("__b")).drop("__b")
    y = written(right.join(many, on).withColumn("__j", part("__b")).drop("__k", "__b"), "hot-right").withColumn("__i", every("__a")).drop("__a")
    usual = left.join(many, on, "left_anti").join(right, key)
    return usual.unionByName(x.join(y, [key, "__i", "__j"]).drop("__i", "__j"))


def wall_micros(ts: Column) -> Column:
    """Microseconds since midnight of a timestamp's wall clock, with or without zone."""
    return (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long") * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def finite(c: Column) -> Column:
    """NaN and infinities as null: null is the only missing value inside the engine."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)
