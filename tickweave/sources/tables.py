"""Sources and sinks: Parquet globs, metric files, JSON lines, feeds, products, checkpoints, access contracts."""

from __future__ import annotations

import fnmatch
import hashlib
import io
import json
import re
import tarfile
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

METRICS = StructType(
    [StructField(n, StringType()) for n in ("factor_name", "factor_field", "code")]
    + [StructField("horizon", StringType()), StructField("segment", StringType()), StructField("n_dates", LongType()), StructField("n_obs", LongType())]
    + [StructField(n, DoubleType()) for n in ("daily_ic", "daily_rankic", "global_ic", "global_rankic", "qspread_mean", "finite_ratio", "zero_ratio")]
)


# reading ---------------------------------------------------------------------------------------------------------


def snapshot(spark: SparkSession, root: str | Sequence[str], schema: StructType | None = None) -> DataFrame:
    """A snapshot partitioned by ``updated_date=*``, one file, or a list of files; partitions prune."""
    r = spark.read.schema(schema) if schema else spark.read
    if isinstance(root, str):
        return r.option("recursiveFileLookup", "false").parquet(root)
    if not root:
        raise FileNotFoundError("no snapshot files")
    base = root[0].split("/updated_date=")[0]
    return (r.option("basePath", base) if "/updated_date=" in root[0] else r).parquet(*root)


def tick_path(root: str, date: str, code: str) -> str:
    """Place of one code's day; the code in any notation."""
    digits = re.sub(r"[^0-9]", "", code)
    if not digits:
        raise ValueError(f"no code: {code!r}")
    return f"{root}/{re.sub(r'[^0-9]', '', date)}/{digits.zfill(6)}.parquet"


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """Stock-level metrics from JSON, CSV or Parquet; blanks are null, other texts in number columns too."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        raw = spark.read.parquet(path)
    elif kind == "csv":
        raw = spark.read.option("header", "true").csv(path)
    elif kind in ("json", "jsonl"):
        raw = spark.read.option("multiLine", str(kind == "json").lower()).json(path)
    else:
        raise ValueError(f"no reader for .{kind}")
    have = set(raw.columns)
    cell = lambda f: (F.nullif(F.trim(F.col(f.name).cast("string")), F.lit("")) if f.name in have else F.lit(None).cast("string")).try_cast(f.dataType).alias(f.name)
    return raw.select(*map(cell, METRICS.fields))


def json_lines(spark: SparkSession, path: str, schema: StructType, strict: bool = True) -> DataFrame:
    """Records of a JSON lines file; a line that is no record fails the read, or with ``strict=False`` is dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def broken_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The lines that a lenient read drops."""
    s = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    x = spark.read.text(path).select(F.from_json("value", s, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return x.select("r._corrupt_record").filter("_corrupt_record is not null")


def open_records(spark: SparkSession, path: str, known: StructType) -> DataFrame:
    """Known columns of JSON lines and all other keys in ``_extra``, a map of text."""
    x = spark.read.text(path).select(F.from_json("value", known).alias("k"), F.from_json("value", "map<string,string>").alias("m")).filter("m is not null")
    return x.select("k.*", F.map_filter("m", lambda k, _: ~k.isin(*known.fieldNames())).alias("_extra"))


def feed_entries(payload: bytes) -> list[dict[str, str]]:
    """Entries of an RSS, RDF or Atom document: title, summary, url, published."""
    try:
        root = ET.fromstring(payload)
    except ET.ParseError:
        return []
    name = lambda e: e.tag.rsplit("}", 1)[-1].lower()
    out = []
    for item in (e for e in root.iter() if name(e) in ("item", "entry")):
        got: dict[str, str] = {}
        for c in item:
            n, text = name(c), "".join(c.itertext()).strip()
            if n == "title":
                got["title"] = text
            elif n in ("description", "summary", "content") and text:
                got.setdefault("summary", text)
            elif n == "link":
                got.setdefault("url", c.get("href") or text)
            elif n in ("pubdate", "published", "updated", "date"):
                got.setdefault("published", text)
        out.append({k: got.get(k, "") for k in ("title", "summary", "url", "published")})
    return out


def xml_text(c: Column) -> Column:
    """Text as XML character data: marks escaped, a carriage return by number; characters that no XML 1.0 document
    may hold are left out."""
    t = F.regexp_replace(c, r"[^\t\n\r\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def feeds(files: DataFrame) -> DataFrame:
    """Entries of binary files (path, content) that hold feeds; others give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, e["title"], e["summary"], e["url"], e["published"]) for p, c in zip(b["path"], b["content"]) for e in feed_entries(bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "title", "summary", "url", "published"])

    return files.select("path", "content").mapInPandas(run, "path string, title string, summary string, url string, published string")


def tex_members(payload: bytes, most_bytes: int = 5_000_000, most: int = 8) -> list[tuple[str, str]]:
    """The largest TeX members of a tar or gzip archive, none above ``most_bytes``; a bare text counts as one."""
    try:
        with tarfile.open(fileobj=io.BytesIO(payload)) as t:
            own = [m for m in t.getmembers() if m.isfile() and m.name.lower().endswith((".tex", ".txt")) and m.size <= most_bytes]
            own = sorted(own, key=lambda m: (-m.size, m.name))[:most]
            return [(m.name, t.extractfile(m).read().decode("utf-8", "replace")) for m in own]
    except (tarfile.TarError, OSError, EOFError):
        import gzip

        try:
            payload = gzip.decompress(payload)
        except (OSError, EOFError):
            pass
        return [("main.tex", payload[:most_bytes].decode("utf-8", "replace"))] if b"\\" in payload else []


def tex_archives(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, n, t) for p, c in zip(b["path"], b["content"]) for n, t in tex_members(bytes(c))], columns=["path", "member", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, member string, text string")


def local_documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files of a folder with an id: the first 16 hex digits of the path's SHA-1."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return f.select(F.substring(F.sha1("path"), 1, 16).alias("doc_id"), "path", "length", "content")


# manifests and checkpoints ---------------------------------------------------------------------------------------


def manifest_range(manifest: DataFrame, first: str, last: str) -> DataFrame:
    return manifest.filter(F.col("updated_date").between(first, last))


def evenly_spaced(n: int, count: int) -> list[int]:
    """Places of ``count`` of ``n`` files at even distances, both ends included."""
    if count >= n:
        return list(range(n))
    return [0] if count == 1 else sorted({round(i * (n - 1) / (count - 1)) for i in range(count)})


def shard(manifest: DataFrame, order: str, index: int, count: int) -> DataFrame:
    """Every ``count``-th file from ``index`` on, in order of the path (a manifest is a small table)."""
    from pyspark.sql import Window as W

    return manifest.withColumn("__i", F.row_number().over(W.orderBy(order)) - 1).filter(F.col("__i") % count == index).drop("__i")


def unfinished(files: DataFrame, done: DataFrame, config_hash: str) -> DataFrame:
    """Files (path, sha) without a checkpoint of the same content and configuration."""
    d = done.filter(F.col("config_hash") == config_hash).select("path", "sha").distinct()
    return files.join(d, ["path", "sha"], "left_anti")


def channel_counts(pages: DataFrame, ident: str, channel: str) -> tuple[DataFrame, DataFrame]:
    """Rows of fetched pages with each id once (of the first channel), and the rows of each channel."""
    one = pages.groupBy(ident).agg(F.min(F.struct(channel, *(c for c in pages.columns if c not in (ident, channel)))).alias("r")).select(ident, "r.*")
    return one, pages.groupBy(channel).agg(F.count("*").alias("n"), F.countDistinct(ident).alias("n_ids"))


# writing ---------------------------------------------------------------------------------------------------------


def write_product(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Zstd Parquet; the commit protocol makes it visible as a whole or not at all."""
    w = df.write.mode(mode).option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)


def products(rows: DataFrame, specs: Mapping[str, tuple[Column | None, Sequence[str]]], root: str) -> dict[str, str]:
    """Fan one table out into products (filter, columns), each in its folder; the parent is written once."""
    from tickweave.runtime import written

    parent = written(rows, "products")
    for name, (cond, cols) in specs.items():
        write_product((parent if cond is None else parent.filter(cond)).select(*cols), f"{root}/{name}")
    return {name: f"{root}/{name}" for name in specs}


def append_records(df: DataFrame, path: str, ident: str, now: str, version: str = "1") -> None:
    """Append to a JSON lines store with its defaults: schema_version, an id, created_at and updated_at."""
    have = set(df.columns)
    plain = F.to_json(F.struct(*df.columns))
    new = {"schema_version": F.lit(version), ident: F.concat(F.lit(f"{ident}_"), F.substring(F.sha2(plain, 256), 1, 16)), "created_at": F.lit(now), "updated_at": F.lit(now)}
    df.withColumns({k: c if k not in have else F.coalesce(F.col(k), c) for k, c in new.items()}).write.mode("append").json(path)


def rewrite_records(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Replace a store: written beside it first, then moved into its place, so that a failed job leaves the old one."""
    jvm = spark._jvm.org.apache.hadoop.fs
    staging, target = jvm.Path(path + ".new"), jvm.Path(path)
    df.write.mode("overwrite").json(path + ".new")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(target, True)
    if not fs.rename(staging, target):
        raise OSError(f"{path} could not be replaced")


def by_status(df: DataFrame, status: str, path: str) -> DataFrame:
    """A folder per status, and the number of rows of each."""
    write_product(df, path, [status])
    return df.groupBy(status).agg(F.count("*").alias("n"))


def experiment(result: DataFrame, daily: DataFrame, spec: Mapping[str, object], path: str) -> dict:
    """One-row result as JSON, daily rows as Parquet and a manifest with the hash of the specification."""
    write_product(daily, f"{path}/daily_metrics.parquet")
    result.coalesce(1).write.mode("overwrite").json(f"{path}/aggregate.json")
    text = json.dumps(dict(spec), sort_keys=True, separators=(",", ":"), default=str)
    return {"spec": json.loads(text), "spec_sha256": hashlib.sha256(text.encode()).hexdigest(), "files": ["daily_metrics.parquet", "aggregate.json"]}


@dataclass(frozen=True)
class Contract:
    """What a reader may touch: allowed paths, allowed and blocked columns, and content hashes; checked first."""

    paths: tuple[str, ...]
    allowed: tuple[str, ...] = ()
    blocked: tuple[str, ...] = ()
    sha256: Mapping[str, str] = field(default_factory=dict)

    def check(self, path: str, columns: Sequence[str], read: Callable[[str], bytes] | None = None) -> None:
        if not any(fnmatch.fnmatch(path, p) for p in self.paths):
            raise PermissionError(f"path outside the contract: {path}")
        bad = [c for c in columns if c in self.blocked or (self.allowed and c not in self.allowed)]
        if bad:
            raise PermissionError(f"columns outside the contract: {', '.join(bad)}")
        if path in self.sha256 and read is not None and hashlib.sha256(read(path)).hexdigest() != self.sha256[path]:
            raise ValueError(f"content of {path} has changed")
