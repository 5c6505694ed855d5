"""Where documents and generations of entries are written."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .entries import usable

DAEMON, INFO = 3, 6  # fixed values: syslog facility and level
MANIFEST = "built_at long, rows long, checksum long, buckets int"


def index_name(processed: Column, prefix: str, zone: str = "UTC") -> Column:
    """<prefix>-YYYY-MM-DD by the day of ingestion in the operator's zone."""
    return F.concat(F.lit(f"{prefix}-"), F.date_format(F.from_utc_timestamp(processed.cast("timestamp"), zone), "yyyy-MM-dd"))


def write_daily(docs: DataFrame, path: str, *, prefix: str = "hostlens", zone: str = "UTC", format: str = "parquet", processed: Column | None = None) -> None:
    """Appends, a folder a day of ingestion: now, or as ``processed`` says."""
    named = docs.withColumn("index_name", index_name(F.current_timestamp() if processed is None else processed, prefix, zone))
    named.write.partitionBy("index_name").mode("append").format(format).save(path)


def syslog_lines(docs: DataFrame, *, level: int = INFO, facility: int = DAEMON) -> DataFrame:
    """``value``: the priority and the document as JSON."""
    return docs.select(F.concat(F.lit(f"<{level + facility * 8}>"), F.to_json(F.struct(*(f"`{c}`" for c in docs.columns)))).alias("value"))


def checksum_columns() -> list[Column]:
    """``rows`` and ``checksum``, an aggregate that doesn't depend on order (60 bits of MD5)."""
    row = F.concat_ws("\t", "domain", F.array_join("categories", "|"), F.array_join("sources", "|"))
    sums = F.bit_xor(F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("long"))
    return [F.count("*").alias("rows"), F.coalesce(sums, F.lit(0)).alias("checksum")]


def checksum(entries: DataFrame) -> DataFrame:
    """One row (``rows``, ``checksum``)."""
    return entries.agg(*checksum_columns())


def publish(entries: DataFrame, root: str, *, built_at: int | None = None, needed: Sequence[str] = (), least: int = 0, keep: int = 2, buckets: int | None = None) -> int:
    """Writes a generation beside the others, checks it, then lets the manifest name it.

    Rows are summed up while they are written and again as they are read back; where the
    two differ, or the generation fails the gate (over ``least`` rows, and all ``needed``
    domains), it is refused and the published one stays. The manifest only grows: its
    newest row counts, and comes with the commit of one file, so readers always meet
    one. Of the published generations the ``keep`` newest stay, for readers that are under
    way (0: all); other folders, those of builds that were cut short among them, are
    removed, and a refused one at once.

    With ``buckets`` the rows are dealt by domain and sorted in each bucket by their
    reversed labels: look-ups then join without moving them, and what is below a domain is
    a range of each bucket.
    """
    spark = entries.sparkSession
    built_at = int(time.time()) if built_at is None else built_at
    path = f"{root}/generation={built_at}"
    if (was := manifest(spark, root)) and was["built_at"] >= built_at:
        raise ValueError(f"{root}: generation {was['built_at']} is published; {built_at} is not newer")
    given = Observation()
    out = entries.observe(given, *checksum_columns()).write.mode("overwrite")
    if buckets:
        name = f"build_{uuid.uuid4().hex}"
        out.format("parquet").bucketBy(buckets, "domain").sortBy("reversed" if "reversed" in entries.columns else "domain").option("path", path).saveAsTable(name)
        spark.sql(f"drop table {name}")  # its files stay
    else:
        out.parquet(path)
    stored = spark.read.schema(entries.schema).parquet(path)
    found = checksum(stored).first()
    why = None
    if (found["rows"], found["checksum"]) != (given.get["rows"], given.get["checksum"]):
        why = "what was written is not what was given"
    elif not usable(stored, "domain", list(needed), least).first()["usable"]:
        why = f"not usable: {found['rows']} rows"
    if why:
        remove(spark, path)
        raise ValueError(f"{path}: {why}")
    row = spark.createDataFrame([(built_at, found["rows"], found["checksum"], buckets)], MANIFEST)
    row.coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    if keep:
        stay = {r["built_at"] for r in published(spark, root)[:keep]}
        for old in generations(spark, root):
            if old not in stay and old <= built_at:
                remove(spark, f"{root}/generation={old}")
    return built_at


def folder_of(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def generations(spark: SparkSession, root: str) -> list[int]:
    """All that are stored, old ones first."""
    p, fs = folder_of(spark, root)
    names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.removeprefix("generation=")) for n in names if n.startswith("generation="))


def children(spark: SparkSession, path: str, depth: int = 1) -> list[str]:
    """Names below a folder, ``depth`` levels deep."""
    p, fs = folder_of(spark, path)
    names = [x.getPath().getName() for x in fs.listStatus(p)]
    names = sorted(n for n in names if n[0] not in "._")
    return names if depth == 1 else [f"{n}/{below}" for n in names for below in children(spark, f"{path}/{n}", depth - 1)]


def move(spark: SparkSession, old: str, new: str) -> None:
    (a, fs), (b, _) = folder_of(spark, old), folder_of(spark, new)
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"{old} can't become {new}")


def remove(spark: SparkSession, path: str) -> None:
    p, fs = folder_of(spark, path)
    fs.delete(p, True)


def published(spark: SparkSession, root: str) -> list[dict]:
    """The manifest's rows, the newest first; none before anything was published."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").orderBy(F.desc("built_at")).collect()  # one a build
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    return [r.asDict() for r in rows]


def manifest(spark: SparkSession, root: str) -> dict | None:
    """The newest row; null before anything was published."""
    return next(iter(published(spark, root)), None)


def is_stale(spark: SparkSession, root: str, generation: int | None) -> bool:
    m = manifest(spark, root)
    return m is not None and m["built_at"] != generation


def read_generation(spark: SparkSession, root: str, *, built_at: int | None = None, check: bool = True) -> DataFrame:
    """The entries of a published generation, the newest where none is asked for; refuses
    those whose checksum differs."""
    rows = published(spark, root)
    m = next((r for r in rows if built_at in (None, r["built_at"])), None)
    if m is None:
        raise ValueError(f"{root}: nothing published" if built_at is None else f"{root}: {built_at} is not published")
    entries = _stored(spark, f"{root}/generation={m['built_at']}", m["buckets"])
    if check:
        got = checksum(entries).first()
        if (got["rows"], got["checksum"]) != (m["rows"], m["checksum"]):
            raise ValueError(f"{root}: generation {m['built_at']} is damaged")
    return entries


def _stored(spark: SparkSession, path: str, buckets: int | None) -> DataFrame:
    """A generation's files; with buckets as a table that says how they are dealt."""
    files = spark.read.parquet(path)
    if not buckets:
        return files
    name = f"generation_{hashlib.sha256(path.encode()).hexdigest()[:24]}"
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
        by = "reversed" if "reversed" in files.columns else "domain"
        spark.sql(f"create table {name} ({columns}) using parquet clustered by (domain) sorted by ({by}) into {int(buckets)} buckets location '{path}'")
    return spark.table(name)
