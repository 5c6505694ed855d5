"""The next generation from the last one: only list files that changed are cleaned again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import reverse_labels, ws_strip
from . import entries as ent
from .sinks import publish, published, read_generation

FILE = ["folder", "source"]
ROWS = "domain string, category string, source string, folder string"


def digests(lines: DataFrame, configured: DataFrame) -> DataFrame:
    """(folder, source, n, digest, labels) of each list file.

    ``digest`` is a sum over the lines (60 bits of MD5 each), so their order does not
    matter and repeated lines do; ``labels`` are the categories that the configuration
    gives the file, as a change of these changes its rows as well.
    """
    bits = F.conv(F.substring(F.md5("line"), 1, 15), 16, 10).cast("decimal(20,0)")
    files = lines.groupBy(*FILE).agg(F.count("*").alias("n"), F.sum(bits).alias("digest"))
    named = configured.select("source", F.array_join(F.array_sort("categories"), "|").alias("_l"))
    return files.join(named, "source", "left").select(*FILE, "n", "digest", F.coalesce("_l", F.lit("")).alias("labels"))


@dataclass
class Kept:
    """What a build leaves for the next one: its files, where their rows are, and the rules."""

    files: DataFrame  # folder, source, n, digest, labels, at
    rows: DataFrame  # domain, category, source, folder, at
    ignored: DataFrame  # context, domain
    entries: DataFrame


def kept(spark: SparkSession, root: str) -> Kept | None:
    """Of the newest published generation; null where there is none or it kept nothing."""
    newest = next(iter(published(spark, root)), None)
    if newest is None:
        return None
    at = newest["built_at"]
    try:
        files = spark.read.parquet(f"{root}/files/at={at}")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    rows = spark.read.schema(f"{ROWS}, at long").option("basePath", f"{root}/rows").parquet(f"{root}/rows/at=*").join(files.select(*FILE, "at"), [*FILE, "at"], "left_semi")
    return Kept(files, rows, spark.read.parquet(f"{root}/ignored/at={at}"), read_generation(spark, root))


def build_next(lines: DataFrame, configured: DataFrame, ignorelist: DataFrame, root: str, *, built_at: int, tlds: DataFrame | None = None, **gate: object) -> int:
    """Publishes the generation of ``lines`` (source, folder, line) as a keyed merge.

    A file whose lines and categories are those of the last build keeps its rows, which
    are neither cleaned nor moved. Domains are merged again where a row of theirs came or
    went, or a rule of the ignorelist did; all others pass over as they are. The result is
    that of a full build; a first build is one. ``tlds`` must be the last build's.
    """
    spark = lines.sparkSession
    last = kept(spark, root)
    ignored = ignorelist.select("context", F.lower(ws_strip(F.col("host"))).alias("domain")).distinct()
    now = digests(lines, configured)
    now.write.mode("overwrite").parquet(f"{root}/digests/at={built_at}")  # read several times
    now = spark.read.parquet(f"{root}/digests/at={built_at}")
    facts = [*FILE, "n", "digest", "labels"]
    same = now.join(last.files.select(*facts, "at"), facts) if last else None
    fresh = now.join(same.select(*FILE), FILE, "left_anti") if last else now
    changed = lines.join(fresh.select(*FILE), FILE, "left_semi")
    made = ent.with_categories(ent.clean_lines(changed, tlds), configured)
    made.write.mode("overwrite").parquet(f"{root}/rows/at={built_at}")
    made = spark.read.schema(ROWS).parquet(f"{root}/rows/at={built_at}")
    files = fresh.withColumn("at", F.lit(built_at).cast("long"))
    files = files.unionByName(same.withColumn("at", F.col("at").cast("long"))) if last else files
    files.write.mode("overwrite").parquet(f"{root}/files/at={built_at}")
    ignored.write.mode("overwrite").parquet(f"{root}/ignored/at={built_at}")

    rows, rest = made, None
    if last:
        stay = last.rows.join(same.select(*FILE), FILE, "left_semi").select(*made.columns)
        gone = last.rows.join(same.select(*FILE), FILE, "left_anti").select("domain")
        rules = ignored.exceptAll(last.ignored).unionByName(last.ignored.exceptAll(ignored)).select("domain")
        touched = made.select("domain").unionByName(gone).unionByName(rules).distinct()
        rows = made.unionByName(stay.join(touched, "domain", "left_semi"))
        rest = last.entries.join(touched, "domain", "left_anti")
    entries = ent.apply_ignorelist(ent.merge_entries(rows), ignorelist).withColumn("reversed", reverse_labels(F.col("domain")))
    if rest is not None:
        entries = entries.unionByName(rest)
    return publish(entries, root, built_at=built_at, **gate)
