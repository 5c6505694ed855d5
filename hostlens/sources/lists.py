"""List registry, list files with their origin, ignorelist, TLDs and suffix rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.punycode import ascii_form
from ..functions.text import ws_strip

SKIPPED_FOLDERS = ("tld", "index")
CURATED = ("curated", "custom")  # file names of curated lists


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(name, file, url, categories) from a JSON array."""
    return spark.read.schema("name string, file string, url string, categories array<string>").json(path, multiLine=True)


def read_list_lines(spark: SparkSession, root: str, *, exclude: list[str] | None = None) -> DataFrame:
    """(source, folder, file, line) of ``root``/<folder>/<file>.

    ``source`` is the file's name. Folders that hold no lists are skipped, and the
    files named in ``exclude`` (path below the root).
    """
    lines = spark.read.text(f"{root.rstrip('/')}/*/*").select(
        F.col("value").alias("line"), F.regexp_extract("_metadata.file_path", "([^/]+)/([^/]+)$", 1).alias("folder"), F.regexp_extract("_metadata.file_path", "([^/]+)/([^/]+)$", 2).alias("source")
    )
    lines = lines.withColumn("file", F.concat_ws("/", "folder", "source"))
    gone = [x.replace("/./", "/").removeprefix("./") for x in exclude or []]
    return lines.filter(~F.col("folder").isin(*SKIPPED_FOLDERS) & (F.col("source") != ".gitignore") & ~F.col("file").isin(*gone) if gone else ~F.col("folder").isin(*SKIPPED_FOLDERS) & (F.col("source") != ".gitignore"))


def curated_files(lines: DataFrame, names: tuple[str, ...] = CURATED) -> DataFrame:
    """(file, categories): the lists, by file name, whose category is their folder's name."""
    found = lines.filter(F.col("source").isin(*names)).select("file", "folder").distinct()
    return found.select("file", F.array("folder").alias("categories"))


def registry_files(registry: DataFrame) -> DataFrame:
    """(source, categories) by file name; what is registered twice has both's categories."""
    named = registry.select(F.regexp_extract("file", "[^/]*$", 0).alias("source"), "categories")
    return named.groupBy("source").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("categories")))).alias("categories"))


def tlds(lines: DataFrame) -> DataFrame:
    """(tld) from ``line``: comments and blanks dropped, lower case."""
    return lines.filter(~F.startswith("line", F.lit("#"))).select(F.lower(ws_strip(F.col("line"))).alias("tld")).filter("tld <> ''").distinct()


def suffix_rules(lines: DataFrame) -> DataFrame:
    """(kind, rule) from ``line``: exact, wildcard (by its parent) or exception, also in ASCII."""
    first = F.lower(F.split(ws_strip(F.col("line")), r"\s+")[0])
    rules = lines.select(first.alias("r")).filter("r <> '' and not startswith(r, '//')")
    kind = F.when(F.startswith("r", F.lit("!")), "exception").when(F.startswith("r", F.lit("*.")), "wildcard").otherwise("exact")
    rules = rules.select(kind.alias("kind"), F.regexp_replace("r", r"^(!|\*\.)", "").alias("rule"))
    return rules.select("kind", F.explode(F.array_compact(F.array("rule", ascii_form("rule")))).alias("rule")).distinct()


def read_ignorelist(spark: SparkSession, path: str) -> DataFrame:
    """(context, host) from {context: [hosts]}; an empty table for a missing file."""
    try:
        text = spark.read.text(path, wholetext=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "context string, host string")
    m = F.from_json("value", "map<string, array<string>>")
    return text.select(F.explode(m).alias("context", "hosts")).select("context", F.explode("hosts").alias("host"))
