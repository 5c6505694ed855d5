"""Domain lists: cleaned lines, merged entries, corrections and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import reverse_labels, tld, valid_host, ws_strip


def cleaned_host(line: Column) -> Column:
    """The host of a list line in any of the known formats; null where there is none.

    Hosts files, block rules with bars and caret, plain and wildcard hosts. The order
    of the steps is part of their meaning.
    """
    x = F.lower(ws_strip(line))
    is_rule = (x != "") & ~x.rlike(r"^[#!\[]") & ~F.startswith(x, F.lit("@@"))
    y = F.split(x, r"\s+[#!]", 2)[0]
    y = F.regexp_replace(y, r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}\s+", "")
    y = F.regexp_replace(y, r"^[0-9a-f]*:[0-9a-f:.]*(?:%\w+)?\s+", "")
    y = F.substring_index(F.regexp_replace(y, r"^\|\|?", ""), "^", 1)
    y = F.trim(F.split(ws_strip(y), r"\s+")[0], F.lit("."))
    return F.when(is_rule & valid_host(y), y)


def list_key(df: DataFrame) -> list[str]:
    """The columns that name a list file. ``source`` is its name; folders share names."""
    return [c for c in ("folder", "source") if c in df.columns]


def clean_lines(lines: DataFrame, tlds: DataFrame | None = None) -> DataFrame:
    """(folder, source, host) once each from (folder, source, line); with ``tlds``, only
    known ones. Lines without a folder are told apart by ``source`` alone."""
    out = lines.select(*list_key(lines), cleaned_host(F.col("line")).alias("host")).filter("host is not null")
    if tlds is not None:
        out = out.join(F.broadcast(tlds.select("tld").distinct()), tld(F.col("host")) == F.col("tld"), "left_semi")  # a few thousand rows
    return out.dropDuplicates([*list_key(lines), "host"])


def curated_lines(lines: DataFrame) -> DataFrame:
    """(source, folder, line, host): host null for rejects; blank lines are none."""
    x = F.lower(ws_strip(F.col("line")))
    return lines.filter(x != "").withColumn("host", F.when(F.contains(x, F.lit(".")) & valid_host(x), x))


def keep_previous(new: DataFrame, previous: DataFrame) -> DataFrame:
    """Rows by list file; one without new rows keeps its old ones."""
    key = list_key(new)
    return new.unionByName(previous.join(new.select(*key).distinct(), key, "left_anti").select(*new.columns))


def with_categories(hosts: DataFrame, configured: DataFrame) -> DataFrame:
    """(domain, category, source, folder) from (source, folder, host) and (source, categories).

    Configured categories go by the file's name, whatever its folder. A file that isn't
    configured, or has no categories, has the name of its own folder.
    """
    c = configured.select("source", F.col("categories").alias("_c"))
    joined = hosts.filter("host is not null").join(F.broadcast(c), "source", "left")  # one row a list file
    cats = F.when(F.size("_c") > 0, F.col("_c")).otherwise(F.array("folder"))
    return joined.select(F.col("host").alias("domain"), F.explode(cats).alias("category"), "source", "folder")


def merge_entries(rows: DataFrame) -> DataFrame:
    """One row a domain: sorted sets of categories and sources."""
    return rows.groupBy("domain").agg(F.array_sort(F.collect_set("category")).alias("categories"), F.array_sort(F.collect_set("source")).alias("sources"))


def _ignored(ignorelist: DataFrame, host: Column) -> DataFrame:
    return ignorelist.select(host.alias("domain"), "context").groupBy("domain").agg(F.collect_set("context").alias("_ignored"))


def apply_ignorelist(entries: DataFrame, ignorelist: DataFrame) -> DataFrame:
    """Removes contexts from entries; one without contexts goes. Sources stay as they are."""
    return corrected(entries, ignorelist).filter(F.size("categories") > 0).drop("removed")


def corrected(entries: DataFrame, ignorelist: DataFrame, *, exact: bool = False) -> DataFrame:
    """All entries with their contexts removed, and how many (``removed``).

    ``exact`` takes the ignorelist's hosts as they are spelt.
    """
    host = F.col("host") if exact else F.lower(ws_strip(F.col("host")))
    j = entries.join(_ignored(ignorelist, host), "domain", "left")
    hit = F.coalesce(F.size(F.array_intersect("categories", "_ignored")), F.lit(0))
    left = F.when(F.col("_ignored").isNull(), F.col("categories")).otherwise(F.array_except("categories", "_ignored"))
    return j.withColumn("removed", hit).withColumn("categories", left).drop("_ignored")


def ignorelist_counts(entries: DataFrame, ignorelist: DataFrame) -> DataFrame:
    c = corrected(entries, ignorelist)
    return c.agg(F.coalesce(F.sum("removed"), F.lit(0)).cast("long").alias("removed"), F.count_if(F.size("categories") == 0).alias("dropped"))


def combinations(entries: DataFrame) -> DataFrame:
    """The dictionary of (categories, sources): ``attr_id`` from 0 by frequency, ``domains``.

    A few thousand rows, so one window over them all is small.
    """
    from pyspark.sql import Window

    g = entries.groupBy("categories", "sources").agg(F.count("*").alias("domains"))
    order = Window.orderBy(F.desc("domains"), F.array_join("categories", "|"), F.array_join("sources", "|"))
    return g.withColumn("attr_id", F.row_number().over(order) - 1)


def encoded(entries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(domain, attr_id)"""
    return entries.join(dictionary.select("categories", "sources", "attr_id"), ["categories", "sources"]).select("domain", "attr_id")


def build_statistics(rows: DataFrame, rejects: DataFrame) -> DataFrame:
    """One row from (domain, category, source, folder) and lines with a null host."""
    a = rows.agg(F.countDistinct("domain").alias("domains"), F.countDistinct(*list_key(rows)).alias("files"), F.countDistinct("category").alias("categories"))
    return a.crossJoin(rejects.agg(F.count_if(F.col("host").isNull()).alias("skipped")))  # one row by one row


def sorted_entries(entries: DataFrame) -> DataFrame:
    """By the bytes of the reversed labels, so that a domain follows its parents; range
    partitions, each sorted."""
    e = entries.withColumn("reversed", reverse_labels(F.col("domain")))
    return e.repartitionByRange("reversed").sortWithinPartitions("reversed")


def below(entries: DataFrame, domain: str) -> DataFrame:
    """The entries for a domain and all below it, wildcards too, from rows with ``reversed``.

    They stand together in the order of the reversed labels: a range, which Parquet's
    statistics narrow down to the row groups that hold it.
    """
    r = ".".join(reversed(domain.strip(".").lower().split(".")))
    # "/" follows "." and a hyphen is before it, so the range's few others go by the second test
    return entries.filter((F.col("reversed") >= r) & (F.col("reversed") < f"{r}/")).filter((F.col("reversed") == r) | F.startswith("reversed", F.lit(f"{r}.")))


def exact_population(lines: DataFrame) -> DataFrame:
    """(domain, categories) of (line, categories) for look-up by exact key: no grammar."""
    g = lines.select(ws_strip(F.col("line")).alias("domain"), F.explode("categories").alias("category")).filter("domain <> ''")
    return g.groupBy("domain").agg(F.array_sort(F.collect_set("category")).alias("categories"))


def exact_ignorelist(population: DataFrame, ignorelist: DataFrame) -> DataFrame:
    """Contexts go, entries stay even when empty; hosts are compared as spelt."""
    return corrected(population, ignorelist, exact=True).drop("removed")


def usable(table: DataFrame, column: str, needed: list[str], least: int) -> DataFrame:
    """One row: ``rows`` and ``usable`` (over ``least`` rows and all the needed values)."""
    have = [F.coalesce(F.max((F.col(column) == x).cast("int")), F.lit(0)) == 1 for x in needed]
    ok = F.count("*") > least
    for h in have:
        ok = ok & h
    return table.agg(F.count("*").alias("rows"), ok.alias("usable"))
