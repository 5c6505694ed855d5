"""URL filters: pattern rules behind an index of their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, table

#: Rule lists up to this long are broadcast (some 200 bytes a rule).
BROADCAST_RULES = 100_000

#: Blocked by the method where no host rule fits; "^" stands for a border of a token.
PATTERNS = [
    ("^casino^", "block"), ("^casino-win^", "block"), ("^free-bets^", "block"), ("^cheap-pills^", "block"), ("^spam-farm^", "block"),
    ("^adult-x^", "block"), ("^adult^", "block"), ("^ads-track^", "block"), ("^adserver^", "block"), ("^doubleclick^", "block"), ("^porn^", "block"), ("^viagra^", "block"),
]


def host_rule(host: str, path: str, verdict: str) -> dict:
    """Fits the host and its subdomains where the url's path starts with ``path``.

    Its tokens are those that stand between separators in every url that it fits.
    """
    whole = path if re.search(r"[^A-Za-z0-9]$", path) else re.sub(r"[A-Za-z0-9]+$", "", path)
    tokens = re.findall("[a-z0-9]+", f"{host}/{whole.lower()}")
    return {"rule": f"{host}{path}", "verdict": verdict, "kind": "host", "regex": rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", "tokens": tokens}


def pattern_rule(pattern: str, verdict: str) -> dict:
    """``^`` is a border of a token, ``*`` anything; the rest is literal, in any case. Its
    tokens are those with a border or other separator on both sides, as only these are
    whole in every url. It is matched against the url in lower case."""
    pattern = pattern.lower()
    border = r"(?:(?<![a-z0-9])(?=[a-z0-9])|(?<=[a-z0-9])(?![a-z0-9]))"
    regex = "".join(border if c == "^" else ".*" if c == "*" else re.escape(c) for c in pattern)
    return {"rule": pattern, "verdict": verdict, "kind": "pattern", "regex": regex, "tokens": [t for t in re.findall(r"(?<=[^A-Za-z0-9*])[a-z0-9]+(?=[^A-Za-z0-9*])", pattern)]}


def parse_rules(lines: Iterable[str]) -> list[dict]:
    """Rules of a list: "block host/path", "allow host/path", "block ^pattern" (see
    ``pattern_rule``). Blank lines and those that begin with # are skipped."""
    rules = []
    for line in map(str.strip, lines):
        if line and not line.startswith("#"):
            verdict, _, what = line.partition(" ")
            if verdict not in ("allow", "block") or not what.strip():
                raise ValueError(f"no rule: {line}")
            what = what.strip()
            host, slash, path = what.partition("/")
            rules.append(host_rule(host, slash + path, verdict) if slash and not re.search("[*^]", what) else pattern_rule(what, verdict))
    return rules


def rules_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    if bad := [r["rule"] for r in rules if not r["tokens"]]:
        raise ValueError(f"rules without a literal token: {bad[:3]}")
    rows = [(i, r["rule"], r["verdict"], r["kind"], r["regex"], r["tokens"]) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_id int, rule string, verdict string, kind string, regex string, tokens array<string>")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Null or without "://": both empty."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def filter_urls(urls: DataFrame, rules: list[dict], *, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` (all rows and columns) with ``host``, ``path``, ``rule``, ``verdict``.

    Of the host rules that fit, the longest wins (of equals the first by code point)
    and is named in ``rule``. Else a pattern rule decides, block before allow, else
    ``default``. Host rules compare paths as they are spelt, patterns in lower case. A
    null url has an empty host and path. Columns of ``urls`` with the names of new ones
    are replaced; all others stay, whatever their names.

    Each distinct url is split into tokens (in lower case); a token fetches the rules whose
    rarest token (by urls that have it) it is; only those run their regular expression.
    """
    spark = urls.sparkSession
    base = urls.select(F.struct(*(f"`{c}`" for c in urls.columns)).alias("_row"), F.coalesce(F.col(url_col), F.lit("")).alias("_u"))
    host, path = host_and_path(F.col("_u"))
    distinct = base.select("_u").distinct().withColumn("host", host).withColumn("path", path)
    tokens = distinct.withColumn("_t", F.explode(F.array_distinct(F.split(F.lower(F.concat("host", "path")), "[^a-z0-9]+"))))
    small = F.broadcast if len(rules) <= BROADCAST_RULES else lambda df: df

    table_ = rules_table(spark, rules)
    listed = table_.select("rule_id", F.explode("tokens").alias("_t"))
    seen = tokens.join(small(listed.select("_t").distinct()), "_t").groupBy("_t").agg(F.count("*").alias("_n"))
    rarest = Window.partitionBy("rule_id").orderBy(F.coalesce("_n", F.lit(0)), "_t")
    index = listed.join(seen, "_t", "left").withColumn("_k", F.row_number().over(rarest)).filter("_k = 1").select("rule_id", "_t").join(table_.drop("tokens"), "rule_id")

    length, hosts = F.length("rule"), F.col("kind") == "host"
    said = F.when(hosts, F.concat("host", "path")).otherwise(F.lower(F.concat("host", "path")))
    hits = tokens.join(small(index), "_t").filter(F.rlike(said, F.col("regex")))
    best = hits.groupBy("_u").agg(
        F.min(F.when(hosts, F.struct((-length).alias("n"), F.col("rule").alias("rule"), F.col("verdict").alias("verdict")))).alias("_host"),
        F.max(F.when(~hosts, F.col("verdict"))).alias("_pattern"),
    )
    # apart, so that the join on a hot url can be split; it grows with the urls and is not broadcast
    best = materialize(best, "url-verdicts").hint("merge")
    verdict = F.coalesce(F.col("_host.verdict"), F.col("_pattern"), F.lit(default))
    new = F.struct(host.alias("host"), path.alias("path"), F.col("_host.rule").alias("rule"), verdict.alias("verdict"))
    out = base.join(best, "_u", "left").select("_row", new.alias("_new"))
    stay = [F.col(f"_row.`{c}`").alias(c) for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    return out.select(*stay, "_new.*")  # in two steps: names may clash


#: The rules that op7 is asked to apply.
HOST_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [host_rule(*r) for r in HOST_RULES] + [pattern_rule(*r) for r in PATTERNS]
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")
