"""Public suffixes and registrable domains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ancestors, labels, naive_domain, normalize_host

#: Rule tables up to this many rows are broadcast; a public list has some 10,000.
BROADCAST_RULES = 200_000


def registrable_domains(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, public_suffix, registrable_domain, psl_fallback) of each distinct ``host``.

    An exception rule wins (the leftmost; its suffix lacks the rule's first label), else
    the longest suffix that is an exact rule or stands below a wildcard, else the last
    label. The registrable domain has one label more; null for a bare suffix. Without
    any rule the last two labels are guessed, and ``psl_fallback`` says so.
    """
    h = hosts.select("host").filter("host is not null").distinct().withColumn("_h", normalize_host(F.col("host"))).filter("_h is not null")
    some = rules.agg((F.count("*") > 0).alias("_some"))
    c = h.select("host", F.posexplode(ancestors(F.col("_h"))).alias("i", "_c"))
    small = F.broadcast if rules.count() <= BROADCAST_RULES else lambda df: df
    by_rule = small(rules.groupBy("rule").agg(*(F.max(F.col("kind") == k).alias(f"_{k}") for k in ("exact", "wildcard", "exception"))))
    hit = c.join(by_rule, F.col("_c") == F.col("rule"), "left")
    least = hit.groupBy("host").agg(
        F.min(F.when(F.col("_exception"), F.col("i"))).alias("_ex"),
        F.min(F.when(F.col("_exact"), F.col("i"))).alias("_in"),
        # a wildcard's suffix begins one label before its parent
        F.min(F.when(F.col("_wildcard") & (F.col("i") > 0), F.col("i") - 1)).alias("_wild"),
    )
    p = labels(F.col("_h"))
    start = F.coalesce(F.col("_ex") + 1, F.least("_in", "_wild"), F.size(p) - 1)
    out = h.join(least, "host", "left").crossJoin(F.broadcast(some)).withColumn("_p", p).withColumn("_at", start)  # one row
    suffix = F.array_join(F.expr("slice(_p, _at + 1, size(_p))"), ".")
    domain = F.when(F.col("_at") > 0, F.array_join(F.expr("slice(_p, greatest(_at, 1), size(_p))"), "."))
    return out.select(
        "host", F.when(F.col("_some"), suffix).alias("public_suffix"),
        F.when(F.col("_some"), domain).otherwise(naive_domain(F.col("_h"))).alias("registrable_domain"), F.when(~F.col("_some"), True).alias("psl_fallback"),
    )
