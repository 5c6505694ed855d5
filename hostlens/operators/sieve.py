"""The sieve: which events are worth a look, and the first reason against the others.

Ignore rules are a table (scope, kind, value): scope dns or browser; kind domain, host,
client or user. Rule tables are a person's configuration; see ``Rules``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ancestors, normalize_host, strip_port

EARLIEST_YEAR = 1990
#: Rule tables up to this many rows are held as literals; longer ones are joined.
LITERAL_RULES = 1000


class Rules:
    """Rules of one scope; domains and hosts are normalised once."""

    def __init__(self, rules: DataFrame, scope: str) -> None:
        own = rules.filter(F.col("scope") == scope)
        value = F.when(F.col("kind").isin("domain", "host"), normalize_host(F.col("value"))).otherwise(F.col("value"))
        self.table = own.select("kind", value.alias("value")).filter("value is not null").distinct()
        rows = self.table.limit(LITERAL_RULES + 1).collect()
        self.literal = len(rows) <= LITERAL_RULES
        self.values = {k: [r["value"] for r in rows if r["kind"] == k] for k in ("domain", "host", "client", "user")}

    def mark(self, events: DataFrame, keys: Column, kind: str, name: str) -> DataFrame:
        """Adds the boolean ``name``: some of the array ``keys`` is a rule of ``kind``."""
        if self.literal:
            given = F.array(*map(F.lit, self.values[kind])).cast("array<string>")
            return events.withColumn(name, F.coalesce(F.arrays_overlap(F.array_compact(keys), given), F.lit(False)))
        ks = events.select(keys.alias("_keys")).distinct().withColumn("_k", F.explode("_keys"))
        hit = ks.join(self.table.filter(F.col("kind") == kind), F.col("_k") == F.col("value"), "left_semi").select("_keys").distinct()
        marked = events.withColumn("_keys", keys).join(hit.withColumn(name, F.lit(True)), "_keys", "left")
        return marked.withColumn(name, F.coalesce(name, F.lit(False))).drop("_keys")


def first_reason(reasons: list[tuple[str, Column]]) -> Column:
    out = F.lit(None).cast("string")
    for name, when in reversed(reasons):
        out = F.when(F.coalesce(when, F.lit(False)), name).otherwise(out)
    return out


def sieve_dns(events: DataFrame, rules: DataFrame, *, drop_errors: bool = True, drop_replies: bool = True) -> DataFrame:
    """Adds ``drop_reason``: null for events that stay.

    A missing status counts as bad. Domains match at label borders, for the registered
    domains, the resource and the question's name.
    """
    r = Rules(rules, "dns")
    e = events.withColumn("_rd", normalize_host(F.col("registered_domain"))).withColumn("_e1", normalize_host(F.col("etld_plus_one")))
    e = e.withColumn("_r", normalize_host(F.col("resource"))).withColumn("_q", normalize_host(F.col("question")))
    none = F.array().cast("array<string>")
    up = lambda h: F.coalesce(ancestors(F.col(h)), none)
    e = r.mark(e, F.array("client_ip", "destination_ip"), "client", "_client")
    e = r.mark(e, F.array("_rd", "_e1"), "domain", "_domain")
    e = r.mark(e, F.array("_r"), "host", "_rh")
    e = r.mark(e, up("_r"), "domain", "_rdom")
    e = r.mark(e, F.array("_q"), "host", "_qh")
    e = r.mark(e, up("_q"), "domain", "_qdom")
    reasons = [
        ("type", ~F.col("type").isin("dns")),
        ("type", F.col("type").isNull()),
        ("status", F.coalesce(F.col("status") != "OK", F.lit(True)) & F.lit(drop_errors)),
        ("client", F.col("_client")),
        ("reply", F.col("direction").isin("outbound", "egress") & F.lit(drop_replies)),
        ("domain", F.col("_domain")),
        ("host", F.col("_rh")),
        ("domain", F.col("_rdom")),
        ("host", F.col("_qh")),
        ("domain", F.col("_qdom")),
    ]
    return e.withColumn("drop_reason", first_reason(reasons)).drop("_rd", "_e1", "_r", "_q", "_client", "_domain", "_rh", "_rdom", "_qh", "_qdom")


def browser_host(host: Column) -> Column:
    return normalize_host(strip_port(normalize_host(host)))


def sieve_browser(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``drop_reason``. A time that can't be judged passes; users are compared as spelt."""
    r = Rules(rules, "browser")
    e = events.withColumn("_h", browser_host(F.col("host")))
    e = r.mark(e, F.concat(F.array("hostname", "hostname_short"), F.coalesce("ip_addresses", F.array().cast("array<string>"))), "client", "_client")
    e = r.mark(e, F.array("user"), "user", "_user")
    e = r.mark(e, F.array("_h"), "host", "_host")
    e = r.mark(e, F.coalesce(ancestors(F.col("_h")), F.array().cast("array<string>")), "domain", "_domain")
    year = F.substring("timestamp", 1, 4).try_cast("int")
    low = lambda c: F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    reasons = [
        ("type", F.coalesce(F.col("type") != "browser.history", F.lit(True))),
        ("time", year < EARLIEST_YEAR),
        ("data", ~F.col("has_data")),
        ("client", F.col("_client")),
        ("user", F.col("_user")),
        ("entry", ~F.col("has_entry")),
        ("file", (low("scheme") == "file") | F.startswith(low("url"), F.lit("file://"))),
        ("no_host", F.col("_h").isNull()),
        ("host", F.col("_host")),
        ("domain", F.col("_domain")),
    ]
    return e.withColumn("drop_reason", first_reason(reasons)).drop("_h", "_client", "_user", "_host", "_domain")


def with_verdict(events: DataFrame, readable: Column) -> DataFrame:
    """``verdict``: unreadable, dropped, or kept."""
    v = F.when(~F.coalesce(readable, F.lit(False)), "unreadable").when(F.col("drop_reason").isNotNull(), "dropped").otherwise("kept")
    return events.withColumn("verdict", v)


def verdict_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("verdict").agg(F.count("*").alias("events"))


def dns_audit(verdict: Column, tag: str = "[DNS]") -> Column:
    """A line for the log, under the feed's tag; null where the resource is no string."""
    return F.when(F.col("resource").isNotNull(), F.concat(F.lit(f"{tag} "), verdict, F.lit(": "), "resource", F.coalesce(F.concat(F.lit(" - "), "direction"), F.lit(""))))


def browser_audit(verdict: Column, tag: str = "[History]") -> Column:
    said = [F.coalesce(F.concat(F.lit(sep), c), F.lit("")) for sep, c in ((" : ", "url"), (" - ", "user"), (" - ", "hostname_short"))]
    return F.concat(F.lit(f"{tag} "), verdict, *said)
