"""Reverse-DNS names as they were known at the time of an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ip import ip_digits, reverse_name
from ..functions.text import short_hostnames, ws_strip

#: How long an observation holds, and how many clients a bounded memory keeps.
TTL_SECONDS, MAX_CLIENTS = 900, 20_000
#: What may be used again; a transient failure never hides an older answer.
REUSABLE = ("ok", "nxdomain", "bad_client_address")
FIELDS = ("client_hosts", "client_hosts_short", "ptr", "ptr_status")


def no_hosts() -> Column:
    return F.array().cast("array<string>")


def is_address(client: Column) -> Column:
    """What a reverse name can be made of: an address without white space or zone."""
    return F.coalesce(ip_digits(client).isNotNull() & (client == ws_strip(client)) & ~F.contains(client, F.lit("%")), F.lit(False))


def folded(hosts: Column) -> Column:
    """Names in lower case without dots at their ends, each once: resolvers return one name
    in several cases, and a machine must not count as two."""
    names = F.transform(hosts, lambda h: F.lower(F.regexp_replace(h, r"\.+$", "")))
    return F.coalesce(F.array_distinct(F.filter(names, lambda h: h != "")), no_hosts())


def usable(observations: DataFrame) -> DataFrame:
    """(client, observed_at, hosts, status): what may be used again, with folded names.
    Observations of what is no address say nothing new."""
    ok = F.col("status").isin(*REUSABLE[:2]) & is_address(F.col("client"))
    return observations.filter(ok).select("client", "observed_at", folded(F.col("hosts")).alias("hosts"), "status")


def _named(events: DataFrame, columns: list[str], hosts: Column, status: Column, asked: Column | None = None) -> DataFrame:
    """``columns`` of events with ``FIELDS``; the name asked for is the address's alone."""
    found = [hosts, short_hostnames(hosts), reverse_name("client") if asked is None else asked, status]
    return events.select(*(f"`{c}`" for c in columns), *(x.alias(n) for x, n in zip(found, FIELDS, strict=True)))


def unaddressed(events: DataFrame) -> DataFrame:
    """Events that nothing can be asked for: without a client ``skipped``, with one that is
    no address ``bad_client_address``."""
    own = [c for c in events.columns if c not in FIELDS]
    none = events.filter("client is null or client = ''").select(*(f"`{c}`" for c in own))
    bad = events.filter("client <> ''").filter(~is_address(F.col("client")))
    return without_ptr(none).unionByName(_named(bad, own, no_hosts(), F.lit(REUSABLE[2]), F.lit("")))


def with_ptr(events: DataFrame, observations: DataFrame, *, ttl: int = TTL_SECONDS) -> DataFrame:
    """Adds ``client_hosts``, ``client_hosts_short``, ``ptr``, ``ptr_status``.

    ``events`` has ``client`` and ``ts``; ``observations`` client, observed_at, hosts and
    status, raw as a resolver gives them. The latest usable observation holds from its
    time until ``ttl`` seconds later, that moment not included; else ``not_observed``.
    Without a client ``skipped``, and what is no address is ``bad_client_address``. ``ptr``
    is the name that is asked for, whatever came of it ('' for a bad address).

    Of observations of one client at one time the greatest (status, hosts) counts.

    Clients behind one address are hot, so rows are cut into slices of ``ttl`` seconds
    and each observation goes to its own and the next slice; a window holds one client's
    slice. Events go through it with all their columns, and are shuffled once.
    """
    own = [c for c in events.columns if c not in FIELDS]
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    span = ttl * 1_000_000
    o = usable(observations).select("client", at("observed_at").alias("_t"), F.struct(F.col("observed_at").alias("at"), "status", "hosts").alias("_o"))
    o = o.withColumn("_s", F.explode(F.array(F.expr(f"_t div {span}"), F.expr(f"_t div {span} + 1"))))
    e = events.filter(is_address(F.col("client"))).select("client", at("ts").alias("_t"), F.struct(*(f"`{c}`" for c in own)).alias("_e")).withColumn("_s", F.expr(f"_t div {span}"))
    rows = o.select("client", "_s", "_t", F.lit(0).alias("_kind"), "_o", F.lit(None).cast(e.schema["_e"].dataType).alias("_e"))
    rows = rows.unionByName(e.withColumn("_kind", F.lit(1)).withColumn("_o", F.lit(None).cast(o.schema["_o"].dataType)))
    w = Window.partitionBy("client", "_s").orderBy("_t", "_kind", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = rows.withColumn("_last", F.last("_o", ignorenulls=True).over(w)).filter("_kind = 1")
    last = last.select("_e.*", F.when(F.col("_t") < at("_last.at") + span, F.col("_last")).alias("_last"))
    known = _named(last, own, F.coalesce("_last.hosts", no_hosts()), F.coalesce("_last.status", F.lit("not_observed")))
    return known.unionByName(unaddressed(events))


def without_ptr(events: DataFrame) -> DataFrame:
    """The same fields when names aren't looked up."""
    return events.withColumns({"client_hosts": no_hosts(), "client_hosts_short": no_hosts(), "ptr": F.lit(None).cast("string"), "ptr_status": F.lit("skipped")})


def latest(observations: DataFrame) -> DataFrame:
    """One row a client: the last usable observation, and the name that it was asked for."""
    top = usable(observations).groupBy("client").agg(F.max(F.struct("observed_at", "status", "hosts")).alias("_o"))
    return top.select("client", "_o.observed_at", "_o.hosts", reverse_name("client").alias("ptr"), "_o.status")


def bounded(observations: DataFrame, *, most: int = MAX_CLIENTS) -> DataFrame:
    """The ``most`` clients that were refreshed last; reading refreshes nothing."""
    return latest(observations).orderBy(F.desc("observed_at"), "client").limit(most)
