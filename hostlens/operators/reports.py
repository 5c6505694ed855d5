"""Questions that the documents' fields are shaped for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ip import has_sinkhole
from ..functions.text import naive_domain

FACETS = ("purpose", "service", "risk")


def top_domains(events: DataFrame, *, k: int = 20, guessed: bool | None = None) -> DataFrame:
    """By events, then name; ``guessed`` keeps only domains that were (not) guessed."""
    e = events.filter("registrable_domain is not null")
    if guessed is not None:
        e = e.filter(F.coalesce("psl_fallback", F.lit(False)) == guessed)
    g = e.groupBy("registrable_domain").agg(F.count("*").alias("events"), F.countDistinct("client").alias("clients"))
    return g.orderBy(F.desc("events"), "registrable_domain").limit(k)


#: Base-2 logarithm of a sketch's size: a standard error of 1.04 / sqrt(2 ** 12) = 1.6 %.
SKETCH_BITS = 12


def daily_clients(events: DataFrame, *, time: str = "ts") -> DataFrame:
    """(day, registrable_domain, client, events) of the events of a day: the exact base of
    its index, from which counts over any days can be made."""
    e = events.filter("registrable_domain is not null").withColumn("day", F.to_date(F.col(time)))
    return e.groupBy("day", "registrable_domain", "client").agg(F.count("*").alias("events"))


def daily_domains(clients: DataFrame) -> DataFrame:
    """(day, registrable_domain, events, clients, sketch) from ``daily_clients``: some
    kilobytes a domain and day that can be united, however many clients there are."""
    return clients.groupBy("day", "registrable_domain").agg(
        F.sum("events").alias("events"), F.count("client").alias("clients"), F.hll_sketch_agg("client", F.lit(SKETCH_BITS)).alias("sketch")
    )


def distinct_clients(clients: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """(registrable_domain, events, clients) over the days from ``first`` to ``last``, exactly.
    A client of several days counts once; only its domain's distinct clients are shuffled."""
    each = _days(clients, first, last).groupBy("registrable_domain", "client").agg(F.sum("events").alias("events"))
    return each.groupBy("registrable_domain").agg(F.sum("events").alias("events"), F.count("client").alias("clients"))


def sketched_clients(daily: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """The same from ``daily_domains``; ``clients`` is an estimate."""
    return _days(daily, first, last).groupBy("registrable_domain").agg(F.sum("events").alias("events"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("clients"))


def _days(rows: DataFrame, first: str | None, last: str | None) -> DataFrame:
    for day, ok in ((first, F.col("day") >= F.lit(first).cast("date")), (last, F.col("day") <= F.lit(last).cast("date"))):
        rows = rows.filter(ok) if day else rows
    return rows


def _share(events: DataFrame, labels: Column, names: list[str]) -> DataFrame:
    """Events that carry a label, each once for it, and their share of all events."""
    total = events.agg(F.count("*").alias("_all"))
    hit = events.select(F.explode(F.array_distinct(labels)).alias("_l")).select(*(["_l.*"] if len(names) > 1 else [F.col("_l").alias(names[0])]))
    g = hit.groupBy(*names).agg(F.count("*").alias("events"))
    return g.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("events") / F.col("_all"), 6)).drop("_all")  # one row


def category_share(events: DataFrame) -> DataFrame:
    """(category, events, share); an event counts once for each of its categories."""
    return _share(events, F.col("contexts"), ["category"])


def _paths() -> Column:
    """(facet, path) structs of an event."""
    none = F.array().cast("array<string>")

    def of(facet: str) -> Column:
        return F.transform(F.coalesce(facet, none), lambda p: F.struct(F.lit(facet).alias("facet"), p.alias("path")))

    return F.concat(*map(of, FACETS))


def facet_share(events: DataFrame) -> DataFrame:
    """(facet, path, events, share)"""
    return _share(events, _paths(), ["facet", "path"])


def branch_rollup(events: DataFrame, facet: str) -> DataFrame:
    """(branch, path, events): distinct events by path, by branch and in all."""
    e = events.select("event_id", F.explode(facet).alias("path")).withColumn("branch", F.substring_index("path", ".", 1))
    return e.rollup("branch", "path").agg(F.countDistinct("event_id").alias("events"))


def histogram(events: DataFrame, *, width: str = "1 hour", time: str = "ts") -> DataFrame:
    w = events.withColumn("_ts", F.col(time).cast("timestamp")).groupBy(F.window("_ts", width).alias("_w")).agg(F.count("*").alias("events"))
    return w.select(F.col("_w.start").alias("start"), "events")


def client_identity_table(browser: DataFrame, dns: DataFrame, *, within_seconds: int = 3600, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(event_id, client, client_user, by, candidates) of DNS events' likely users.

    By address: the browser event nearest in time (of equals the least user and hostname)
    within ``within_seconds`` that had the client's address; ``candidates`` counts the
    identities that had it within that time. Short names are not unique, so matches by
    name, for the other events, say how many identities share it.

    No event meets all others of its address. Time is cut into slices of that length. In
    a slice each identity is summed up as the at most two spans in which it counts, and
    one pass in the order of time carries their number, and the nearest before and after.
    """
    span = within_seconds
    sec = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    who = F.struct("client_user", "client_hostname")
    seen = browser.select(F.explode(F.array_distinct("client_ips")).alias("client"), who.alias("_who"), sec("ts").alias("_t"))
    seen = seen.withColumn("_from", F.expr(f"_t div {span}")).withColumn("_s", F.explode(F.array(*(F.col("_from") + k for k in (-1, 0, 1)))))
    begin, end = F.col("_s") * span, (F.col("_s") + 1) * span - 1
    one = seen.groupBy("client", "_s", "_who").agg(
        F.max(F.col("_from") == F.col("_s")).alias("_in"), F.max(F.when(F.col("_from") < F.col("_s"), F.col("_t"))).alias("_left"), F.min(F.when(F.col("_from") > F.col("_s"), F.col("_t"))).alias("_right")
    )
    left, right = F.col("_left") + span, F.col("_right") - span
    whole = F.col("_in") | F.coalesce(left >= right - 1, F.lit(False))
    part = lambda x, y: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    spans = F.when(whole, F.array(part(begin, end))).otherwise(F.array_compact(F.array(F.when(left.isNotNull(), part(begin, left)), F.when(right.isNotNull(), part(right, end)))))
    spans = one.select("client", "_s", F.explode(spans).alias("_p"))
    edges = spans.select("client", "_s", F.inline(F.array(F.struct(F.col("_p.x").alias("_t"), F.lit(0).alias("_kind"), F.lit(1).alias("_n")), F.struct(F.col("_p.y").alias("_t"), F.lit(2).alias("_kind"), F.lit(-1).alias("_n")))))
    edges = edges.groupBy("client", "_s", "_t", "_kind").agg(F.sum("_n").alias("_n"))
    near = seen.groupBy("client", "_s", "_t").agg(F.min("_who").alias("_who")).withColumn("_kind", F.lit(0))
    d = dns.select("event_id", "client", sec("ts").alias("_t"), "client_hosts_short").withColumn("_s", F.expr(f"_t div {span}")).withColumn("_kind", F.lit(1))
    rows = edges.unionByName(near, allowMissingColumns=True).unionByName(d, allowMissingColumns=True).withColumn("_at", F.when(F.col("_who").isNotNull(), F.struct("_t", "_who")))
    w = Window.partitionBy("client", "_s").orderBy("_t", "_kind")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("candidates", F.sum("_n").over(back)).withColumn("_b", F.last("_at", ignorenulls=True).over(back)).withColumn("_a", F.first("_at", ignorenulls=True).over(ahead)).filter("_kind = 1")
    gap = lambda c: F.when(F.abs(F.col("_t") - F.col(f"{c}._t")) <= span, F.struct(F.abs(F.col("_t") - F.col(f"{c}._t")).alias("gap"), F.col(f"{c}._who").alias("who")))
    rows = cut(rows.select("event_id", "client", "client_hosts_short", "candidates", F.least(gap("_b"), gap("_a")).alias("_p")))
    by_ip = rows.filter("_p is not null").select("event_id", "client", F.col("_p.who.client_user").alias("client_user"), F.lit("address").alias("by"), F.col("candidates").cast("long").alias("candidates"))
    names = browser.filter("client_hostname_short is not null").groupBy(F.col("client_hostname_short").alias("_n")).agg(F.min("client_user").alias("client_user"), F.countDistinct(who).alias("candidates"))
    rest = rows.filter("_p is null").select("event_id", "client", F.explode("client_hosts_short").alias("_n")).join(cut(names), "_n")
    by_name = rest.groupBy("event_id", "client").agg(F.min("client_user").alias("client_user"), F.sum("candidates").alias("candidates")).select("event_id", "client", "client_user", F.lit("name").alias("by"), "candidates")
    return by_ip.unionByName(by_name)


def ptr_health(events: DataFrame, *, width: str = "1 hour") -> DataFrame:
    w = events.withColumn("_ts", F.col("ts").cast("timestamp")).groupBy(F.window("_ts", width).alias("_w"), "ptr_status").agg(F.count("*").alias("events"))
    return w.select(F.col("_w.start").alias("start"), "ptr_status", "events")


def findings(events: DataFrame, severities: DataFrame, *, least: str = "medium", editorial: bool = False) -> DataFrame:
    """(event_id, path, severity): risk paths at or above a severity; the editorial
    branch, which has none, only when asked for."""
    ranks = {"low": 1, "medium": 2, "high": 3}
    e = events.select("event_id", F.explode("risk").alias("path")).join(F.broadcast(severities), "path", "left")  # some rows
    keep = F.coalesce(F.col("rank") >= ranks[least], F.lit(False))
    if editorial:
        keep = keep | F.startswith("path", F.lit("editorial."))
    return e.filter(keep).select("event_id", "path", "severity")


def sinkholed(events: DataFrame) -> DataFrame:
    return events.filter(has_sinkhole(F.col("resolved_ips")))


def cloaked(events: DataFrame) -> DataFrame:
    """(target, events, hosts): questions without categories whose chain has some."""
    e = events.filter((F.size("match_source") == 1) & (F.get("match_source", F.lit(0)) == "cname"))
    g = e.select("event_id", "host", F.explode("chain").alias("target")).groupBy("target")
    return g.agg(F.countDistinct("event_id").alias("events"), F.countDistinct("host").alias("hosts"))


def unmapped(events: DataFrame) -> DataFrame:
    return events.select(F.explode("unmapped_contexts").alias("category")).groupBy("category").agg(F.count("*").alias("events"))


def agreement(events: DataFrame) -> DataFrame:
    """One row of compare-mode events: how often both agree, and what chains would add."""
    added = F.size(F.array_except(F.coalesce("cname_contexts", F.array().cast("array<string>")), "contexts"))
    return events.agg(F.count("*").alias("events"), F.round(F.avg(F.col("context_match").cast("int")), 6).alias("agreement"), F.count_if(added > 0).alias("chain_adds"))


def domain_changes(domains: DataFrame) -> DataFrame:
    """(kind, hosts): where the rule's domain is not the last two labels."""
    n, r = naive_domain(F.col("host")), F.col("registrable_domain")
    kind = F.when(n.eqNullSafe(r), "same").when(r.isNull(), "bare suffix").when(n.isNull(), "single label").otherwise("changed")
    return domains.groupBy(kind.alias("kind")).agg(F.count("*").alias("hosts"))


def first_by(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key (ordered dedupe across rows)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return events.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
