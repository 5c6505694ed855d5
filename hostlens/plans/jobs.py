"""The jobs: building the entries, and enriching both feeds."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import entries as ent
from ..operators import enrich, lookup, ptr, sieve
from ..operators.suffix import registrable_domains
from ..operators.taxonomy import severities, taxonomy, with_facets


@dataclass
class Reference:
    """What events are judged against. All are DataFrames; optional ones may be missing."""

    entries: DataFrame | None
    rules: DataFrame
    ignore: DataFrame
    taxonomy: DataFrame | None = None
    severities: DataFrame | None = None
    observations: DataFrame | None = None
    exact_entries: DataFrame | None = None
    built_at: int | None = None


def build_entries(lines: DataFrame, configured: DataFrame, ignorelist: DataFrame, tlds: DataFrame | None = None) -> DataFrame:
    """(domain, categories, sources) from (source, folder, line), in the order of their bytes."""
    rows = ent.with_categories(ent.clean_lines(lines, tlds), configured)
    return ent.sorted_entries(ent.apply_ignorelist(ent.merge_entries(rows), ignorelist))


def lazily(df: DataFrame) -> DataFrame:
    return df


def host_facts(events: DataFrame, ref: Reference, mode: str) -> tuple[DataFrame, DataFrame | None]:
    """All that is known of each host of the events, one row a host: the domain fields and
    (``_found``) what the entries say; and the latter alone, for the chains."""
    hosts = lookup.hosts_of(events)
    domains = registrable_domains(hosts, ref.rules)
    if ref.entries is None or mode == "exact":
        return domains, None
    found = lookup.ancestor_lookup(hosts, ref.entries)
    packed = found.select("host", F.struct("contexts", "sources", "matched_on").alias("_found"))
    return domains.join(packed, "host", "left"), found


def _judged(events: DataFrame, ref: Reference, mode: str, found: DataFrame | None, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    spark = events.sparkSession
    looked = lookup.resolve(events, ref.entries, mode=mode, exact_entries=ref.exact_entries, built_at=ref.built_at, found=found, cut=cut)
    return with_facets(looked, ref.taxonomy or taxonomy(spark), ref.severities or severities(spark))


def enrich_dns(
    events: DataFrame, ref: Reference, *, mode: str = "ancestor", drop_errors: bool = True, drop_replies: bool = True, cut: Callable[[DataFrame], DataFrame] = lazily,
    sieved: bool = False, wanted: Sequence[str] | None = None,
) -> DataFrame:
    """Typed DNS events (with ``event_id`` and ``ts``) to enriched ones; dropped events go.

    What the sieve keeps is read several times (hosts, chains, the events themselves), and
    hot hosts meet the facts of their host in one join; ``cut`` may write both sides once
    (``session.written``), so that Spark can split such a key. Events that are ``sieved``
    are stored already and are not written again. Of the events' own columns only those
    ``wanted`` (null: all) and what the look-ups need are carried; addresses and codes of
    the answers are made last, where they are wanted.
    """
    e = events if sieved else sieve.sieve_dns(events, ref.ignore, drop_errors=drop_errors, drop_replies=drop_replies).filter("drop_reason is null")
    e = enrich.cname_chain(enrich.dns_request(enrich.dns_searches(e))).filter(F.size("searches") > 0)
    if wanted is not None:
        needed = {"host", "searches", "chain", *wanted, *(["client", "ts"] if ref.observations is not None else []), *(["resolved_ip"] if "resolved_ips" in wanted else [])}
        e = e.select(*(f"`{c}`" for c in e.columns if c in needed))
    e = e if sieved else cut(e)
    facts, found = host_facts(e, ref, mode)
    found = found if found is None else cut(found)
    e = lookup.with_chains(e, found, cut).join(cut(facts.drop("public_suffix")), "host", "left")
    e = enrich.dns_answers(_judged(e, ref, mode, found, cut))
    return ptr.without_ptr(e) if ref.observations is None else ptr.with_ptr(e, ref.observations)


def enrich_browser(events: DataFrame, ref: Reference, *, mode: str = "ancestor", cut: Callable[[DataFrame], DataFrame] = lazily, sieved: bool = False) -> DataFrame:
    """Typed browser events to enriched ones; ``cut`` and ``sieved`` as for DNS."""
    e = events if sieved else sieve.sieve_browser(events, ref.ignore).filter("drop_reason is null")
    e = e.withColumn("host", sieve.browser_host(F.col("host")))
    e = e if sieved else cut(e)
    facts, found = host_facts(e, ref, mode)
    e = enrich.client_identity(enrich.browser_times(e)).join(cut(facts.drop("public_suffix")), "host", "left")
    e = enrich.browser_searches(e).withColumn("request", F.col("scheme"))
    return _judged(e, ref, mode, found, cut)  # there are no chains
