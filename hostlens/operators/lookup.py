"""Looking hosts up in the entries: by ancestors and wildcards, or by exact key.

All look-ups take distinct hosts; events repeat few hosts many times.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import probes


def no_texts() -> Column:
    """An empty list of text."""
    return F.array().cast("array<string>")


def ancestor_lookup(hosts: DataFrame, entries: DataFrame) -> DataFrame:
    """(host, contexts, sources, matched_on) of each distinct ``host`` that matches.

    A host matches entries for itself and its parents, and wildcards on these (``*.x``
    also covers ``x``). Sets are united and sorted; ``matched_on`` keeps probe order.

    Every host probes its top level: these few short keys, each hot, are looked up by a
    broadcast of the single-label entries; all others join by hash.
    """
    p = hosts.select("host").filter("host is not null").distinct().select("host", F.posexplode(probes(F.col("host"))).alias("pos", "domain"))
    top = ~F.contains(F.regexp_replace("domain", r"^\*\.", ""), F.lit("."))
    e_top = ~F.contains(F.regexp_replace(F.col("domain"), r"^\*\.", ""), F.lit("."))
    # single-label entries: at most two for each top-level domain
    hits = p.filter(~top).join(entries.filter(~e_top), "domain").unionByName(p.filter(top).join(F.broadcast(entries.filter(e_top)), "domain"))
    return hits.groupBy("host").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("categories")))).alias("contexts"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "domain"))), lambda x: x["domain"]).alias("matched_on"),
    )


def exact_lookup(events: DataFrame, entries: DataFrame, *, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``events`` with ``contexts``: categories of their ``searches``, in that order, once each.

    Distinct arrays are looked up; events join them once, with all their columns.
    """
    terms = events.select("searches").distinct().withColumn("_s", F.col("searches"))
    hits = terms.select("searches", F.posexplode("_s").alias("pos", "domain")).join(entries.select("domain", "categories"), "domain")
    found = hits.groupBy("searches").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "categories"))), lambda x: x["categories"]))).alias("contexts"))
    return events.join(cut(found), "searches", "left").withColumn("contexts", F.coalesce("contexts", no_texts()))


def chain_lookup(chains: DataFrame, found: DataFrame) -> DataFrame:
    """(chain, cname_contexts, cname_sources, cname_matched_on) of distinct ``chain`` arrays.

    ``found`` is ``ancestor_lookup`` over all hosts, the chains' targets among them.
    """
    c = chains.select("chain").filter(F.size("chain") > 0).distinct().withColumn("_c", F.col("chain"))
    hits = c.select("chain", F.posexplode("_c").alias("pos", "host")).join(found, "host")
    return hits.groupBy("chain").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("contexts")))).alias("cname_contexts"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("cname_sources"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "matched_on"))), lambda x: x["matched_on"]))).alias("cname_matched_on"),
    )


def with_chains(events: DataFrame, found: DataFrame | None, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Adds the ``cname_*`` columns. Only events with a chain are joined (most have none, and
    would all meet as one key); without ``found`` or a chain they are null."""
    kinds = {"cname_contexts": "array<string>", "cname_sources": "array<string>", "cname_matched_on": "array<string>"}
    nulls = {c: F.lit(None).cast(t) for c, t in kinds.items()}
    if found is None or "chain" not in events.columns:
        return events.withColumns(nulls)
    some = F.coalesce(F.size("chain") > 0, F.lit(False))
    c = cut(chain_lookup(events, found))
    return events.filter(some).join(c, "chain", "left").unionByName(events.filter(~some).withColumns(nulls))


def hosts_of(events: DataFrame) -> DataFrame:
    """Distinct hosts of events: questions and (where there are) chain targets in one pass."""
    if "chain" not in events.columns:
        return events.select("host").filter("host is not null").distinct()
    return events.select(F.explode(F.concat(F.array("host"), F.coalesce("chain", no_texts()))).alias("host")).filter("host is not null").distinct()


def resolve(
    events: DataFrame, entries: DataFrame | None, *, mode: str = "ancestor", exact_entries: DataFrame | None = None, built_at: int | None = None, found: DataFrame | None = None,
    cut: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Adds contexts to events with ``host``, ``searches`` and (perhaps) ``chain``.

    ``ancestor``: question and chain are looked up and merged. ``exact``: the searches
    only, by exact key; chains are recorded. ``compare``: exact decides, ancestors are
    noted beside it (``contexts_index``, ``context_match``), chains are not merged.
    Without ``entries``, ``exact`` with an ``index_error``. ``found`` is the
    ``ancestor_lookup`` of all hosts, where it is known; events may bring their host's
    row of it as the struct ``_found``, and the ``cname_*`` columns (``with_chains``).
    """
    if mode not in ("ancestor", "exact", "compare"):
        raise ValueError(mode)
    none = no_texts()
    error = None
    if entries is None and mode != "exact":
        mode, error = "exact", "no index"
    out = events
    if mode in ("exact", "compare"):
        known = exact_entries if exact_entries is not None else entries
        out = exact_lookup(out, known, cut=cut) if known is not None else out.withColumn("contexts", none)
    if mode in ("ancestor", "compare"):
        if found is None:
            found = cut(ancestor_lookup(hosts_of(events), entries))
        if "cname_contexts" not in out.columns:
            out = with_chains(out, found, cut)
        if "_found" not in out.columns:
            out = out.join(found.select("host", F.struct("contexts", "sources", "matched_on").alias("_found")), "host", "left")
        out = out.withColumn("index_built_at", F.lit(built_at).cast("long"))
    if mode == "compare":
        out = out.withColumn("contexts_index", F.coalesce("_found.contexts", none)).withColumn("sources", F.coalesce("_found.sources", none)).withColumn("matched_on", F.coalesce("_found.matched_on", none))
        return out.withColumn("context_match", F.array_sort("contexts") == F.array_sort("contexts_index")).withColumn("match_source", _source(F.col("contexts"), none)).drop("cname_sources", "_found")
    if mode == "exact":
        return out.withColumn("match_source", _source(F.col("contexts"), none)).withColumn("index_error", F.lit(error).cast("string")).drop("cname_sources", "_found")
    q, c = F.coalesce("_found.contexts", none), F.coalesce("cname_contexts", none)
    return (
        out.withColumn("match_source", _source(q, c))
        .withColumn("contexts", F.array_sort(F.array_union(q, c)))
        .withColumn("sources", F.array_sort(F.array_union(F.coalesce("_found.sources", none), F.coalesce("cname_sources", none))))
        .withColumn("matched_on", F.coalesce("_found.matched_on", none))
        .drop("cname_sources", "_found")
    )


def _source(question, chain):
    """question and/or cname; null where neither has contexts."""
    said = F.array_compact(F.array(F.when(F.size(question) > 0, "question"), F.when(F.size(chain) > 0, "cname")))
    return F.when(F.size(said) > 0, said)
