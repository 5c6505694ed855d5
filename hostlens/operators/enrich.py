"""Search terms, times, identities and the documents that are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ip import resolved_addresses, routable_addresses
from ..functions.text import direction, normalize_host, or_null, response_code, short_hostname, tld, ws_strip

def _low(c: str) -> Column:
    return F.lower(ws_strip(F.col(c)))


def dns_searches(events: DataFrame, *, strict: bool = False) -> DataFrame:
    """Adds ``searches`` and ``host`` (the first of them).

    The resource, else the question's name; then the registered domain, its wildcard
    and that of its top level. ``strict`` leaves dots at the ends as they come, so that
    ``example.com.`` finds nothing.
    """
    clean = _low if strict else (lambda c: normalize_host(F.col(c)))
    d = F.coalesce(clean("etld_plus_one"), clean("registered_domain"))
    terms = F.array(F.coalesce(clean("resource"), clean("question")), d, F.concat(F.lit("*."), d), F.concat(F.lit("*."), tld(d)))
    return events.withColumn("searches", F.array_compact(terms)).withColumn("host", F.get("searches", F.lit(0)))


def browser_searches(events: DataFrame) -> DataFrame:
    """Adds ``searches`` to events with their normalised ``host`` and ``registrable_domain``."""
    h, d = F.col("host"), F.when(F.col("registrable_domain") != F.col("host"), F.col("registrable_domain"))
    terms = F.array(h, F.concat(F.lit("*."), h), F.concat(F.lit("*."), tld(h)), d, F.concat(F.lit("*."), d))
    return events.withColumn("searches", F.array_compact(terms))


def dns_request(events: DataFrame) -> DataFrame:
    """Adds ``request`` (query or reply) and ``client``, the side that asked."""
    e = events.withColumn("request", direction(F.col("direction")))
    return e.withColumn("client", F.when(F.col("request") == "query", F.col("client_ip")).when(F.col("request") == "reply", F.col("destination_ip")))


def cname_chain(events: DataFrame) -> DataFrame:
    """Adds ``chain``: normalised CNAME targets in order, once each."""
    hosts = F.transform("cnames", normalize_host)
    return events.withColumn("chain", F.array_distinct(F.filter(hosts, lambda h: h.isNotNull())))


def dns_answers(events: DataFrame) -> DataFrame:
    """``resolved_ips`` (null when none) and the response code in capitals, of events that
    bring what these are made of."""
    e = events
    if "resolved_ip" in e.columns:
        e = e.withColumn("_ips", resolved_addresses(F.col("resolved_ip"))).withColumn("resolved_ips", F.when(F.size("_ips") > 0, F.col("_ips"))).drop("_ips")
    return e.withColumn("response_code", response_code(F.col("response_code"))) if "response_code" in e.columns else e


def client_identity(events: DataFrame) -> DataFrame:
    """Adds the ``client_*`` fields; blank ones are null."""
    e = events
    for name, c in (("client_hostname", "hostname"), ("client_user", "user"), ("client_platform", "platform"), ("client_browser", "browser")):
        e = e.withColumn(name, or_null(_low(c)))
    e = e.withColumn("client_hostname_short", or_null(short_hostname(F.col("client_hostname"))))
    return e.withColumn("_ips", routable_addresses(F.col("ip_addresses"))).withColumn("client_ips", F.when(F.size("_ips") > 0, F.col("_ips"))).drop("_ips")


def browser_times(events: DataFrame) -> DataFrame:
    """Adds ``event_time_utc`` and ``event_time_local`` (text).

    Safari writes local time in the zone of ``processed_at``: it is shifted to UTC.
    Chrome and Firefox write UTC: local time is shifted to that zone. For others, or
    without a zone or a readable time, both are the time as it came.
    """
    zone = F.regexp_extract("processed_at", r"(Z|[+-][0-9]{2}:?[0-9]{2})$", 1)
    offset = F.when(zone == "Z", "+00:00").when(zone != "", F.regexp_replace(zone, "^(...):?(..)$", "$1:$2"))
    raw = F.to_timestamp_ntz(F.regexp_extract("timestamp", r"^([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2})", 1).try_cast("timestamp_ntz").cast("string"))
    e = events.withColumn("_t", raw).withColumn("_z", offset)
    text = lambda t, z: F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), z)
    known = F.col("_t").isNotNull() & F.col("_z").isNotNull()
    safari, utc = known & (F.col("browser") == "safari"), known & F.col("browser").isin("chrome", "firefox")
    e = e.withColumn("event_time_utc", F.when(safari, text(F.convert_timezone(F.col("_z"), F.lit("UTC"), F.col("_t")), F.lit("Z"))).otherwise(F.col("timestamp")))
    local = F.when(safari, text(F.col("_t"), F.col("_z"))).when(utc, text(F.convert_timezone(F.lit("UTC"), F.col("_z"), F.col("_t")), F.col("_z"))).otherwise(F.col("timestamp"))
    return e.withColumn("event_time_local", local).drop("_t", "_z")


#: Fields of a document, beside those that every document has.
DNS_FIELDS = ["client", "client_hosts", "client_hosts_short", "ptr", "ptr_status"]
BROWSER_FIELDS = ["event_time_utc", "event_time_local", "url", "client_hostname", "client_hostname_short", "client_user", "client_platform", "client_browser", "client_ips"]
SHARED_FIELDS = [
    "sources", "matched_on", "index_built_at", "contexts_index", "context_match", "index_error", "cname_chain", "cname_matched_on", "cname_contexts", "match_source",
    "resolved_ips", "response_code", "registrable_domain", "psl_fallback", "searches", "contexts", "purpose", "service", "risk", "risk_severity", "unmapped_contexts", "request", "type",
]


def documents(events: DataFrame, *, beat: str = "hostlens", version: str = "0.1.0", packet: str = "value") -> DataFrame:
    """(`@timestamp`, `@metadata`, doc, packet) of enriched events.

    Fields that an event hasn't got are null, which JSON leaves out; fields that
    documents always carry are empty lists. Events without search terms go.
    """
    e = events.filter(F.size("searches") > 0)
    if "chain" in e.columns:
        e = e.withColumn("cname_chain", F.when(F.size("chain") > 0, F.col("chain")))
    names = [c for c in DNS_FIELDS + BROWSER_FIELDS + SHARED_FIELDS if c in e.columns]
    doc = F.struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("processed"), F.array(F.get("searches", F.lit(0))).alias("requested"), *names)
    time = F.coalesce("event_time_utc", "timestamp") if "event_time_utc" in e.columns else F.col("timestamp")
    meta = F.struct(F.lit(beat).alias("beat"), F.lit("_doc").alias("type"), F.lit(version).alias("version"))
    return e.select(time.alias("@timestamp"), meta.alias("@metadata"), doc.alias("doc"), (F.col(packet) if packet in e.columns else F.lit(None).cast("string")).alias("packet"))


def united(dns: DataFrame, browser: DataFrame) -> DataFrame:
    """Documents of both feeds; fields of the other feed are null."""
    flat = lambda d: d.select("`@timestamp`", "`@metadata`", "doc.*", "packet")
    return flat(dns).unionByName(flat(browser), allowMissingColumns=True)
