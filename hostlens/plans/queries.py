"""Queries of the operators over the given tables, and the same in SQL.

The tables hold no packets; ``ADAPTER`` makes events, list lines and hosts of pages and
events, in SQL that both engines run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ip, text
from ..operators import enrich, entries as ent, increments, lookup, ptr, reports, sieve, sinks
from ..operators.suffix import registrable_domains
from ..operators.taxonomy import severities, severity_rows, taxonomy, taxonomy_rows, with_facets
from ..session import shared_dir, spread, written
from ..sources import lists
from ..sources.events import parse
from ..streaming import consumer
from ..streaming.ptr_memory import state_store, with_ptr_stream
from ..streaming.reference import LastGood
from .jobs import Reference, build_entries, enrich_browser, enrich_dns

ADAPTER = """
v_e as (
  select *, event_id % (select count(*) from {pages}) as p1, (event_id * 7 + 3) % (select count(*) from {pages}) as p2, (event_id * 3 + 1) % (select count(*) from {pages}) as p3 from {events}),
v_hosts as (
  select page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) as host, regexp_extract(url, '^([a-z]+)://', 1) as scheme from {pages}),
v_dns as (
  select e.event_id, e.ts, case when e.event_type = 'error' then 'Error' else 'OK' end as status,
    case e.event_type when 'purchase' then 'egress' when 'signup' then 'outbound' when 'view' then 'inbound' else 'ingress' end as direction,
    concat('10.0.', cast(floor(e.user_id / 250) as integer), '.', e.user_id % 250) as client_ip, e.user_id,
    case when e.event_id % 23 = 0 then concat('w', e.event_id % 3, '.uncategorised.info') else h.host end as resource, n.host as cname, case when e.event_id % 17 = 0 then 'nxdomain' else 'noerror' end as response_code
  from v_e e join v_hosts h on h.page_id = e.p1 left join v_hosts n on e.event_id % 5 = 0 and n.page_id = e.p2),
v_list_lines as (
  select page_id, concat('list', page_id % 4) as source, case page_id % 5 when 0 then 'tracking' when 1 then 'malware' when 2 then 'social' when 3 then 'madeup' else 'news' end as folder,
    case page_id % 7 when 0 then host when 1 then concat('0.0.0.0 ', host, ' # note') when 2 then concat('||', host, '^$third-party')
      when 3 then concat('*.', regexp_extract(host, '([^.]+[.][^.]+)$', 1)) when 4 then concat('# ', host) when 5 then concat('@@||', host, '^')
      else concat('::1 ', upper(host), '.') end as line from v_hosts),
v_ignorelist as (
  select 'tracking' as context, host from v_hosts where page_id % 11 = 0 union all select 'malware' as context, upper(host) as host from v_hosts where page_id % 22 = 5),
v_web as (
  select e.event_id, e.ts, e.user_id, h.host, h.url, h.scheme, case cast(floor(e.event_id / 3) as bigint) % 4 when 0 then 'safari' when 1 then 'chrome' when 2 then 'firefox' else 'edge' end as browser,
    case when e.event_id % 2 = 0 then '-0400' else '+05:30' end as zone,
    concat('10.0.', cast(floor(e.user_id / 250) as integer), '.', (e.user_id - e.user_id % 2) % 250) as address
  from v_e e join v_hosts h on h.page_id = e.p3 where e.event_id % 3 = 0),
v_seen as (
  select e.user_id, e.ts, e.event_id, concat('10.0.', cast(floor(e.user_id / 250) as integer), '.', e.user_id % 250) as client,
    case e.user_id % 5 when 0 then 'nxdomain' when 1 then 'Timeout' else 'ok' end as status from {events} e where e.event_id % 4 = 1)
"""
CONFIGURED = [("list2", ["social", "facebook"]), ("list1", ["malware"]), ("list3", [])]
RULES = [("exact", "com"), ("exact", "net"), ("exact", "org"), ("exact", "example.net"), ("wildcard", "example.org"), ("exception", "spam-farm.example.org")]
IGNORE = [
    ("dns", "domain", "casino-win.example.org."), ("dns", "domain", "Example.NET"), ("dns", "host", "ththre.example.com"), ("dns", "client", "10.0.0.7"),
    ("browser", "user", "u13"), ("browser", "client", "host-5"), ("browser", "client", "10.0.0.20"), ("browser", "domain", "spam-farm.example.org"), ("browser", "host", "ththed.example.org"),
]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return spark.sql(f"with {ADAPTER} select * from {name}", pages=read("pages"), events=read("events"))


def small(spark: SparkSession, what: str) -> DataFrame:
    rows, schema = {
        "configured": (CONFIGURED, "source string, categories array<string>"), "rules": (RULES, "kind string, rule string"), "ignore": (IGNORE, "scope string, kind string, value string"),
    }[what]
    return spark.createDataFrame(rows, schema)


def dns_events(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "v_dns").select(
        "event_id", "ts", "user_id", F.lit("dns").alias("type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "status", "resource", "direction",
        "client_ip", F.col("client_ip").alias("destination_ip"), F.lit(None).cast("string").alias("question"), F.substring_index("resource", ".", -2).alias("etld_plus_one"),
        F.lit(None).cast("string").alias("registered_domain"), "response_code", F.array("client_ip", F.when(F.col("event_id") % 50 == 0, "0.0.0.0")).alias("resolved_ip"),
        F.when(F.col("cname").isNotNull(), F.array(F.concat(F.upper("cname"), F.lit(".")), "cname")).otherwise(F.array().cast("array<string>")).alias("cnames"),
    )


def web_events(s: SparkSession, d: str) -> DataFrame:
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return view(s, d, "v_web").select(
        "event_id", "ts", F.lit("browser.history").alias("type"), F.concat(stamp, F.lit("Z")).alias("timestamp"), F.concat(stamp, F.lit(".5"), "zone").alias("processed_at"),
        F.lit(True).alias("has_data"), F.lit(True).alias("has_entry"), "url", "scheme", F.concat(F.upper("host"), F.lit(":8080")).alias("host"),
        F.concat(F.lit(" Host-"), "user_id", F.lit(".Lan")).alias("hostname"), F.concat(F.lit("host-"), "user_id").alias("hostname_short"), F.concat(F.lit("u"), "user_id").alias("user"),
        F.lit(None).cast("string").alias("platform"), "browser", F.array(F.lit("169.254.0.9"), "address", "address").alias("ip_addresses"),
    )


def observations(s: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.when(F.col("user_id") % 2 == 0, "host-").otherwise("pc-"), "user_id", F.lit(".office.lan"))
    # as resolvers answer: with the root's dot, and one name in several cases
    hosts = F.when(F.col("status") == "ok", F.array(F.concat(F.upper(name), F.lit(".")), name)).otherwise(F.array().cast("array<string>"))
    # of what was seen of a client in one second the last counts
    seen = view(s, d, "v_seen").groupBy("client", "ts").agg(F.max(F.struct("event_id", "user_id", "status")).alias("x")).select("client", "ts", "x.*")
    return seen.select("client", F.col("ts").alias("observed_at"), hosts.alias("hosts"), "status")


_entries: dict[tuple[str, str], DataFrame] = {}


def entries_of(s: SparkSession, d: str) -> DataFrame:
    """Built once for a session and folder and written; jobs read a published generation."""
    key = (s.sparkContext.applicationId, d)
    if key not in _entries:
        _entries[key] = written(build_entries(view(s, d, "v_list_lines"), small(s, "configured"), view(s, d, "v_ignorelist")))
    return _entries[key]


def reference(s: SparkSession, d: str, **more: DataFrame) -> Reference:
    return Reference(entries_of(s, d), small(s, "rules"), small(s, "ignore"), **more)


def dns(s: SparkSession, d: str, mode: str = "ancestor", wanted: tuple[str, ...] = ()) -> DataFrame:
    return enrich_dns(dns_events(s, d), reference(s, d), mode=mode, cut=written, wanted=["event_id", "client", *wanted])


def listed(*names: str) -> list[Column]:
    return [F.array_join(n, "|").alias(n) for n in names]


# --- lists ---------------------------------------------------------------------------


def merged(s: SparkSession, d: str) -> DataFrame:
    return ent.merge_entries(ent.with_categories(ent.clean_lines(view(s, d, "v_list_lines")), small(s, "configured")))


def build_stats(s: SparkSession, d: str) -> DataFrame:
    lines = view(s, d, "v_list_lines")
    curated = ent.curated_lines(lines)
    return ent.build_statistics(ent.with_categories(curated, small(s, "configured")), curated)


def clean_known(s: SparkSession, d: str) -> DataFrame:
    return ent.clean_lines(view(s, d, "v_list_lines"), s.createDataFrame([("com",), ("org",)], "tld string"))


def kept_previous(s: SparkSession, d: str) -> DataFrame:
    rows = ent.clean_lines(view(s, d, "v_list_lines"))
    return ent.keep_previous(rows.filter("source <> 'list2' or folder = 'news'"), rows.withColumn("host", F.concat(F.lit("old."), "host")))


def population(s: SparkSession, d: str) -> DataFrame:
    return ent.exact_population(view(s, d, "v_list_lines").select("line", F.array("folder").alias("categories")))


def combos(s: SparkSession, d: str) -> DataFrame:
    e = merged(s, d)
    return ent.combinations(e).select("attr_id", *listed("categories", "sources"), "domains")


def encoded(s: SparkSession, d: str) -> DataFrame:
    e = merged(s, d)
    return ent.encoded(e, ent.combinations(e))


def new_root(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


def generation_sum(s: SparkSession, d: str) -> DataFrame:
    """Refused builds between published ones: the two newest published stay."""
    root = new_root(s, "generations")
    built = entries_of(s, d)
    for n, needed in ((1, "*.example.com"), (2, "no.such"), (3, "*.example.com"), (4, "no.such"), (5, "*.example.com"), (6, "no.such")):
        try:
            sinks.publish(built, root, built_at=n, needed=[needed], least=5)
        except ValueError:
            if needed != "no.such":
                raise
    stored = sinks.generations(s, root)
    return sinks.checksum(sinks.read_generation(s, root)).withColumn("generations", F.lit(len(stored))).withColumn("stored", F.lit(",".join(map(str, stored))))


def bucketed(s: SparkSession, d: str) -> DataFrame:
    """A published generation whose rows are dealt by domain."""
    root = new_root(s, "generations")
    sinks.publish(entries_of(s, d), root, built_at=1, buckets=8)
    return sinks.read_generation(s, root)


def entries_below(s: SparkSession, d: str) -> DataFrame:
    e = bucketed(s, d)
    parts = [ent.below(e, x).select(F.lit(x).alias("below"), "domain", *listed("categories")) for x in ("com", "example.org", "spam-farm.example.net")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def built_by_steps(s: SparkSession, d: str) -> DataFrame:
    """Three builds: a list and half of another are missing, then one is empty, then all are there."""
    root, lines, ign = new_root(s, "increments"), written(view(s, d, "v_list_lines")), view(s, d, "v_ignorelist")
    steps = [
        (lines.filter("source <> 'list3' and (source <> 'list2' or page_id % 2 = 0)"), ign.filter("context <> 'malware'")), (lines.filter("source <> 'list0'"), ign), (lines, ign)
    ]
    for n, (some, rules) in enumerate(steps, 1):
        increments.build_next(some.select("source", "folder", "line"), small(s, "configured"), rules, root, built_at=n, least=5)
    return sinks.read_generation(s, root).select("domain", "reversed", *listed("categories", "sources"))


def list_folder(s: SparkSession, d: str) -> str:
    """Lists, a registry, an ignorelist and top-level domains as the files of a folder."""
    root, held = new_root(s, "lists"), new_root(s, "held")
    view(s, d, "v_list_lines").select("line", "folder", "source").repartition("folder", "source").write.partitionBy("folder", "source").text(held)
    for folder, source in (x.split("/") for x in sinks.children(s, held, 2)):
        (part,) = (x for x in sinks.children(s, f"{held}/{folder}/{source}", 1) if x.startswith("part-"))
        sinks.move(s, f"{held}/{folder}/{source}/{part}", f"{root}/{folder.partition('=')[2]}/{source.partition('=')[2]}")
    s.createDataFrame([("# known",), ("COM",), ("",), ("org",)], "value string").coalesce(1).write.text(f"{root}/tld/known.txt")
    rows = [(f"n-{f}", f"any/{f}", "https://lists.example/x", c) for f, c in CONFIGURED]
    s.createDataFrame(rows, "name string, file string, url string, categories array<string>").coalesce(1).write.json(f"{root}/index/registry")
    ign = view(s, d, "v_ignorelist").groupBy("context").agg(F.collect_list("host").alias("hosts"))  # a person's file
    ign.groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("context", "hosts")))).alias("value")).coalesce(1).write.text(f"{root}/index/ignored")
    return root


def from_files(s: SparkSession, d: str) -> DataFrame:
    """Entries from list files, by the registry, the ignorelist and the known domains beside them."""
    root = list_folder(s, d)
    lines = lists.read_list_lines(s, root, exclude=["./news/./list0"])
    known = lists.tlds(s.read.text(f"{root}/tld/*").withColumnRenamed("value", "line"))
    registry = lists.registry_files(s.read.schema("name string, file string, url string, categories array<string>").json(f"{root}/index/registry"))
    built = build_entries(lines, registry, lists.read_ignorelist(s, f"{root}/index/ignored"), known)
    return built.select("domain", *listed("categories", "sources"))


# --- events ---------------------------------------------------------------------------


def normal_forms(s: SparkSession, d: str) -> DataFrame:
    h = view(s, d, "v_hosts").select("page_id", F.concat(F.lit(" ."), F.upper("host"), F.lit(". \t")).alias("raw"), "host")
    return h.select(
        "page_id", text.normalize_host(F.col("raw")).alias("normal"), text.strip_port(F.concat("host", F.lit(":80"))).alias("bare"), text.short_hostname(F.concat("host", F.lit("."))).alias("short"),
        text.reverse_labels(F.col("host")).alias("reversed"), text.naive_domain(F.col("host")).alias("naive"), text.tld(F.col("host")).alias("tld"), F.array_join(text.probes(F.col("host")), "|").alias("probes"),
    )


def addresses(s: SparkSession, d: str) -> DataFrame:
    d4 = view(s, d, "v_dns").select("client_ip", F.hex(F.col("user_id") % 4096 + 1).alias("_x")).distinct()
    forms = F.array("client_ip", *(F.concat(F.lit(x), "_x") for x in ("2606:4700:0:0:0:0:0:", "fe80:0:0:0:0:0:0:", "no address ")))
    a = d4.select(F.explode(forms).alias("client_ip")).distinct()
    return a.select("client_ip", ip.canonical_ip("client_ip").alias("canonical"), ip.ip_class("client_ip").alias("class"), ip.reverse_name("client_ip").alias("reverse"))


def dns_shape(s: SparkSession, d: str) -> DataFrame:
    e = enrich.dns_answers(enrich.cname_chain(enrich.dns_request(enrich.dns_searches(dns_events(s, d)))))
    return e.select("event_id", *listed("searches", "chain", "resolved_ips"), "request", "client", "response_code")


def dns_sieved(s: SparkSession, d: str) -> DataFrame:
    return sieve.sieve_dns(dns_events(s, d), small(s, "ignore")).select("event_id", "drop_reason")


def guessed(s: SparkSession, d: str) -> DataFrame:
    g = registrable_domains(view(s, d, "v_hosts"), small(s, "rules").limit(0))
    return g.select("host", "registrable_domain", "psl_fallback")


def rules_of_lines(s: SparkSession, d: str) -> DataFrame:
    h = view(s, d, "v_hosts")
    line = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("// "), "host")).when(F.col("page_id") % 5 == 1, F.concat(F.lit("*."), "host", F.lit(" x"))).when(F.col("page_id") % 5 == 2, F.concat(F.lit("!"), "host"))
    return lists.suffix_rules(h.select(line.when(F.col("page_id") % 5 == 3, F.concat(F.lit(" M\u00dcNCHEN."), "host")).otherwise(F.concat("host", F.lit("\t"))).alias("line")))


def web_sieved(s: SparkSession, d: str) -> DataFrame:
    return sieve.sieve_browser(web_events(s, d), small(s, "ignore")).select("event_id", "drop_reason")


def verdicts(s: SparkSession, d: str) -> DataFrame:
    e = sieve.sieve_dns(dns_events(s, d), small(s, "ignore"))
    return sieve.verdict_counts(sieve.with_verdict(e, F.col("event_id") % 13 != 0))


def audit(s: SparkSession, d: str) -> DataFrame:
    a = sieve.with_verdict(sieve.sieve_dns(dns_events(s, d), small(s, "ignore")), F.lit(True)).select("event_id", sieve.dns_audit(F.col("verdict")).alias("line"))
    b = sieve.with_verdict(sieve.sieve_browser(web_events(s, d), small(s, "ignore")), F.lit(True)).select("event_id", sieve.browser_audit(F.col("verdict")).alias("line"))
    return a.unionByName(b)


def suffixes(s: SparkSession, d: str) -> DataFrame:
    hosts = view(s, d, "v_hosts").select("host").union(s.createDataFrame([("com",), ("example.org",), ("x.example.org",), ("localhost",)], "host string"))
    return registrable_domains(hosts, small(s, "rules")).select("host", "public_suffix", "registrable_domain")


def looked_up(s: SparkSession, d: str) -> DataFrame:
    return lookup.ancestor_lookup(view(s, d, "v_hosts"), entries_of(s, d)).select("host", *listed("contexts", "sources", "matched_on"))


def looked_up_exactly(s: SparkSession, d: str) -> DataFrame:
    e = lookup.exact_lookup(enrich.dns_searches(dns_events(s, d)), entries_of(s, d), cut=written)
    return e.select("event_id", F.array_join(F.array_sort("contexts"), "|").alias("contexts"))


def enriched(s: SparkSession, d: str) -> DataFrame:
    e = dns(s, d)
    return e.select("event_id", "host", "registrable_domain", "risk_severity", *listed("contexts", "sources", "matched_on", "match_source", "cname_contexts", "purpose", "service", "risk", "unmapped_contexts"))


def compared(s: SparkSession, d: str) -> DataFrame:
    return dns(s, d, "compare").select("event_id", F.array_join(F.array_sort("contexts"), "|").alias("contexts"), *listed("contexts_index", "cname_contexts", "match_source"), "context_match")


def exactly(s: SparkSession, d: str) -> DataFrame:
    return dns(s, d, "exact").select("event_id", F.array_join(F.array_sort("contexts"), "|").alias("contexts"), *listed("match_source"), "index_error")


def without_index(s: SparkSession, d: str) -> DataFrame:
    ref = Reference(None, small(s, "rules"), small(s, "ignore"), exact_entries=entries_of(s, d))
    return enrich_dns(dns_events(s, d), ref, cut=written, wanted=["event_id"]).select("event_id", F.array_join(F.array_sort("contexts"), "|").alias("contexts"), "index_error")


def faceted(s: SparkSession, d: str) -> DataFrame:
    tax = taxonomy_rows()
    cats = sorted({c for c, *_ in tax})
    pick = lambda k: F.element_at(F.array(*map(F.lit, cats)), (F.pmod(F.col("event_id") * k + k, F.lit(len(cats))) + 1).cast("int"))
    e = s.read.parquet(f"{d}/events.parquet").select("event_id", F.array_distinct(F.array(pick(1), pick(7), F.when(F.col("event_id") % 9 == 0, " NoSuch ").otherwise("ai"))).alias("contexts"))
    return with_facets(e, taxonomy(s), severities(s)).select("event_id", *listed("purpose", "service", "risk", "unmapped_contexts"), "risk_severity")


def named_clients(s: SparkSession, d: str) -> DataFrame:
    return ptr.with_ptr(asking(s, d), observations(s, d))


def asking(s: SparkSession, d: str) -> DataFrame:
    """Events with their client, which for some is no address."""
    e = enrich.dns_request(dns_events(s, d))
    return e.withColumn("client", F.when(F.col("event_id") % 31 == 0, "bad host").otherwise(F.col("client")))


def asof_stream(s: SparkSession, d: str) -> DataFrame:
    """The same by a stream's state: thirds of the time arrive one after another, and the
    stream is stopped and started again between them."""
    state_store(s)
    root = new_root(s, "ptr-stream")
    e, o = written(asking(s, d).select("event_id", "client", "ts")), written(observations(s, d))
    first, last = e.agg(F.min("ts"), F.max("ts")).first()
    # what comes last lets all others go
    end = s.createDataFrame([(-1, "0.0.0.0")], "event_id long, client string").withColumn("ts", F.lit(last).cast(e.schema["ts"].dataType) + F.expr("interval 2 days"))
    for third in range(3):
        part = lambda c: F.least(F.lit(2), F.floor((F.unix_micros(F.col(c).cast("timestamp")) - F.unix_micros(F.lit(first).cast("timestamp"))) * 3 / F.greatest(F.lit(1), F.unix_micros(F.lit(last).cast("timestamp")) - F.unix_micros(F.lit(first).cast("timestamp"))))) == third  # noqa: E731, B023
        now = e.filter(part("ts"))
        (now.unionByName(end) if third == 2 else now).write.mode("append").parquet(f"{root}/events")
        o.filter(part("observed_at")).write.mode("append").parquet(f"{root}/seen")
        read = lambda df, name: s.readStream.schema(df.schema).parquet(f"{root}/{name}")
        found = with_ptr_stream(read(e, "events"), read(o, "seen"), late="1 second").filter("event_id >= 0")
        found.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(found.schema).parquet(f"{root}/out").select("event_id", "ptr", "ptr_status", *listed("client_hosts", "client_hosts_short"))


_streamed: dict[tuple[str, str], str] = {}


def streamed(s: SparkSession, d: str) -> str:
    """Where a consumer wrote the payloads, which came in thirds. In the second third the
    published generation is damaged, in the last one there is a new one. Once a session."""
    key = (s.sparkContext.applicationId, d)
    if key not in _streamed:
        root, rows = new_root(s, "consumed"), payloads(s, d)
        entries = entries_of(s, d)
        sinks.publish(entries, f"{root}/entries", built_at=1)
        current = LastGood(s, f"{root}/entries", lambda e, at: Reference(e, small(s, "rules"), small(s, "ignore"), built_at=at))
        for third in range(3):
            if third:
                sinks.publish(entries, f"{root}/entries", built_at=third + 1)
            if third == 1:
                entries.limit(3).write.mode("overwrite").parquet(f"{root}/entries/generation=2")
            rows.filter(F.regexp_extract("event_id", "[0-9]+", 0).cast("long") % 3 == third).select("value").write.mode("append").text(f"{root}/in")
            consumer.consume(s.readStream.text(f"{root}/in"), current, f"{root}/out", f"{root}/checkpoint", once=True).awaitTermination()
        _streamed[key] = f"{root}/out"
    return _streamed[key]


def stream_documents(s: SparkSession, d: str) -> DataFrame:
    docs = consumer.committed(s, streamed(s, d))
    return docs.select(F.get_json_object("packet", "$.id").alias("id"), "type", *listed("contexts", "risk"), "index_built_at")


def stream_counts(s: SparkSession, d: str) -> DataFrame:
    """What the commits counted, while the events were sieved."""
    sums = consumer.commits(s, streamed(s, d)).agg(*(F.sum(v).alias(v) for v in consumer.VERDICTS))
    return sums.unpivot([], list(consumer.VERDICTS), "verdict", "events")


def clients_by_day(s: SparkSession, d: str) -> DataFrame:
    """Distinct clients over daily tables, and whether the united sketches are within four
    standard errors of them."""
    root = new_root(s, "daily")
    base = reports.daily_clients(dns(s, d, wanted=("ts",)))
    base.write.partitionBy("day").parquet(f"{root}/clients")
    base = s.read.parquet(f"{root}/clients")
    reports.daily_domains(base).write.partitionBy("day").parquet(f"{root}/domains")
    near = reports.sketched_clients(s.read.parquet(f"{root}/domains")).select("registrable_domain", F.col("clients").alias("_near"))
    bound = 4 * 1.04 / 2 ** (reports.SKETCH_BITS / 2)
    exact = reports.distinct_clients(base).join(near, "registrable_domain")
    return exact.select("registrable_domain", "events", "clients", (F.abs(F.col("_near") - F.col("clients")) <= F.greatest(F.lit(1), F.col("clients") * bound)).alias("sketch_is_near"))


def nameless(s: SparkSession, d: str) -> DataFrame:
    """Every tenth event has no name at all: there is nothing to look up, and it goes."""
    none = F.col("event_id") % 10 == 0
    e = dns_events(s, d).withColumns({c: F.when(~none, F.col(c)) for c in ("resource", "etld_plus_one")})
    return enrich_dns(e, reference(s, d), cut=written, wanted=["event_id"]).select("event_id", F.size("searches").alias("terms"))


def daily_rows(s: SparkSession, d: str) -> DataFrame:
    """Documents by the day they came in, in the operator's zone, written and read back."""
    root = new_root(s, "daily-index")
    e = s.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "ts")
    sinks.write_daily(e, root, prefix="bites", zone="America/New_York", processed=F.col("ts"))
    return s.read.parquet(root).select("index_name", "event_id", "user_id")


def asof(s: SparkSession, d: str) -> DataFrame:
    return named_clients(s, d).select("event_id", "ptr", "ptr_status", *listed("client_hosts", "client_hosts_short"))


def remembered(s: SparkSession, d: str) -> DataFrame:
    return ptr.bounded(observations(s, d), most=50).select("client", "observed_at", "status")


def web_shape(s: SparkSession, d: str) -> DataFrame:
    e = enrich.client_identity(enrich.browser_times(web_events(s, d)))
    return e.select("event_id", "event_time_utc", "event_time_local", "client_hostname", "client_hostname_short", "client_user", "client_platform", "client_browser", *listed("client_ips"))


def web_enriched(s: SparkSession, d: str) -> DataFrame:
    e = enrich_browser(web_events(s, d), reference(s, d), cut=written)
    return e.select("event_id", "host", "registrable_domain", *listed("searches", "contexts", "risk"))


def payloads(s: SparkSession, d: str) -> DataFrame:
    """Both feeds as JSON text, some of it broken, incomplete or of odd types (by ``k``)."""
    # a row of a few bytes becomes a text of hundreds, so few files would be few tasks
    e = spread(dns_events(s, d)).withColumn("k", F.col("event_id") % 40)
    some = lambda cond, x: F.when(cond, x)  # noqa: E731  a null field is left out
    answers = F.transform("cnames", lambda c: F.struct(F.lit("CNAME").alias("type"), c.alias("data")))
    ips = F.concat("resolved_ip", F.when(F.col("k") == 6, F.array(F.lit("2606:0:0:0:0:0:0:1"), F.lit("2606::1"), F.lit("x"))).otherwise(F.array().cast("array<string>")))
    a = F.to_json(F.struct(
        F.concat(F.lit("d"), "event_id").alias("id"), F.when(F.col("k") == 2, "icmp").otherwise("dns").alias("type"), F.col("timestamp").alias("@timestamp"), some(F.col("k") != 4, F.col("status")).alias("status"),
        "resource", F.struct("direction").alias("network"), some(F.col("k") != 3, F.struct(F.col("client_ip").alias("ip"))).alias("client"), F.struct(F.col("destination_ip").alias("ip")).alias("destination"),
        F.struct(F.struct(F.col("resource").alias("name"), "etld_plus_one").alias("question"), answers.alias("answers"), F.array_compact(ips).alias("resolved_ip"), "response_code").alias("dns"),
    ))
    a = F.when(F.col("k") == 1, F.substring(a, 1, 40)).when(F.col("k") == 8, "[]").when(F.col("k") == 5, F.regexp_replace(a, '"resource":"[^"]*"', '"resource":42')).otherwise(a)
    a = F.when(F.col("k") == 6, F.regexp_replace(a, '"answers":\\[', '"answers":[null,7,{"type":"A","data":"a.com"},{"type":"CNAME"},').cast("string")).otherwise(a)
    a = F.regexp_replace(a, ',\\],"resolved', '],"resolved')
    w = spread(web_events(s, d)).withColumn("k", F.expr("event_id div 3") % 40)
    entry = F.struct(F.when(F.col("k") == 4, "FILE:///x").when(F.col("k") != 9, F.col("url")).alias("url"), F.struct(F.col("scheme").alias("Scheme"), some(F.col("k") != 5, F.col("host")).alias("Host")).alias("url_data"))
    ips = F.when(F.col("k") == 11, F.array(F.lit("fe80::1"), F.lit("fc00:0:0:0:0:0:0:1"), F.lit("FC00::1"))).otherwise(F.col("ip_addresses"))
    person = F.struct(F.struct("hostname", F.col("hostname_short").alias("short")).alias("Hostname"), "user", "platform", "browser", ips.alias("ip_addresses"))
    stamp = F.when(F.col("k") == 6, "1601-01-01T00:00:00Z").when(F.col("k") != 10, F.col("timestamp"))
    data = F.struct(stamp.alias("@timestamp"), F.col("processed_at").alias("@processed"), F.struct(some(F.col("k") != 2, F.struct(person.alias("client"), some(F.col("k") != 3, entry).alias("entry"))).alias("data")).alias("event"))
    b = F.to_json(F.struct(F.concat(F.lit("w"), "event_id").alias("id"), "type", data.alias("data")))
    b = F.when(F.col("k") == 1, F.substring(b, 1, 50)).when(F.col("k") == 7, F.regexp_replace(b, '"user":"[^"]*"', '"user":42')).otherwise(b)
    rows = e.select(F.concat(F.lit("d"), "event_id").alias("event_id"), a.alias("value")).unionByName(w.select(F.concat(F.lit("w"), "event_id").alias("event_id"), b.alias("value")))
    return written(rows)


def payload_verdicts(s: SparkSession, d: str) -> DataFrame:
    return consumer.verdicts(parse(payloads(s, d)), reference(s, d))


def bites(s: SparkSession, d: str) -> DataFrame:
    """Every document, from JSON text, with all its fields."""
    docs = consumer.process(payloads(s, d), reference(s, d, built_at=1_700_000_000), cut=written)
    lists_ = ["searches", "contexts", "sources", "matched_on", "cname_chain", "cname_contexts", "cname_matched_on", "match_source", "resolved_ips", "purpose", "service", "risk", "unmapped_contexts", "client_ips", "client_hosts", "requested"]
    plain = ["type", "request", "response_code", "registrable_domain", "psl_fallback", "index_built_at", "risk_severity", "client", "ptr", "ptr_status", "event_time_utc", "event_time_local", "url",
             "client_hostname", "client_hostname_short", "client_user", "client_platform", "client_browser"]
    return docs.select(F.get_json_object("packet", "$.id").alias("id"), F.col("`@timestamp`").alias("time"), F.col("`@metadata`.beat").alias("beat"), F.col("processed").isNotNull().alias("stamped"), *plain, *listed(*lists_))


def syslog(s: SparkSession, d: str) -> DataFrame:
    return sinks.syslog_lines(dns_events(s, d).select("event_id", "status", "resource"))


def ingest_days(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet").select(sinks.index_name(F.col("ts"), "bites", "America/New_York").alias("index_name"))
    return e.groupBy("index_name").agg(F.count("*").alias("events"))


def identity_table(s: SparkSession, d: str) -> DataFrame:
    web = enrich.client_identity(web_events(s, d))
    e = named_clients(s, d)
    return reports.client_identity_table(web, e, within_seconds=3600, cut=written)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "clean_list_lines": lambda s, d: ent.clean_lines(view(s, d, "v_list_lines")),
    "clean_known_tlds": clean_known,
    "merge_entries": lambda s, d: merged(s, d).select("domain", *listed("categories", "sources")),
    "ignorelist_entries": lambda s, d: entries_of(s, d).select("domain", "reversed", *listed("categories", "sources")),
    "ignorelist_counts": lambda s, d: ent.ignorelist_counts(merged(s, d), view(s, d, "v_ignorelist")),
    "attribute_combinations": combos,
    "attribute_encoding": encoded,
    "build_statistics": build_stats,
    "keep_previous": kept_previous,
    "exact_population": lambda s, d: population(s, d).select("domain", *listed("categories")),
    "exact_ignorelist": lambda s, d: ent.exact_ignorelist(population(s, d), view(s, d, "v_ignorelist")).select("domain", *listed("categories")),
    "list_usability": lambda s, d: ent.usable(merged(s, d), "domain", ["*.example.com"], 5),
    "generation_rows": generation_sum,
    "bucketed_lookup": lambda s, d: lookup.ancestor_lookup(view(s, d, "v_hosts"), bucketed(s, d)).select("host", *listed("contexts", "sources", "matched_on")),
    "entries_below": entries_below,
    "incremental_build": built_by_steps,
    "list_files": from_files,
    "normal_forms": normal_forms,
    "ip_addresses": addresses,
    "dns_shape": dns_shape,
    "dns_sieve": dns_sieved,
    "browser_sieve": web_sieved,
    "verdict_counts": verdicts,
    "audit_lines": audit,
    "public_suffix": suffixes,
    "guessed_domains": guessed,
    "suffix_rules": rules_of_lines,
    "curated_categories": lambda s, d: ent.with_categories(ent.clean_lines(view(s, d, "v_list_lines")), small(s, "configured")).select("domain", "category", "source", "folder"),
    "exact_mode": exactly,
    "missing_index": without_index,
    "payload_verdicts": payload_verdicts,
    "ancestor_lookup": looked_up,
    "exact_lookup": looked_up_exactly,
    "enriched_dns": enriched,
    "compare_modes": compared,
    "taxonomy_facets": faceted,
    "ptr_as_of": asof,
    "ptr_stream": asof_stream,
    "ptr_bounded": remembered,
    "browser_shape": web_shape,
    "enriched_browser": web_enriched,
    "documents": bites,
    "stream_documents": stream_documents,
    "stream_counts": stream_counts,
    "nothing_to_look_up": nameless,
    "syslog_lines": syslog,
    "daily_index": ingest_days,
    "daily_rows": daily_rows,
    "distinct_clients": clients_by_day,
    "identity_table": identity_table,
    "top_domains": lambda s, d: reports.top_domains(dns(s, d), k=20),
    "category_share": lambda s, d: reports.category_share(dns(s, d)),
    "facet_share": lambda s, d: reports.facet_share(dns(s, d)),
    "branch_rollup": lambda s, d: reports.branch_rollup(dns(s, d), "risk"),
    "event_histogram": lambda s, d: reports.histogram(s.read.parquet(f"{d}/events.parquet")).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "events"),
    "ptr_health": lambda s, d: reports.ptr_health(named_clients(s, d), width="1 day").select(F.date_format("start", "yyyy-MM-dd").alias("start"), "ptr_status", "events"),
    "risk_findings": lambda s, d: reports.findings(dns(s, d), severities(s), least="low"),
    "sinkholed": lambda s, d: reports.sinkholed(enrich.dns_answers(dns_events(s, d))).select("event_id"),
    "cname_cloaking": lambda s, d: reports.cloaked(dns(s, d)),
    "unmapped_categories": lambda s, d: reports.unmapped(dns(s, d)),
    "mode_agreement": lambda s, d: reports.agreement(dns(s, d, "compare")),
    "domain_changes": lambda s, d: reports.domain_changes(registrable_domains(view(s, d, "v_hosts"), small(s, "rules"))),
    "first_per_client": lambda s, d: reports.first_by(dns_events(s, d), ["client_ip"], "event_id").select("client_ip", "event_id"),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DNS events with all that is known of their hosts."""
    return enriched(spark, sf_dir)


# --- the same in SQL -------------------------------------------------------------------


def _values(rows: list[tuple]) -> str:
    say = lambda x: "[" + ", ".join(map(say, x)) + "]::varchar[]" if isinstance(x, list) else str(x) if isinstance(x, int) else f"'{x}'"
    return "values " + ", ".join("(" + ", ".join(map(say, r)) + ")" for r in rows)


HOST = r"(\*\.)?([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)*[a-z0-9]([a-z0-9-]*[a-z0-9])?"
_UP = lambda h: f"list_transform(range(1, len(string_split({h}, '.')) + 1), lambda i: array_to_string(string_split({h}, '.')[i:], '.'))"
_NORM = lambda x: f"nullif(trim(lower(trim({x}, chr(9) || ' ')), '.'), '')"
_JOIN = lambda x: f"array_to_string({x}, '|')"

SQL = f"""with {ADAPTER.format(pages="pages", events="events")},
configured(source, categories) as ({_values(CONFIGURED)}), rules(kind, rule) as ({_values(RULES)}), ignores(scope, kind, raw) as ({_values(IGNORE)}),
ign as (select scope, kind, case when kind in ('domain', 'host') then {_NORM("raw")} else raw end as value from ignores),
tax(category, facet, path) as ({_values(taxonomy_rows())}), sev(path, severity, rnk) as ({_values(severity_rows())}),
c1 as (select source, folder, lower(trim(line)) as x from v_list_lines),
c2 as (select source, folder, regexp_replace(regexp_replace(regexp_replace(x, '\\s+[#!].*$', ''), '^([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}\\s+', ''), '^[0-9a-f]*:[0-9a-f:.]*\\s+', '') as y
  from c1 where x <> '' and not regexp_matches(x, '^([#!\\[]|@@)')),
c3 as (select source, folder, trim(string_split_regex(trim(split_part(regexp_replace(y, '^\\|\\|?', ''), '^', 1)), '\\s+')[1], '.') as host from c2),
clean as (select distinct source, folder, host from c3 where contains(host, '.') and regexp_full_match(host, '{HOST}')),
cats as (select c.host as domain, c.source, unnest(case when len(g.categories) > 0 then g.categories else [c.folder] end) as category from clean c left join configured g using (source)),
merged as (select domain, list_sort(list(distinct category)) as categories, list_sort(list(distinct source)) as sources from cats group by domain),
igd as (select lower(host) as domain, list(distinct context) as ctx from v_ignorelist group by 1),
fixed as (select domain, categories as was, sources, case when ctx is null then categories else list_filter(categories, lambda c: not list_contains(ctx, c)) end as categories
  from merged left join igd using (domain)),
entries as (select domain, categories, sources from fixed where len(categories) > 0),
hostset as (select distinct resource as host from v_dns union select distinct cname from v_dns where cname is not null union select distinct host from v_hosts),
up as (select host, unnest({_UP("host")}) as c, unnest(range(1, len(string_split(host, '.')) + 1)) as i from hostset),
probe as (select host, c as domain, 2 * i as pos from up union all select host, '*.' || c, 2 * i + 1 from up),
hits as (select p.host, p.pos, e.* from probe p join entries e using (domain)),
found as (select host, list_sort(list_distinct(flatten(list(categories)))) as contexts, list_sort(list_distinct(flatten(list(sources)))) as sources, list(domain order by pos) as matched_on from hits group by host),
suffix_hosts as (select distinct host from v_hosts union select distinct resource from v_dns union values ('com'), ('example.org'), ('x.example.org'), ('localhost')),
sh as (select host, unnest({_UP("host")}) as c, unnest(range(0, len(string_split(host, '.')))) as i, len(string_split(host, '.')) as n from suffix_hosts),
sr as (select host, max(n) as n, min(i) filter (kind = 'exception') as ex, min(i) filter (kind = 'exact') as ok, min(i - 1) filter (kind = 'wildcard' and i > 0) as wild from sh left join rules on rule = c group by host),
ss as (select host, n, coalesce(ex + 1, least(ok, wild), n - 1) as cut from sr),
suffixes as (select host, array_to_string(string_split(host, '.')[cut + 1:], '.') as public_suffix, case when cut > 0 then array_to_string(string_split(host, '.')[cut:], '.') end as registrable_domain from ss),
dns_why as (select d.*, {_UP("resource")} as ups, regexp_extract(resource, '([^.]+[.][^.]+)$', 1) as e1 from v_dns d),
has as (select scope, kind, list(value) as vs from ign group by all),
g as (select max(vs) filter (scope = 'dns' and kind = 'client') as dc, max(vs) filter (scope = 'dns' and kind = 'domain') as dd, max(vs) filter (scope = 'dns' and kind = 'host') as dh,
  max(vs) filter (scope = 'browser' and kind = 'client') as bc, max(vs) filter (scope = 'browser' and kind = 'user') as bu, max(vs) filter (scope = 'browser' and kind = 'domain') as bd,
  max(vs) filter (scope = 'browser' and kind = 'host') as bh from has),
dns_drop as (select w.*, case when status <> 'OK' then 'status' when list_contains(dc, client_ip) then 'client' when direction in ('outbound', 'egress') then 'reply'
  when list_contains(dd, e1) then 'domain' when list_contains(dh, resource) then 'host' when list_has_any(ups, dd) then 'domain' end as drop_reason from dns_why w, g),
web_drop as (select w.*, case when list_contains(bc, 'host-' || user_id) or list_contains(bc, address) then 'client' when list_contains(bu, 'u' || user_id) then 'user'
  when list_contains(bh, host) then 'host' when list_has_any({_UP("host")}, bd) then 'domain' end as drop_reason from v_web w, g),
kept as (select *, case when direction in ('inbound', 'ingress') then 'query' else 'reply' end as request from dns_drop where drop_reason is null),
judged as (select k.*, coalesce(f.contexts, []) as q, coalesce(c.contexts, []) as ch, f.sources as s1, c.sources as s2, coalesce(f.matched_on, []) as matched_on, c.matched_on as m2, x.registrable_domain,
    list_sort(list_distinct(list_concat(coalesce(f.contexts, []), coalesce(c.contexts, [])))) as contexts
  from kept k left join found f on f.host = k.resource left join found c on c.host = k.cname left join suffixes x on x.host = k.resource),
ev as (select *, list_concat(case when len(q) > 0 then ['question'] else [] end, case when len(ch) > 0 then ['cname'] else [] end) as match_source from judged),
evc as (select event_id, unnest(contexts) as category from ev),
evf as (select distinct event_id, facet, path from evc join tax using (category)),
fac as (select event_id, list_sort(list(distinct path) filter (facet = 'purpose')) as purpose, list_sort(list(distinct path) filter (facet = 'service')) as service,
  list_sort(list(distinct path) filter (facet = 'risk')) as risk, max(rnk) as rnk from evf left join sev using (path) group by event_id),
unm as (select event_id, list_sort(list(category)) as unmapped from evc anti join tax using (category) group by event_id),
terms as (select event_id, resource, unnest([resource, e1, '*.' || e1, '*.' || regexp_extract(e1, '[^.]+$')]) as domain from dns_why),
exact as (select event_id, list_sort(list_distinct(flatten(list(categories)))) as contexts from terms join entries using (domain) group by event_id),
obs as (select client, ts, arg_max(status, event_id) as status, arg_max(user_id, event_id) as user_id from v_seen group by client, ts),
uobs as (select * from obs where status <> 'Timeout'),
asked as (select *, case when event_id % 31 = 0 then 'bad host' else client_ip end as client from v_dns),
ptrs as (select d.event_id, d.ts, d.client, o.ts as seen, o.status, o.user_id as u from asked d asof left join uobs o on o.client = d.client and o.ts <= d.ts),
payload_dns as (select *, event_id % 40 as k from dns_drop),
payload_web as (select w.*, case when k = 6 then 'time' when k = 2 then 'data' when list_contains(bc, 'host-' || user_id) or (list_contains(bc, address) and k <> 11) then 'client' when list_contains(bu, 'u' || user_id) and k <> 7 then 'user'
  when k = 3 then 'entry' when k = 4 then 'file' when k = 5 then 'no_host' when list_contains(bh, host) then 'host' when list_has_any({_UP("host")}, bd) then 'domain' end as why from (select *, cast(floor(event_id / 3) as bigint) % 40 as k from v_web) w, g),
hcat as (select host, unnest(contexts) as category from found), hpath as (select distinct host, facet, path from hcat join tax using (category)),
hunm as (select host, list_sort(list(category)) as unmapped from hcat anti join tax using (category) group by host),
hfac0 as (select host, list_sort(list(distinct path) filter (facet = 'purpose')) as purpose, list_sort(list(distinct path) filter (facet = 'service')) as service, list_sort(list(distinct path) filter (facet = 'risk')) as risk, max(rnk) as rnk
  from hpath left join sev using (path) group by host),
hfac as (select * from hfac0 full join hunm using (host)),
named as (select event_id, ts, client, case when client = 'bad host' then 'bad_client_address' when d.seen + interval 900 second > d.ts then status else 'not_observed' end as ptr_status, case when d.seen + interval 900 second > d.ts then u end as u from ptrs d)
"""
_NY = "strftime(timezone('America/New_York', ts::timestamp at time zone 'UTC'), '%Y-%m-%d')"
_N = lambda x: f"nullif({x}, '')"

ORACLE_SQL: dict[str, str] = {k: SQL + v for k, v in {
    "clean_list_lines": "select source, folder, host from clean",
    "clean_known_tlds": "select source, folder, host from clean where regexp_extract(host, '[^.]+$') in ('com', 'org')",
    "merge_entries": f"select domain, {_JOIN('categories')} as categories, {_JOIN('sources')} as sources from merged",
    "ignorelist_entries": f"select domain, array_to_string(list_reverse(string_split(domain, '.')), '.') as reversed, {_JOIN('categories')} as categories, {_JOIN('sources')} as sources from entries",
    "ignorelist_counts": "select cast(coalesce(sum(len(was) - len(categories)), 0) as bigint) as removed, count(*) filter (len(categories) = 0) as dropped from fixed",
    "attribute_combinations": f"select row_number() over (order by n desc, c, s) - 1 as attr_id, c as categories, s as sources, n as domains from (select {_JOIN('categories')} as c, {_JOIN('sources')} as s, count(*) as n from merged group by 1, 2)",
    "attribute_encoding": f"select domain, attr_id from (select {_JOIN('categories')} as c, {_JOIN('sources')} as s, domain from merged) join (select row_number() over (order by n desc, c, s) - 1 as attr_id, c, s from (select {_JOIN('categories')} as c, {_JOIN('sources')} as s, count(*) as n from merged group by 1, 2)) using (c, s)",
    "build_statistics": f"""select count(distinct host) filter (ok) as domains, count(distinct (source, folder)) filter (ok) as files, count(distinct category) filter (ok) as categories, count(distinct page_id) filter (not ok) as skipped
        from (select page_id, l.source, l.folder, lower(trim(line)) as host, contains(line, '.') and regexp_full_match(lower(trim(line)), '{HOST}') as ok,
          unnest(case when len(g.categories) > 0 then g.categories else [l.folder] end) as category from v_list_lines l left join configured g using (source))""",
    "keep_previous": "select source, folder, case when source = 'list2' and folder <> 'news' then 'old.' else '' end || host as host from clean",
    "exact_population": f"select trim(line) as domain, {_JOIN('list_sort(list(distinct folder))')} as categories from v_list_lines group by 1",
    "exact_ignorelist": f"""select domain, {_JOIN('case when ctx is null then categories else list_filter(categories, lambda c: not list_contains(ctx, c)) end')} as categories
        from (select trim(line) as domain, list_sort(list(distinct folder)) as categories from v_list_lines group by 1) left join (select host as domain, list(distinct context) as ctx from v_ignorelist group by 1) using (domain)""",
    "list_usability": "select count(*) as rows, count(*) > 5 and bool_or(domain = '*.example.com') as usable from merged",
    "generation_rows": f"select count(*) as rows, bit_xor(('0x' || md5(domain || chr(9) || {_JOIN('categories')} || chr(9) || {_JOIN('sources')})[1:15])::bigint) as checksum, 2 as generations, '3,5' as stored from entries",
    "bucketed_lookup": f"select host, {_JOIN('contexts')} as contexts, {_JOIN('sources')} as sources, {_JOIN('matched_on')} as matched_on from found semi join v_hosts using (host)",
    "entries_below": f"select below, domain, {_JOIN('categories')} as categories from entries, (values ('com'), ('example.org'), ('spam-farm.example.net')) b(below) where domain = below or ends_with(domain, '.' || below)",
    "incremental_build": f"select domain, array_to_string(list_reverse(string_split(domain, '.')), '.') as reversed, {_JOIN('categories')} as categories, {_JOIN('sources')} as sources from entries",
    "list_files": f"""select domain, {_JOIN('categories')} as categories, {_JOIN('sources')} as sources
        from (select domain, sources, case when ctx is null then categories else list_filter(categories, lambda c: not list_contains(ctx, c)) end as categories
          from (select c.host as domain, list_sort(list(distinct c.source)) as sources, list_sort(list_distinct(flatten(list(case when len(g.categories) > 0 then g.categories else [c.folder] end)))) as categories
            from clean c left join configured g using (source) where regexp_extract(c.host, '[^.]+$') in ('com', 'org') and not (c.folder = 'news' and c.source = 'list0') group by c.host)
          left join igd using (domain)) where len(categories) > 0""",
    "normal_forms": f"""select page_id, host as normal, host as bare, split_part(host, '.', 1) as short, array_to_string(list_reverse(string_split(host, '.')), '.') as reversed,
        regexp_extract(host, '([^.]+[.][^.]+)$', 1) as naive, regexp_extract(host, '[^.]+$') as tld,
        array_to_string(flatten(list_transform({_UP("host")}, lambda c: [c, '*.' || c])), '|') as probes from v_hosts""",
    "ip_addresses": """, x as (select distinct printf('%x', user_id % 4096 + 1) as x from v_dns)
        select distinct client_ip, client_ip as canonical, 'private' as class, array_to_string(list_reverse(string_split(client_ip, '.')), '.') || '.in-addr.arpa.' as reverse from v_dns
        union all select '2606:4700:0:0:0:0:0:' || upper(x), '2606:4700::' || x, 'global', array_to_string(list_reverse(string_split('2606470000000000000000000000' || lpad(x, 4, '0'), '')), '.') || '.ip6.arpa.' from x
        union all select 'fe80:0:0:0:0:0:0:' || upper(x), 'fe80::' || x, 'link_local', array_to_string(list_reverse(string_split('fe800000000000000000000000000' || lpad(x, 3, '0'), '')), '.') || '.ip6.arpa.' from x
        union all select 'no address ' || upper(x), null, null, '' from x""",
    "dns_shape": f"""select event_id, array_to_string([resource, e1, '*.' || e1, '*.' || regexp_extract(e1, '[^.]+$')], '|') as searches, coalesce(cname, '') as chain,
        client_ip || case when event_id % 50 = 0 then '|0.0.0.0' else '' end as resolved_ips, case when direction in ('inbound', 'ingress') then 'query' else 'reply' end as request,
        client_ip as client, upper(response_code) as response_code from dns_why""",
    "dns_sieve": "select event_id, drop_reason from dns_drop",
    "browser_sieve": "select event_id, drop_reason from web_drop",
    "verdict_counts": "select case when event_id % 13 = 0 then 'unreadable' when drop_reason is not null then 'dropped' else 'kept' end as verdict, count(*) as events from dns_drop group by 1",
    "audit_lines": """select event_id, '[DNS] ' || case when drop_reason is null then 'kept' else 'dropped' end || ': ' || resource || ' - ' || direction as line from dns_drop
        union all select event_id, '[History] ' || case when drop_reason is null then 'kept' else 'dropped' end || ' : ' || url || ' - u' || user_id || ' - host-' || user_id from web_drop""",
    "public_suffix": "select host, public_suffix, registrable_domain from suffixes where host not like '%.uncategorised.info'",
    "guessed_domains": "select distinct host, regexp_extract(host, '([^.]+[.][^.]+)$', 1) as registrable_domain, true as psl_fallback from v_hosts",
    "suffix_rules": """select distinct kind, unnest(case when kind = 'exact' and k = 3 then ['m\u00fcnchen.' || host, 'xn--mnchen-3ya.' || host] else [host] end) as rule
        from (select host, page_id % 5 as k, case page_id % 5 when 1 then 'wildcard' when 2 then 'exception' else 'exact' end as kind from v_hosts where page_id % 5 <> 0)""",
    "curated_categories": "select domain, category, source, folder from (select c.host as domain, c.source, c.folder, unnest(case when len(g.categories) > 0 then g.categories else [c.folder] end) as category from clean c left join configured g using (source))",
    "exact_mode": f"""select e.event_id, coalesce({_JOIN('x.contexts')}, '') as contexts, case when len(x.contexts) > 0 then 'question' end as match_source, null::varchar as index_error from ev e left join exact x using (event_id)""",
    "missing_index": f"""select e.event_id, coalesce({_JOIN('x.contexts')}, '') as contexts, 'no index' as index_error from ev e left join exact x using (event_id)""",
    "payload_verdicts": f"""
        select 'd' || event_id as event_id, case when k in (1) then 'unreadable' when k in (2, 8) then 'dropped' when why is not null then 'dropped' when k = 3 and direction in ('inbound', 'ingress') then 'unreadable' else 'kept' end as verdict,
          case when k in (1, 2, 8) then 'type' else why end as drop_reason,
          case when k not in (1, 2, 5, 8) then '[DNS] ' || case when why is not null then 'dropped' when k = 3 and direction in ('inbound', 'ingress') then 'unreadable' else 'kept' end || ': ' || resource || ' - ' || direction end as line
        from (select *, case when k = 4 then 'status' else drop_reason end as why from payload_dns)
        union all select 'w' || event_id, case when k = 1 then 'unreadable' when why is not null then 'dropped' when k in (9, 10) then 'unreadable' else 'kept' end, case when k = 1 then 'type' else why end,
          case when k <> 1 then '[History] ' || case when why is not null then 'dropped' when k in (9, 10) then 'unreadable' else 'kept' end
            || case when k in (2, 3, 9) then '' when k = 4 then ' : FILE:///x' else ' : ' || url end || case when k in (2, 7) then '' else ' - u' || user_id end || case when k = 2 then '' else ' - host-' || user_id end end
        from payload_web""",
    "ancestor_lookup": f"select host, {_JOIN('contexts')} as contexts, {_JOIN('sources')} as sources, {_JOIN('matched_on')} as matched_on from found semi join v_hosts using (host)",
    "exact_lookup": f"select d.event_id, coalesce({_JOIN('contexts')}, '') as contexts from v_dns d left join exact using (event_id)",
    "enriched_dns": f"""select e.event_id, resource as host, registrable_domain, case rnk when 3 then 'high' when 2 then 'medium' when 1 then 'low' end as risk_severity,
        {_JOIN('contexts')} as contexts, {_JOIN('list_sort(list_distinct(list_concat(coalesce(s1, []), coalesce(s2, []))))')} as sources, {_JOIN('matched_on')} as matched_on,
        {_N(_JOIN('match_source'))} as match_source, {_N(_JOIN('ch'))} as cname_contexts, {_JOIN('purpose')} as purpose, {_JOIN('service')} as service, {_JOIN('risk')} as risk, {_JOIN('unmapped')} as unmapped_contexts
        from ev e left join fac using (event_id) left join unm using (event_id)""",
    "compare_modes": f"""select e.event_id, coalesce({_JOIN('x.contexts')}, '') as contexts, {_JOIN('q')} as contexts_index, {_N(_JOIN('ch'))} as cname_contexts,
        case when len(x.contexts) > 0 then 'question' end as match_source, coalesce(x.contexts, []) = q as context_match from ev e left join exact x using (event_id)""",
    "taxonomy_facets": f"""select event_id, {_JOIN("list_sort(list(distinct path) filter (facet = 'purpose'))")} as purpose, {_JOIN("list_sort(list(distinct path) filter (facet = 'service'))")} as service,
        {_JOIN("list_sort(list(distinct path) filter (facet = 'risk'))")} as risk, case when event_id % 9 = 0 then 'nosuch' end as unmapped_contexts,
        case max(rnk) when 3 then 'high' when 2 then 'medium' when 1 then 'low' end as risk_severity
        from (select event_id, unnest([names[(event_id + 1) % len(names) + 1], names[(event_id * 7 + 7) % len(names) + 1], case when event_id % 9 = 0 then 'nosuch' else 'ai' end]) as category
          from events, (select list_sort(list(distinct category)) as names from tax)) left join tax using (category) left join sev using (path) group by event_id""",
    "ptr_as_of": """select event_id, case when client = 'bad host' then '' else array_to_string(list_reverse(string_split(client, '.')), '.') || '.in-addr.arpa.' end as ptr, ptr_status,
        case when ptr_status = 'ok' then p || u || '.office.lan' else '' end as client_hosts, case when ptr_status = 'ok' then p || u else '' end as client_hosts_short from (select *, case when u % 2 = 0 then 'host-' else 'pc-' end as p from named)""",
    "ptr_stream": """select event_id, case when client = 'bad host' then '' else array_to_string(list_reverse(string_split(client, '.')), '.') || '.in-addr.arpa.' end as ptr, ptr_status,
        case when ptr_status = 'ok' then p || u || '.office.lan' else '' end as client_hosts, case when ptr_status = 'ok' then p || u else '' end as client_hosts_short from (select *, case when u % 2 = 0 then 'host-' else 'pc-' end as p from named)""",
    "ptr_bounded": "select client, ts as observed_at, status from (select *, row_number() over (partition by client order by ts desc) as k from uobs) where k = 1 order by ts desc, client limit 50",
    "browser_shape": """select event_id, case when browser = 'safari' then strftime(ts - off, '%Y-%m-%dT%H:%M:%SZ') else strftime(ts, '%Y-%m-%dT%H:%M:%SZ') end as event_time_utc,
        case when browser = 'safari' then strftime(ts, '%Y-%m-%dT%H:%M:%S') || z when browser in ('chrome', 'firefox') then strftime(ts + off, '%Y-%m-%dT%H:%M:%S') || z else strftime(ts, '%Y-%m-%dT%H:%M:%SZ') end as event_time_local,
        'host-' || user_id || '.lan' as client_hostname, 'host-' || user_id as client_hostname_short, 'u' || user_id as client_user, null::varchar as client_platform, browser as client_browser, address as client_ips
        from (select *, case when zone = '-0400' then interval (-240) minute else interval 330 minute end as off, case when zone = '-0400' then '-04:00' else '+05:30' end as z from v_web)""",
    "enriched_browser": f"""select event_id, host, registrable_domain, host || '|*.' || host || '|*.' || regexp_extract(host, '[^.]+$') ||
        case when registrable_domain <> host then '|' || registrable_domain || '|*.' || registrable_domain else '' end as searches, coalesce({_JOIN('f.contexts')}, '') as contexts, {_JOIN('risk')} as risk
        from web_drop w left join suffixes using (host) left join found f using (host)
        left join (select host, list_sort(list(distinct path)) as risk from (select host, unnest(contexts) as category from found) join tax using (category) where facet = 'risk' group by host) using (host) where drop_reason is null""",
    "documents": f"""select 'd' || e.event_id as id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as time, 'hostlens' as beat, true as stamped, 'dns' as type, request, upper(response_code) as response_code, registrable_domain, null::boolean as psl_fallback,
        1700000000 as index_built_at, case rnk when 3 then 'high' when 2 then 'medium' when 1 then 'low' end as risk_severity, client_ip as client, null::varchar as ptr, 'skipped' as ptr_status, null::varchar as event_time_utc,
        null::varchar as event_time_local, null::varchar as url, null::varchar as client_hostname, null::varchar as client_hostname_short, null::varchar as client_user, null::varchar as client_platform, null::varchar as client_browser,
        array_to_string([resource, e1, '*.' || e1, '*.' || regexp_extract(e1, '[^.]+$')], '|') as searches, {_JOIN('contexts')} as contexts, {_JOIN('list_sort(list_distinct(list_concat(coalesce(s1, []), coalesce(s2, []))))')} as sources,
        {_JOIN('matched_on')} as matched_on, cname as cname_chain, {_N(_JOIN('ch'))} as cname_contexts, {_N(_JOIN('m2'))} as cname_matched_on, {_N(_JOIN('match_source'))} as match_source,
        client_ip || case when event_id % 50 = 0 then '|0.0.0.0' else '' end || case when k = 6 then '|2606::1' else '' end as resolved_ips, {_JOIN('purpose')} as purpose, {_JOIN('service')} as service, {_JOIN('risk')} as risk,
        {_JOIN('unmapped')} as unmapped_contexts, null::varchar as client_ips, '' as client_hosts, resource as requested
        from (select *, event_id % 40 as k from ev) e left join fac using (event_id) left join unm using (event_id) where k not in (1, 2, 3, 4, 8)
        union all select 'w' || event_id, utc, 'hostlens', true, 'browser.history', scheme, null, registrable_domain, null, 1700000000, case rnk when 3 then 'high' when 2 then 'medium' when 1 then 'low' end, null, null, null, utc, local, url,
        'host-' || user_id || '.lan', 'host-' || user_id, case when k <> 7 then 'u' || user_id end, null, browser,
        host || '|*.' || host || '|*.' || regexp_extract(host, '[^.]+$') || case when registrable_domain <> host then '|' || registrable_domain || '|*.' || registrable_domain else '' end,
        coalesce({_JOIN('f.contexts')}, ''), coalesce({_JOIN('f.sources')}, ''), coalesce({_JOIN('f.matched_on')}, ''), null, null, null, case when len(f.contexts) > 0 then 'question' end, null, {_JOIN('purpose')}, {_JOIN('service')}, {_JOIN('risk')},
        {_JOIN('unmapped')}, case when k = 11 then 'fc00::1' else address end, null, host
        from (select *, case when browser = 'safari' then strftime(ts - off, '%Y-%m-%dT%H:%M:%SZ') else strftime(ts, '%Y-%m-%dT%H:%M:%SZ') end as utc,
            case when browser = 'safari' then strftime(ts, '%Y-%m-%dT%H:%M:%S') || z when browser in ('chrome', 'firefox') then strftime(ts + off, '%Y-%m-%dT%H:%M:%S') || z else strftime(ts, '%Y-%m-%dT%H:%M:%SZ') end as local
          from (select *, case when zone = '-0400' then interval (-240) minute else interval 330 minute end as off, case when zone = '-0400' then '-04:00' else '+05:30' end as z from payload_web)) w
        left join suffixes using (host) left join found f using (host) left join hfac using (host) where why is null and k not in (1, 9, 10)""",
    "stream_documents": f"""select 'd' || e.event_id as id, 'dns' as type, {_JOIN('contexts')} as contexts, {_JOIN('risk')} as risk, case when e.event_id % 3 = 2 then 3 else 1 end as index_built_at
        from (select *, event_id % 40 as k from ev) e left join fac using (event_id) where k not in (1, 2, 3, 4, 8)
        union all select 'w' || event_id, 'browser.history', coalesce({_JOIN('f.contexts')}, ''), {_JOIN('risk')}, 1
        from payload_web w left join found f using (host) left join hfac using (host) where why is null and k not in (1, 9, 10)""",
    "stream_counts": """select verdict, count(*) as events from (
        select case when k = 1 then 'unreadable' when k in (2, 8) or k = 4 or drop_reason is not null then 'dropped' when k = 3 and direction in ('inbound', 'ingress') then 'unreadable' else 'kept' end as verdict from payload_dns
        union all select case when k = 1 then 'unreadable' when why is not null then 'dropped' when k in (9, 10) then 'unreadable' else 'kept' end from payload_web) group by 1""",
    "nothing_to_look_up": "select event_id, 4 as terms from kept where event_id % 10 <> 0",
    "syslog_lines": """select '<30>{"event_id":' || event_id || ',"status":"' || status || '","resource":"' || resource || '"}' as value from v_dns""",
    "daily_index": f"select 'bites-' || {_NY} as index_name, count(*) as events from events group by 1",
    "daily_rows": f"select 'bites-' || {_NY} as index_name, event_id, user_id from events",
    "distinct_clients": "select registrable_domain, count(*) as events, count(distinct client_ip) as clients, true as sketch_is_near from ev where registrable_domain is not null group by 1",
    "identity_table": """, near as (select d.event_id, d.client, w.user_id as u, abs(epoch(date_trunc('second', d.ts)) - epoch(date_trunc('second', w.ts))) as gap from asked d join v_web w on w.address = d.client
          and abs(epoch(date_trunc('second', d.ts)) - epoch(date_trunc('second', w.ts))) <= 3600)
        select event_id, client, 'u' || list(u order by gap, 'u' || u)[1] as client_user, 'address' as by, count(distinct u) as candidates from near group by all
        union all select event_id, client, 'u' || u, 'name', 1 from named anti join near using (event_id) where ptr_status = 'ok' and u % 2 = 0 and u in (select user_id from v_web)""",
    "top_domains": "select registrable_domain, count(*) as events, count(distinct client_ip) as clients from ev where registrable_domain is not null group by 1 order by 2 desc, 1 limit 20",
    "category_share": "select category, count(*) as events, round(count(*) / (select count(*) from ev), 6) as share from evc group by 1",
    "facet_share": "select facet, path, count(*) as events, round(count(*) / (select count(*) from ev), 6) as share from evf group by 1, 2",
    "branch_rollup": "select branch, path, count(distinct event_id) as events from (select event_id, path, split_part(path, '.', 1) as branch from evf where facet = 'risk') group by rollup (branch, path)",
    "event_histogram": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as start, count(*) as events from events group by 1",
    "ptr_health": "select strftime(ts, '%Y-%m-%d') as start, ptr_status, count(*) as events from named group by 1, 2",
    "risk_findings": "select event_id, path, severity from evf join sev using (path) where facet = 'risk'",
    "sinkholed": "select event_id from v_dns where event_id % 50 = 0",
    "cname_cloaking": "select cname as target, count(distinct event_id) as events, count(distinct resource) as hosts from ev where match_source = ['cname'] group by 1",
    "unmapped_categories": "select unnest(unmapped) as category, count(*) as events from unm group by 1",
    "mode_agreement": """select count(*) as events, round(avg(cast(coalesce(x.contexts, []) = q as int)), 6) as agreement,
        count(*) filter (len(list_filter(ch, lambda c: not list_contains(coalesce(x.contexts, []), c))) > 0) as chain_adds from ev e left join exact x using (event_id)""",
    "domain_changes": """select case when r = n then 'same' when r is null then 'bare suffix' when n is null then 'single label' else 'changed' end as kind, count(*) as hosts
        from (select registrable_domain as r, nullif(regexp_extract(host, '([^.]+[.][^.]+)$', 1), '') as n from suffixes semi join v_hosts using (host)) group by 1""",
    "first_per_client": "select client_ip, min(event_id) as event_id from v_dns group by 1",
}.items()}
