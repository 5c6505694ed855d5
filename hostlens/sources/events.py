"""Event payloads: one JSON document a row, of unknown shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ("dns", "browser.history")

#: What both feeds may hold, as one shape: objects are structs, and a leaf stays a variant,
#: so that its own type can be asked for. A level of another type is null.
SHAPE = """struct<
  type: variant, `@timestamp`: variant, status: variant, resource: variant,
  network: struct<direction: variant>, client: struct<ip: variant>, destination: struct<ip: variant>,
  dns: struct<question: struct<name: variant, etld_plus_one: variant, registered_domain: variant>, answers: array<variant>, resolved_ip: array<variant>, response_code: variant>,
  data: struct<`@timestamp`: variant, `@processed`: variant, event: struct<data: struct<
    client: struct<Hostname: struct<hostname: variant, short: variant>, user: variant, platform: variant, browser: variant, ip_addresses: array<variant>>,
    entry: struct<url: variant, url_data: struct<Scheme: variant, Host: variant>>>>>>"""


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``value`` string."""
    return spark.read.text(path)


def stream_payloads(spark: SparkSession, path: str, *, max_files: int = 1) -> DataFrame:
    """A stream of ``value``; ``max_files`` bounds a micro-batch."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)


def stream_kafka(spark: SparkSession, servers: str, topic: str, *, max_events: int = 500) -> DataFrame:
    """A stream of ``value`` from a topic (the Kafka package must be on the class path)."""
    s = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return s.option("maxOffsetsPerTrigger", max_events).load().select(F.col("value").cast("string").alias("value"))


def text_of(leaf: Column) -> Column:
    """The string in a variant; null for any other type."""
    return F.when(F.schema_of_variant(leaf) == "STRING", leaf.cast("string"))


def texts_of(leaves: Column) -> Column:
    """The strings of a list of variants; other elements are skipped."""
    return F.array_compact(F.transform(leaves, text_of))


def parse(payloads: DataFrame) -> DataFrame:
    """Adds ``type``, the typed fields of both feeds as the structs ``dns`` and ``web``, and
    ``readable`` (the text is JSON).

    Each payload is parsed and gone through once; every field then is a leaf of its own.
    """
    v = payloads.withColumn("_v", F.try_parse_json("value"))
    v = v.withColumn("readable", F.col("_v").isNotNull()).withColumn("_p", F.try_variant_get("_v", "$", " ".join(SHAPE.split()))).drop("_v")
    p, event = "_p", "_p.data.event.data"
    leaf = lambda path: text_of(F.col(path))
    there = lambda path: F.col(path).isNotNull()
    # only objects of the answer section whose type is exactly CNAME count
    answers = F.transform(f"{p}.dns.answers", lambda a: F.try_variant_get(a, "$", "struct<type: variant, data: variant>"))
    cnames = F.array_compact(F.transform(answers, lambda a: F.when(text_of(a["type"]) == "CNAME", text_of(a["data"]))))
    way = leaf(f"{p}.network.direction")
    side = lambda name, *ways: there(f"{p}.{name}") | ~F.coalesce(way.isin(*ways), F.lit(False))
    dns_ok = there(f"{p}.network") & side("client", "inbound", "ingress") & side("destination", "outbound", "egress") & there(f"{p}.dns.question") & leaf(f"{p}.`@timestamp`").isNotNull()
    dns = {
        "timestamp": leaf(f"{p}.`@timestamp`"), "status": leaf(f"{p}.status"), "resource": leaf(f"{p}.resource"), "direction": way, "client_ip": leaf(f"{p}.client.ip"),
        "destination_ip": leaf(f"{p}.destination.ip"), "question": leaf(f"{p}.dns.question.name"), "etld_plus_one": leaf(f"{p}.dns.question.etld_plus_one"),
        "registered_domain": leaf(f"{p}.dns.question.registered_domain"), "response_code": leaf(f"{p}.dns.response_code"), "resolved_ip": texts_of(F.col(f"{p}.dns.resolved_ip")),
        "cnames": cnames, "complete": dns_ok,
    }
    person = f"{event}.client"
    web = {
        "timestamp": leaf(f"{p}.data.`@timestamp`"), "processed_at": leaf(f"{p}.data.`@processed`"), "has_data": there(event), "has_entry": there(f"{event}.entry"), "url": leaf(f"{event}.entry.url"),
        "scheme": leaf(f"{event}.entry.url_data.Scheme"), "host": leaf(f"{event}.entry.url_data.Host"), "hostname": leaf(f"{person}.Hostname.hostname"), "hostname_short": leaf(f"{person}.Hostname.short"),
        "user": leaf(f"{person}.user"), "platform": leaf(f"{person}.platform"), "browser": leaf(f"{person}.browser"), "ip_addresses": texts_of(F.col(f"{person}.ip_addresses")),
        "complete": leaf(f"{event}.entry.url").isNotNull() & leaf(f"{p}.data.`@timestamp`").isNotNull(),
    }
    packed = lambda kind, fields: F.when(F.col("type") == kind, F.struct(*(x.alias(n) for n, x in fields.items())))
    v = v.withColumn("type", leaf(f"{p}.type"))
    return v.withColumns({"dns": packed(TYPES[0], dns), "web": packed(TYPES[1], web)}).drop("_p")


def _fields(parsed: DataFrame, feed: str) -> DataFrame:
    own = [c for c in parsed.columns if c not in ("dns", "web")]
    return parsed.filter(F.col(feed).isNotNull()).select(*(f"`{c}`" for c in own), f"{feed}.*")


def dns_fields(parsed: DataFrame) -> DataFrame:
    """The DNS events with the typed columns that their operators take."""
    return _fields(parsed, "dns")


def browser_fields(parsed: DataFrame) -> DataFrame:
    """The browser events with the typed columns that their operators take."""
    return _fields(parsed, "web")
