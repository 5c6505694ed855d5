import json
import random

import pytest
from pyspark.sql import functions as F

from hostlens.operators import enrich, lookup, ptr, reports, sieve, sinks
from hostlens.operators import entries as ent
from hostlens.operators.suffix import registrable_domains
from hostlens.operators import taxonomy as tax_module
from hostlens.operators.taxonomy import classified, severities, severity_rows, taxonomy, taxonomy_rows, with_facets
from hostlens.plans.jobs import Reference, build_entries
from hostlens.session import written
from hostlens.sources import events as src
from hostlens.sources import lists
from hostlens.streaming import consumer

RULES = [("exact", x) for x in "com net org io uk co.uk ac.uk github.io blogspot.com s3.amazonaws.com cn 公司.cn".split()] + [("wildcard", "ck"), ("exception", "www.ck")]
ENTRIES = [("news.example.com", ["news"], ["a"]), ("*.track.net", ["tracking"], ["b"]), ("*.gov", ["government"], ["c"]), ("cdn.org", ["advertising", "tracking"], ["b", "d"])]


@pytest.fixture()
def rules(spark):
    return spark.createDataFrame(RULES, "kind string, rule string")


@pytest.fixture()
def entries(spark):
    return spark.createDataFrame(ENTRIES, "domain string, categories array<string>, sources array<string>")


def hosts(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "host string")


@pytest.mark.parametrize(
    ("host", "domain"),
    [("news.bbc.co.uk", "bbc.co.uk"), ("co.uk", None), ("bar.foo.ck", "bar.foo.ck"), ("a.bar.foo.ck", "bar.foo.ck"), ("www.ck", "www.ck"), ("x.www.ck", "www.ck"), ("host.invalidtldxyz", "host.invalidtldxyz"), ("localhost", None), ("A.GitHub.io.", "a.github.io")],
)
def test_registrable_domain(spark, rules, host, domain):
    r = registrable_domains(hosts(spark, host), rules).first()
    assert r["registrable_domain"] == domain and r["psl_fallback"] is None


def test_without_rules_the_domain_is_guessed(spark, rules):
    r = registrable_domains(hosts(spark, "news.bbc.co.uk"), rules.limit(0)).first()
    assert (r["registrable_domain"], r["psl_fallback"]) == ("co.uk", True)


def test_ancestor_lookup(spark, entries):
    found = {r["host"]: r for r in lookup.ancestor_lookup(hosts(spark, "a.news.example.com", "track.net", "x.track.net", "nasa.gov", "example.com", "eu.cdn.org", None), entries).collect()}
    assert set(found) == {"a.news.example.com", "track.net", "x.track.net", "nasa.gov", "eu.cdn.org"}
    assert found["track.net"]["matched_on"] == ["*.track.net"] and found["nasa.gov"]["contexts"] == ["government"]
    assert found["eu.cdn.org"]["contexts"] == ["advertising", "tracking"] and found["eu.cdn.org"]["sources"] == ["b", "d"]


def test_chain_is_merged_in_ancestor_mode_only(spark, entries):
    e = spark.createDataFrame([(1, "news.example.com", ["cdn.org"], ["news.example.com"]), (2, "none.io", [], ["none.io"])], "event_id long, host string, chain array<string>, searches array<string>")
    a = {r["event_id"]: r for r in lookup.resolve(e, entries).collect()}
    assert a[1]["contexts"] == ["advertising", "news", "tracking"] and a[1]["match_source"] == ["question", "cname"] and a[2]["contexts"] == [] and a[2]["match_source"] is None
    c = {r["event_id"]: r for r in lookup.resolve(e, entries, mode="compare").collect()}
    assert c[1]["contexts"] == ["news"] and c[1]["cname_contexts"] == ["advertising", "tracking"] and c[1]["context_match"]
    x = lookup.resolve(e, None, exact_entries=entries).filter("event_id = 1").first()
    assert x["contexts"] == ["news"] and x["index_error"]


def test_taxonomy(spark):
    assert len({c for c, *_ in taxonomy_rows()}) == 90 and len(severity_rows()) == 13
    rows = [["facebook", "social", "tracking"], ["advertising", "malware"], ["fascist"], [" NoSuchThing "]]
    df = spark.createDataFrame([(r,) for r in rows], "contexts array<string>")
    got = {tuple(r["contexts"]): r for r in classified(df, taxonomy(spark), severities(spark)).collect()}
    a, b, c, d = (got[tuple(r)] for r in rows)
    assert (a["service"], a["purpose"], a["risk"], a["risk_severity"]) == (["meta.facebook"], ["social.networks"], ["privacy.tracking"], "low")
    assert b["risk_severity"] == "high" and c["risk_severity"] is None and d["unmapped_contexts"] == ["nosuchthing"] and d["risk"] is None


def test_facets_by_literals_and_by_join_agree(spark, monkeypatch):
    df = spark.createDataFrame([(1, ["facebook", "vpn", "x"]), (2, []), (3, ["zionist", "crypto", "Vpn "]), (4, None)], "event_id int, contexts array<string>")
    key = lambda d: sorted(map(repr, d.select(sorted(d.columns)).collect()))
    a = key(with_facets(df, taxonomy(spark), severities(spark)))
    monkeypatch.setattr(tax_module, "LITERAL_ROWS", 0)
    assert key(with_facets(df, taxonomy(spark), severities(spark))) == a


def test_merge_and_ignorelist(spark):
    rows = spark.createDataFrame([("evil.example.com", "porn", "a"), ("evil.example.com", "malware", "b"), ("shop.example.com", "porn", "a"), ("ok.org", "news", "a")], "domain string, category string, source string")
    merged = ent.merge_entries(rows)
    ign = spark.createDataFrame([("porn", " Evil.Example.com"), ("porn", "shop.example.com"), ("malware", "evil.example.com")], "context string, host string")
    assert tuple(ent.ignorelist_counts(merged, ign).first()) == (3, 2)
    assert [r["domain"] for r in ent.apply_ignorelist(merged, ign).collect()] == ["ok.org"]
    assert ent.apply_ignorelist(merged, ign.limit(0)).count() == 3


def test_keep_previous(spark):
    new = spark.createDataFrame([("a", "x.com")], "source string, host string")
    old = spark.createDataFrame([("a", "y.com"), ("b", "z.com")], "source string, host string")
    assert {tuple(r) for r in ent.keep_previous(new, old).collect()} == {("a", "x.com"), ("b", "z.com")}


def test_files_of_one_name_have_the_category_of_their_folder(spark, tmp_path):
    for p, t in {"government/curated": "a.gov.uk\n", "social/curated": "b.example.com\nboth.com\n", "government/list.txt": "both.com\n", "x/list.txt": "c.com\n"}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(t)
    configured = spark.createDataFrame([("list.txt", ["ads"])], "source string, categories array<string>")
    lines = lists.read_list_lines(spark, str(tmp_path))
    built = {r["domain"]: (r["categories"], r["sources"]) for r in build_entries(lines, configured, spark.createDataFrame([], "context string, host string")).collect()}
    assert built == {"a.gov.uk": (["government"], ["curated"]), "b.example.com": (["social"], ["curated"]), "both.com": (["ads", "social"], ["curated", "list.txt"]), "c.com": (["ads"], ["list.txt"])}


def test_a_hot_host_without_chains_is_spread(spark, entries, rules):
    """90 % of the events have one host and no chain; nothing is broadcast."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    was = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        host = "if(id % 10 > 0, 'a.news.example.com', concat('h', id, '.io'))"
        e = spark.range(40000, numPartitions=8).selectExpr("id as event_id", f"{host} as host", "if(id % 50 = 0, array('cdn.org'), cast(array() as array<string>)) as chain", f"array({host}) as searches", "sha2(cast(id as string), 512) as wide")
        e = written(e)
        found = written(lookup.ancestor_lookup(lookup.hosts_of(e), entries))
        out = lookup.resolve(e, entries, found=found, cut=written)
        sizes = sorted(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
        assert sum(sizes) == 40000 and sizes[-1] < 40000 / 4
        got = {r["event_id"]: r for r in out.filter("event_id < 60").collect()}
        assert got[1]["contexts"] == ["news"] and got[10]["contexts"] == [] and got[50]["contexts"] == ["advertising", "tracking"]
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_sources(spark, tmp_path):
    for p, t in {"porn/curated": "a.com\n\n", "tracking/list.txt": "0.0.0.0 t.net\n", "tld/fallback.txt": "# x\nCOM\n\norg\n", "x/.gitignore": "*"}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(t)
    lines = lists.read_list_lines(spark, str(tmp_path))
    assert {(r["source"], r["folder"]) for r in lines.collect()} == {("curated", "porn"), ("list.txt", "tracking")}
    assert [tuple(r) for r in lists.curated_files(lines).collect()] == [("porn/curated", ["porn"])]
    assert lists.read_list_lines(spark, str(tmp_path), exclude=["./tracking/./list.txt"]).filter("source = 'list.txt'").count() == 0
    assert {r[0] for r in lists.tlds(spark.read.text(str(tmp_path / "tld")).withColumnRenamed("value", "line")).collect()} == {"com", "org"}
    text = spark.createDataFrame([("// c",), ("公司.cn x",), ("*.ck",), ("!www.ck",), ("",)], "line string")
    assert {tuple(r) for r in lists.suffix_rules(text).collect()} == {("exact", "公司.cn"), ("exact", "xn--55qx5d.cn"), ("wildcard", "ck"), ("exception", "www.ck")}
    (tmp_path / "ign.json").write_text(json.dumps({"porn": ["a.com", "b.com"]}))
    assert lists.read_ignorelist(spark, str(tmp_path / "ign.json")).count() == 2 and lists.read_ignorelist(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "reg.json").write_text(json.dumps([{"name": "n", "file": "tracking/list.txt", "url": "u", "categories": ["tracking", "ads"]}]))
    assert lists.registry_files(lists.read_registry(spark, str(tmp_path / "reg.json"))).first()["categories"] == ["ads", "tracking"]


def test_ptr_holds_until_its_ttl(spark):
    ts = lambda s: f"cast({s} as timestamp)"
    obs = spark.sql(f"select '10.0.0.3' client, {ts(100)} observed_at, array('A.x.', 'a.X') hosts, 'ok' status union all select '10.0.0.3', {ts(200)}, array(), 'Timeout'")
    cases = [("'10.0.0.3'", 399), ("'10.0.0.3'", 400), ("'10.0.0.3'", 99), ("null", 150), ("'10.0.0.3'", 100), ("'not an ip'", 100), ("'10.0.0.3 '", 100), ("''", 100), ("'fe80::1%eth0'", 100)]
    ev = spark.sql(" union all ".join(f"select {i} event_id, {c} client, {ts(t)} ts" for i, (c, t) in enumerate(cases)))
    rows = {r["event_id"]: r for r in ptr.with_ptr(ev, obs, ttl=300).collect()}
    bad, asked = "bad_client_address", "3.0.0.10.in-addr.arpa."
    got = {k: (r["ptr_status"], r["client_hosts"], r["client_hosts_short"], r["ptr"]) for k, r in rows.items()}
    assert got == {0: ("ok", ["a.x"], ["a"], asked), 1: ("not_observed", [], [], asked), 2: ("not_observed", [], [], asked), 3: ("skipped", [], [], None), 4: ("ok", ["a.x"], ["a"], asked),
                   5: (bad, [], [], ""), 6: (bad, [], [], ""), 7: ("skipped", [], [], None), 8: (bad, [], [], "")}
    two = spark.sql(f"select '10.0.0.3' client, {ts(100)} observed_at, array(h) hosts, s status from values ('b.x', 'ok'), ('a.x', 'ok'), ('z.x', 'nxdomain') t(h, s)")
    for o in (two, two.orderBy("hosts"), two.orderBy(F.desc("hosts"))):  # of one time, the greatest counts
        assert ptr.with_ptr(ev.filter("event_id = 4"), o, ttl=300).first()["client_hosts"] == ["b.x"]
    many = spark.range(59).selectExpr("concat('10.0.0.', id) client", "cast(id as timestamp) observed_at", "array('h') hosts", "'ok' status")
    assert {int(r["client"].split(".")[3]) for r in ptr.bounded(many, most=10).collect()} == set(range(49, 59))


DNS = {"type": "dns", "@timestamp": "2024-01-01T00:00:00Z", "status": "OK", "resource": "A.News.Example.com.", "network": {"direction": "inbound"}, "client": {"ip": "10.0.0.1"}, "destination": {"ip": "10.0.0.2"},
       "dns": {"question": {"etld_plus_one": "example.com"}, "answers": [{"type": "CNAME", "data": "CDN.org."}, None, 7, {"type": "A", "data": "x"}, {"type": "CNAME"}], "resolved_ip": ["0.0.0.0", 5], "response_code": "nxdomain"}}
WEB = {"type": "browser.history", "data": {"@timestamp": "2024-01-01T10:00:00Z", "@processed": "2024-01-01T10:00:01.5-0400", "event": {"data": {"client": {"Hostname": {"hostname": "H.lan", "short": "h"}, "user": 42, "browser": "safari", "ip_addresses": ["fe80::1", "10.1.1.1"]},
       "entry": {"url": "https://x.track.net/a", "url_data": {"Scheme": "https", "Host": "X.track.net:8080"}}}}}}
PAYLOADS = [json.dumps(DNS), json.dumps(DNS), json.dumps(WEB), "{bad", json.dumps(DNS | {"status": "Error"}), json.dumps({k: v for k, v in DNS.items() if k != "client"}), json.dumps({"type": "other"}), "[]"]


@pytest.fixture()
def ref(spark, rules, entries):
    return Reference(entries, rules, spark.createDataFrame([("dns", "client", "9.9.9.9")], "scope string, kind string, value string"))


def test_documents_from_payloads(spark, ref):
    df = spark.createDataFrame([(x,) for x in PAYLOADS], "value string")
    docs = consumer.process(consumer.identified(df, 0), ref).collect()
    dns, web = [d for d in docs if d["type"] == "dns"], [d for d in docs if d["type"] != "dns"]
    assert len(dns) == 2 and len(web) == 1  # repeated events stay
    assert dns[0]["searches"] == ["a.news.example.com", "example.com", "*.example.com", "*.com"] and dns[0]["contexts"] == ["advertising", "news", "tracking"]
    assert dns[0]["cname_chain"] == ["cdn.org"] and dns[0]["resolved_ips"] == ["0.0.0.0"] and dns[0]["response_code"] == "NXDOMAIN" and dns[0]["client"] == "10.0.0.1"
    assert web[0]["event_time_utc"] == "2024-01-01T14:00:00Z" and web[0]["client_user"] is None and web[0]["client_ips"] == ["10.1.1.1"] and web[0]["contexts"] == ["tracking"]
    v = {r["verdict"]: r["events"] for r in sieve.verdict_counts(consumer.verdicts(src.parse(consumer.identified(df, 0)), ref)).collect()}
    assert v == {"kept": 3, "unreadable": 2, "dropped": 3}


def test_stream_equals_batch(spark, ref, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(PAYLOADS[4 * i : 4 * i + 4]))
    stream = src.stream_payloads(spark, str(tmp_path / "in"))
    consumer.consume(stream, lambda: ref, str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination()
    got = consumer.committed(spark, str(tmp_path / "out"))
    assert got.select("batch_id").distinct().count() >= 1 and got.count() == 3


def test_identities_are_counted_within_reach(spark):
    r = random.Random(7)
    web = [(r.randint(0, 9000), f"u{r.randint(0, 5)}", f"h{r.randint(0, 3)}", f"10.0.0.{r.randint(0, 2)}") for _ in range(300)]
    dns = [(i, f"10.0.0.{r.randint(0, 3)}", r.randint(-2000, 12000)) for i in range(400)]
    w = spark.createDataFrame([(u, h, [a, a, "1.1.1.1"], h, t) for t, u, h, a in web], "client_user string, client_hostname string, client_ips array<string>, client_hostname_short string, t long").selectExpr("*", "cast(t as timestamp) ts")
    d = spark.createDataFrame([(i, a, t, ["h1"] if i % 2 else []) for i, a, t in dns], "event_id long, client string, t long, client_hosts_short array<string>").selectExpr("*", "cast(t as timestamp) ts")
    got = {x["event_id"]: (x["by"], x["client_user"], x["candidates"]) for x in reports.client_identity_table(w, d, within_seconds=100).collect()}
    named = {(u, h) for _, u, h, _ in web if h == "h1"}
    for i, a, t in dns:
        near = sorted((abs(t - bt), u, h) for bt, u, h, x in web if x == a and abs(t - bt) <= 100)
        want = ("address", near[0][1], len({x[1:] for x in near})) if near else ("name", min(named)[0], len(named)) if i % 2 else None
        assert got.get(i) == want


def test_streams_without_repeats_and_by_hour(spark, tmp_path):
    rows = [("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:10:00"), ("b", "2024-01-01 00:50:00"), ("c", "2024-01-01 01:20:00")]
    spark.createDataFrame(rows, "event_id string, t string").selectExpr("event_id", "cast(t as timestamp) ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema("event_id string, ts timestamp").parquet(f"{tmp_path}/in")
    for name, df in (("once", consumer.without_repeats(read())), ("hours", consumer.hourly(read()))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append" if name == "once" else "complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck-{name}").start()
        q.awaitTermination()
        assert consumer.progress(q)["batch"] >= 0
    assert sorted(x["event_id"] for x in spark.table("once").collect()) == ["a", "b", "c"] and sorted(x["events"] for x in spark.table("hours").collect()) == [1, 3]


def test_sieve_reasons(spark):
    rules = spark.createDataFrame([("dns", "domain", "Example.com."), ("dns", "host", "h.net"), ("browser", "user", "Bob")], "scope string, kind string, value string")
    rows = [("www.example.com", "OK", None), ("www.notexample.com", "OK", None), ("H.net.", "OK", "host"), ("x.io", None, "status")]
    base = [(i, "dns", s, r, "inbound", "1.1.1.1") for i, (r, s, _) in enumerate(rows)]
    e = spark.createDataFrame(base, "event_id int, type string, status string, resource string, direction string, client_ip string")
    e = e.withColumns({c: F.lit(None).cast("string") for c in ("destination_ip", "question", "etld_plus_one", "registered_domain")})
    got = {r["event_id"]: r["drop_reason"] for r in sieve.sieve_dns(e, rules).collect()}
    assert got == {0: "domain", 1: None, 2: "host", 3: "status"}


def test_long_rule_tables_are_joined(spark, monkeypatch):
    monkeypatch.setattr(sieve, "LITERAL_RULES", 0)
    test_sieve_reasons(spark)


def test_daily_and_syslog(spark, tmp_path):
    d = spark.createDataFrame([(1, None)], "a int, b string")
    sinks.write_daily(d, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).first()["index_name"].startswith("hostlens-20")
    assert sinks.syslog_lines(d).first()["value"] == '<30>{"a":1}'


def test_united_documents(spark):
    e = spark.createDataFrame([("t", ["a.b"], ["x"], "dns"), ("t", [], [], "dns")], "timestamp string, searches array<string>, contexts array<string>, type string")
    assert enrich.documents(e).count() == 1
