"""Streams: commits, counters, reference data that breaks, and the memory of names."""

import json
import random

import pytest
from pyspark.sql.streaming import StreamingQuery

from hostlens.operators import ptr, sieve, sinks
from hostlens.plans import queries
from hostlens.plans.jobs import Reference
from hostlens.sources import events as src
from hostlens.streaming import consumer
from hostlens.streaming.ptr_memory import BUCKETS, state_store, with_ptr_stream
from hostlens.streaming.reference import LastGood

ENTRIES = [("*.example.com", ["news"], ["a"]), ("cdn.org", ["ads"], ["b"])]


def payload(k):
    p = {"type": "dns", "@timestamp": "2024-01-01T00:00:00Z", "status": "OK" if k % 4 else "Error", "resource": f"h{k}.example.com", "network": {"direction": "inbound"}, "client": {"ip": "10.0.0.1"}, "destination": {"ip": "10.0.0.2"},
         "dns": {"question": {"name": "x"}, "answers": [{"type": "CNAME", "data": "CDN.org."}]}}
    return "{bad" if k % 10 == 7 else json.dumps(p)


def entries(spark, n=2):
    return spark.createDataFrame(ENTRIES[:n], "domain string, categories array<string>, sources array<string>")


def made(spark):
    rules = spark.createDataFrame([("exact", "com"), ("exact", "org")], "kind string, rule string")
    ignore = spark.createDataFrame([("dns", "client", "9.9.9.9")], "scope string, kind string, value string")
    return lambda e, at: Reference(e, rules, ignore, built_at=at)


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(rows))


def run(spark, tmp_path, reference) -> StreamingQuery:
    q = consumer.consume(src.stream_payloads(spark, str(tmp_path / "in")), reference, str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
    q.awaitTermination()
    return q


def test_a_batch_is_there_once_or_not_at_all(spark, tmp_path, monkeypatch):
    """The second batch fails between its two outputs, then comes again; the third is stopped
    after its commit, and comes again too."""
    ref = made(spark)(entries(spark), 1)
    out = str(tmp_path / "out")
    put(tmp_path / "in", "0", [payload(k) for k in range(20)])
    run(spark, tmp_path, lambda: ref)
    assert consumer.committed(spark, out).count() == consumer.commits(spark, out).first()["kept"]
    real = consumer.commit
    put(tmp_path / "in", "1", [payload(k) for k in range(20, 40)])
    monkeypatch.setattr(consumer, "documents", lambda *a, **k: consumer.src.no_such_function)
    with pytest.raises(Exception, match="no_such_function"):
        run(spark, tmp_path, lambda: ref)
    monkeypatch.undo()

    def halfway(spark_, path, row):
        raise RuntimeError("between outputs and commit")

    monkeypatch.setattr(consumer, "commit", halfway)
    with pytest.raises(Exception, match="between outputs"):
        run(spark, tmp_path, lambda: ref)
    assert consumer.commits(spark, out).count() == 1  # folders are there, but no commit names them
    assert len(list((tmp_path / "out" / "documents" / "batch_id=1").iterdir())) == 1

    def then_dies(spark_, path, row):
        real(spark_, path, row)
        raise RuntimeError("after the commit")

    monkeypatch.setattr(consumer, "commit", then_dies)
    with pytest.raises(Exception, match="after the commit"):
        run(spark, tmp_path, lambda: ref)
    monkeypatch.undo()
    run(spark, tmp_path, lambda: ref)
    ids = [r["event_id"] for r in consumer.committed(spark, out, "verdicts").collect()]
    assert len(ids) == len(set(ids)) == 40
    names = sorted(json.loads(r["packet"])["resource"] for r in consumer.committed(spark, out).collect())
    assert names == sorted(f"h{k}.example.com" for k in range(40) if k % 4 and k % 10 != 7)


def test_counters_are_those_of_a_second_look(spark, tmp_path):
    ref = made(spark)(entries(spark), 1)
    for k in range(3):
        put(tmp_path / "in", f"{k}", [payload(x) for x in range(15 * k, 15 * k + 15)])
    run(spark, tmp_path, lambda: ref)
    rows = consumer.commits(spark, str(tmp_path / "out")).collect()
    assert len(rows) == 3
    got = {v: sum(r[v] for r in rows) for v in consumer.VERDICTS}
    df = consumer.identified(spark.createDataFrame([(payload(x),) for x in range(45)], "value string"), 0)
    assert got == {r["verdict"]: r["events"] for r in sieve.verdict_counts(consumer.verdicts(src.parse(df), ref)).collect()}


def test_a_damaged_generation_leaves_the_last_good_one(spark, tmp_path):
    root = str(tmp_path / "g")
    current = LastGood(spark, root, made(spark))
    with pytest.raises(ValueError, match="nothing published"):
        current()
    sinks.publish(entries(spark), root, built_at=100)
    put(tmp_path / "in", "0", [payload(1)])
    run(spark, tmp_path, current)
    sinks.publish(entries(spark, 1), root, built_at=200)
    entries(spark).write.mode("overwrite").parquet(f"{root}/generation=200")
    put(tmp_path / "in", "1", [payload(2)])
    run(spark, tmp_path, current)
    assert "damaged" in current.error and current.age(now=160) == 60
    again = LastGood(spark, root, made(spark))  # a start that meets it at once
    assert again().built_at == 100 and "damaged" in again.error
    sinks.publish(entries(spark, 1), root, built_at=300)
    put(tmp_path / "in", "2", [payload(3)])
    run(spark, tmp_path, current)
    assert current.error is None
    docs = {json.loads(r["packet"])["resource"]: (r["index_built_at"], r["contexts"]) for r in consumer.committed(spark, str(tmp_path / "out")).collect()}
    assert docs == {"h1.example.com": (100, ["ads", "news"]), "h2.example.com": (100, ["ads", "news"]), "h3.example.com": (300, ["news"])}


def test_memory_of_names_equals_the_batch(spark, tmp_path):
    """Answers that expire and are refreshed, over a restart from the checkpoint."""
    state_store(spark)
    r = random.Random(1)
    rows, kind = [], "t double, client string, status string, hosts array<string>, event_id long"
    for i in range(240):
        t, client = i * 7 + r.random(), f"10.0.0.{r.randint(1, 3)}"
        rows.append((t, client, r.choice(["ok", "nxdomain", "Timeout"]), [r.choice(["A.x.", "b.y"])], None) if r.random() < 0.4 else (t, r.choice([client, client, "bad", None]), None, None, i))
    frame = lambda rs: spark.createDataFrame(rs, kind).selectExpr("*", "cast(t as timestamp) ts", "cast(t as timestamp) observed_at")
    event, seen = ["event_id", "client", "ts"], ["client", "observed_at", "hosts", "status"]
    for part in (rows[:150], [*rows[150:], (1e6, "10.9.9.9", None, None, -1)]):
        frame(part).write.mode("append").parquet(str(tmp_path / "in"))
        read = lambda: spark.readStream.schema(frame(rows[:1]).schema).parquet(str(tmp_path / "in"))
        q = with_ptr_stream(read().filter("event_id is not null").select(event), read().filter("status is not null").select(seen), ttl=60, late="20 seconds")
        q.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).filter("event_id >= 0")
    want = ptr.with_ptr(frame(rows).filter("event_id is not null").select(event), frame(rows).filter("status is not null").select(seen), ttl=60)
    key = lambda d: sorted(map(repr, d.select(*event, *ptr.FIELDS).collect()))
    assert key(got) == key(want) and {x["ptr_status"] for x in want.collect()} == {"ok", "nxdomain", "not_observed", "bad_client_address", "skipped"}


def test_state_grows_with_slices_not_with_clients(spark, tmp_path):
    """Six hundred clients in a minute, each with an answer of its own, are a state a bucket."""
    state_store(spark)
    seen = spark.range(600).selectExpr("concat('10.1.', id div 250, '.', id % 250) client", "timestamp_seconds(1000 + id / 100) observed_at", "array(concat('h', id)) hosts", "'ok' status")
    asked = seen.selectExpr("client", "observed_at + interval 30 seconds ts", "client c")
    last = spark.createDataFrame([("10.9.9.9", "end")], "client string, c string").selectExpr("client", "timestamp_seconds(1000000) ts", "c")
    seen.write.parquet(str(tmp_path / "seen"))
    asked.unionByName(last).write.parquet(str(tmp_path / "asked"))
    read = lambda df, name: spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    found = with_ptr_stream(read(asked, "asked"), read(seen, "seen"), late="1 second")
    q = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= BUCKETS + 1
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 600 and got.filter("ptr_status = 'ok' and client_hosts[0] = concat('h', cast(split(client, '[.]')[2] as int) * 250 + split(client, '[.]')[3])").count() == 600


def test_payloads_are_made_by_as_many_tasks_as_there_are_partitions(spark):
    """One small file of events is long texts: a task a partition makes them, for each feed."""
    made_of = queries.payloads(spark, "/root/testdata/sf0.001")
    assert len(made_of.inputFiles()) == 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_kafka_source_says_what_it_reads(spark):
    """Without its package the source can't start; that is told, with its name."""
    with pytest.raises(Exception, match="(?i)kafka"):
        src.stream_kafka(spark, "127.0.0.1:1", "topic")
