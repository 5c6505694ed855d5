"""Generations of entries: publishing, their layout, and builds in steps."""

import re

import pytest

from hostlens.operators import entries as ent
from hostlens.operators import increments, lookup, reports, sinks
from hostlens.plans.jobs import build_entries

ENTRIES = [("news.example.com", ["news"], ["a"]), ("*.track.net", ["tracking"], ["b"]), ("*.gov", ["government"], ["c"]), ("cdn.org", ["advertising", "tracking"], ["b", "d"])]


@pytest.fixture()
def entries(spark):
    return spark.createDataFrame(ENTRIES, "domain string, categories array<string>, sources array<string>")


def test_generations(spark, entries, tmp_path):
    root = str(tmp_path / "g")
    assert sinks.manifest(spark, root) is None and not sinks.is_stale(spark, root, None)
    sinks.publish(entries, root, built_at=5)
    assert sinks.read_generation(spark, root).count() == 4 and sinks.is_stale(spark, root, 4) and not sinks.is_stale(spark, root, 5)
    for bad, more in ((entries.limit(0), {}), (entries, {"needed": ["no.such"]}), (entries, {"least": 4})):
        with pytest.raises(ValueError, match="not usable"):
            sinks.publish(bad, root, built_at=6, **more)
        assert sinks.manifest(spark, root)["built_at"] == 5 and sinks.read_generation(spark, root).count() == 4
    with pytest.raises(ValueError, match="not newer"):
        sinks.publish(entries, root, built_at=5)
    entries.limit(1).write.mode("overwrite").parquet(f"{root}/generation=5")
    with pytest.raises(ValueError, match="damaged"):
        sinks.read_generation(spark, root)
    for n in (7, 8, 9):
        sinks.publish(entries, root, built_at=n, needed=["*.gov"], least=3)
    assert sinks.generations(spark, root) == [8, 9] and sinks.read_generation(spark, root).count() == 4


def test_refused_builds_do_not_count_as_kept(spark, entries, tmp_path):
    root = str(tmp_path / "g")
    sinks.publish(entries, root, built_at=5)
    for n in (6, 7):
        with pytest.raises(ValueError, match="not usable"):
            sinks.publish(entries, root, built_at=n, needed=["no.such"])
        assert sinks.generations(spark, root) == [5]
    entries.write.parquet(f"{root}/generation=8")  # a build that was cut short
    sinks.publish(entries, root, built_at=9)
    assert sinks.generations(spark, root) == [5, 9]
    assert sinks.read_generation(spark, root, built_at=5).count() == 4
    with pytest.raises(ValueError, match="8 is not published"):
        sinks.read_generation(spark, root, built_at=8)


def many(spark, n=20000):
    e = spark.range(n).selectExpr("concat('h', id, '.', array('com', 'example.org', 'example-x.org', 'net')[cast(id % 4 as int)]) domain", "array('x') categories", "array('s') sources")
    return ent.sorted_entries(e)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_look_ups_do_not_move_bucketed_entries(spark, tmp_path):
    root = str(tmp_path / "g")
    sinks.publish(many(spark), root, built_at=1, buckets=4)
    entries = sinks.read_generation(spark, root)
    hosts = spark.range(300).selectExpr("concat('a.h', id * 7, '.net') host")
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}.items():
            spark.conf.set(k, v)
        found = lookup.ancestor_lookup(hosts, entries)
        lines = plan_of(found).split("\n")
        scans = [k for k, x in enumerate(lines) if "Bucketed: true" in x]
        assert len(scans) >= 1
        for k in scans:  # what stands above the scan up to the join
            depth, above = len(re.match(r"[ :+|-]*", lines[k])[0]), []
            for x in reversed(lines[:k]):
                if (d := len(re.match(r"[ :+|-]*", x)[0])) < depth:
                    depth = d
                    above.append(x)
                    if "Join" in x:
                        break
            assert not any("Exchange hashpartitioning" in x for x in above), above
        want = lookup.ancestor_lookup(hosts, many(spark))
        assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and found.count() == 75
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_what_is_below_a_domain_is_a_range(spark, tmp_path):
    root = str(tmp_path / "g")
    was = spark.sparkContext._jsc.hadoopConfiguration().get("parquet.block.size")
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", "16384")
    try:
        sinks.publish(many(spark), root, built_at=1, buckets=2)
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        conf.set("parquet.block.size", was) if was else conf.unset("parquet.block.size")
    e = sinks.read_generation(spark, root)
    found = ent.below(e, "Example.org.")
    assert {r["domain"].split(".", 1)[1] for r in found.collect()} == {"example.org"} and found.count() == 5000
    assert ent.below(e, "h1.example.org").count() == 1 and ent.below(e, "nothing.org").count() == 0
    assert "GreaterThanOrEqual(reversed,org.example)" in plan_of(found) and "LessThan(reversed,org.example/)" in plan_of(found)
    found.write.format("noop").mode("overwrite").save()
    scan = found._jdf.queryExecution().executedPlan()
    while scan.children().size():
        scan = scan.children().apply(0)
    read = spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(scan.metrics())["numOutputRows"]
    ent.below(e, "example.org").count()
    assert read.value() < 20000  # row groups of other ranges are skipped


def lists(spark, rows):
    return spark.createDataFrame(rows, "source string, folder string, line string")


def test_builds_in_steps_equal_full_builds(spark, tmp_path):
    root = str(tmp_path / "g")
    base = [("a", "ads", "x.com"), ("a", "ads", "y.com"), ("b", "malware", "0.0.0.0 y.com"), ("b", "malware", "z.org"), ("c", "news", "n.org")]
    none = [("q", "zero.net")]
    steps = [
        (base, [("a", ["ads"])], none),
        (base + [("a", "ads", "new.com")], [("a", ["ads"])], none),  # a line more
        ([r for r in base if r[0] != "b"], [("a", ["ads"])], none),  # a list less
        (base + [("d", "ads", "y.com")], [("a", ["ads", "tracking"])], none),  # a list more, other categories
        (base + [("d", "ads", "y.com")], [("a", ["ads", "tracking"])], [("ads", "Y.com"), ("news", "n.org")]),  # other rules
        (base + [("d", "ads", "y.com")], [("a", ["ads", "tracking"])], none),  # and back
        (base[:1] * 2 + base[1:], [("a", ["ads", "tracking"])], none),  # a line twice
    ]
    key = lambda df: sorted(map(repr, df.select("domain", "categories", "sources", "reversed").collect()))
    for n, (rows, conf, ign) in enumerate(steps, 1):
        configured, rules = spark.createDataFrame(conf, "source string, categories array<string>"), spark.createDataFrame(ign, "context string, host string")
        increments.build_next(lists(spark, rows), configured, rules, root, built_at=n)
        assert key(sinks.read_generation(spark, root)) == key(build_entries(lists(spark, rows), configured, rules))
    # only what changed was cleaned again
    assert spark.read.parquet(f"{root}/rows/at=2").select("source").distinct().count() == 1
    assert spark.read.parquet(f"{root}/rows/at=5").count() == 0 and spark.read.parquet(f"{root}/files/at=6").filter("at = 1").count() == 1  # c: b was away in between


def test_sketches_of_days_unite(spark):
    e = spark.range(60000).selectExpr("date_add(date'2024-01-01', cast(id % 5 as int)) ts", "if(id % 3 = 0, 'a.com', 'b.com') registrable_domain", "concat('c', id % 20000) client")
    base = reports.daily_clients(e)
    exact = {r["registrable_domain"]: (r["events"], r["clients"]) for r in reports.distinct_clients(base).collect()}
    near = {r["registrable_domain"]: (r["events"], r["clients"]) for r in reports.sketched_clients(reports.daily_domains(base)).collect()}
    assert exact == {"a.com": (20000, 20000), "b.com": (40000, 20000)}
    assert all(near[d][0] == n and abs(near[d][1] - c) <= 4 * 1.04 / 64 * c for d, (n, c) in exact.items())
    one = reports.distinct_clients(base, "2024-01-02", "2024-01-02").filter("registrable_domain = 'a.com'").first()
    assert (one["events"], one["clients"]) == (4000, 4000)
    assert reports.distinct_clients(base.limit(0)).count() == 0
