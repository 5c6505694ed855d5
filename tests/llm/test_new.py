"""Conversation trie, periodic runs and WARC archives against brute force."""

import gzip
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostlens.llm import conversation_trie as ct
from hostlens.llm import periodic_runs as pr
from hostlens.llm import warc

# --- conversation trie ---------------------------------------------------------------


def key(role, text):
    role, text = role or "", text or ""
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def brute_trie(rows, openings):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, key(role, text), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(turns)] for c, turns in own.items()}
    convs = own
    if openings:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
        convs = {c: own.get(int(c / 100) * 100, [])[: h[c]] + t[h[c] :] for c, t in own.items()}  # % as in SQL
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = {}

    def totals(p):
        below = [totals(k) for k in kids.get(p, [])]
        leaves = sum(x[0] for x in below) or 1
        saved = sum(x[1] for x in below) + (len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0)
        ends = ",".join(map(str, sorted(c for c in nodes[p] if len(convs[c]) == len(p))))
        out[min(nodes[p]), len(p)] = (min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
        return leaves, saved

    if nodes:
        totals(())
    return out


def conversations(seed):
    r = random.Random(seed)
    texts = ["", "hi", "há", None, "same", "x" * 50]
    rows = []
    for c in r.sample(range(330), 90) + [0, 100, -7]:
        first = [("system", "hot")] if r.random() < 0.5 else []
        for t, (role, text) in enumerate(first + [(r.choice(["user", "assistant", None]), r.choice(texts)) for _ in range(r.randint(1, 7))]):
            rows.append((c, r.choice([t, t, t, None, 1]), role, text))
    rows += [(200, k, "user", f"long {k % 3}") for k in range(60)] + rows[:5] + [(None, 1, "user", "of no conversation")]
    return rows


@pytest.mark.parametrize(("openings", "shard", "queue"), [(True, None, ct.QUEUE), (False, 4, 3), (True, 2, 2), (True, 10**9, 5)])
def test_conversation_trie(spark, openings, shard, queue):
    rows = conversations(1 + bool(shard))
    df = spark.createDataFrame([(*x, "more", 1) for x in rows], "conv_id long, turn long, role string, text string, depth string, p1 int").repartition(5)
    got = ct.conversation_trie(df, openings=openings, shard_rows=shard, queue=queue).collect()
    assert {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in got} == brute_trie(rows, openings) and len(got) == len({(r["conv_id"], r["depth"]) for r in got})


def test_a_conversation_over_many_parts(spark):
    """One conversation holds most rows; its turns are dealt by ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one part
    try:
        check_parts(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def check_parts(spark):
    rows = [(1, k, "user", f"t{k}") for k in range(900)] + [(2, k, "user", f"t{k}") for k in range(450)] + [(3, 0, "user", "other")]
    turns = ct.keyed_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert turns.filter("conv_id = 1").select("part").distinct().count() > 1
    got = ct.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), shard_rows=100).collect()
    want = brute_trie_of_chains(rows)
    assert {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]) for r in got} == want


def brute_trie_of_chains(rows):
    size = lambda a, b: sum(len(f"t{k}") for k in range(a, b))
    out = {(1, 0): (None, 3, 2, 2, size(0, 450)), (3, 1): (1, 1, 0, 1, 0)}
    for d in range(1, 901):
        out[1, d] = (1, 2 if d <= 450 else 1, int(d < 900), 1, size(d - 1, 450) if d <= 450 else 0)
    return out


def test_trie_without_conversations(spark):
    df = spark.createDataFrame([(None, 1, "u", "x")], "conv_id long, turn long, role string, text string")
    assert ct.conversation_trie(df).count() == 0 and ct.conversation_trie(df.limit(0), openings=True).count() == 0


def test_spilling_queue():
    r = random.Random(2)
    q, want = ct.SpillingQueue(7), {}
    for _ in range(500):
        k = (r.randint(-5, -1), r.randint(0, 3), r.randint(-2, 2))
        v = [r.randint(0, 9) for _ in range(3)]
        q.push(*k, *v)
        want[k] = [a + b for a, b in zip(want.get(k, (0, 0, 0)), v, strict=True)]
    assert len(q.runs) > 3
    for k in sorted((a, b, c) for a in range(-5, 0) for b in range(4) for c in range(-2, 3)):
        assert list(q.take(*k)) == want.get(k, [0, 0, 0])


def test_pieces_of_a_long_list(spark):
    ids = list(range(990, 3100)) + [10**12]
    df = spark.createDataFrame([(1, 2, i) for i in ids] + [(5, 5, 7)], "p1 long, p2 long, conv_id long").repartition(6)
    got = {r["p1"]: r["ends_sha256"] for r in ct.list_digests(df).collect()}
    assert got == {1: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 5: hashlib.sha256(b"7").hexdigest()}


# --- periodic runs -------------------------------------------------------------------


def brute_runs(w, least=24):
    found = {}
    for p in range(1, len(w) // 3 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(least, 3 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e, p) for (s, e), p in found.items())


@pytest.mark.parametrize("scanned", [1, 5, pr.SCANNED])
def test_runs_of_words(scanned):
    r = random.Random(scanned)
    found = 0
    for _ in range(250):
        docs = []
        for _ in range(r.randint(1, 5)):
            w = [r.randrange(r.choice([1, 2, 3, 60])) for _ in range(r.randint(0, 300))]
            for _ in range(r.randint(0, 3) if len(w) > 5 else 0):
                a = r.randrange(len(w))
                p = 1 + r.randrange(max(1, (len(w) - a) // 3 + 1))
                e = min(len(w), a + 3 * p + r.choice([-1, 0, 1, p]))
                w = w[:a] + [w[a + (i - a) % p] for i in range(a, e)] + w[e:]
            docs.append(w)
        sizes = np.array([len(w) for w in docs])
        got = pr.find_runs(np.array([x for w in docs for x in w], np.int32), np.cumsum(sizes) - sizes, scanned=scanned)
        assert got == [brute_runs(w) for w in docs]
        found += sum(map(len, got))
    assert found > 200


def test_long_periods():
    r = random.Random(9)
    for p in (25, 26, 37, 38, 100, 999, 1000, 1001, 5000):
        base = [r.randrange(200) for _ in range(p)]
        w = [-1] * 3 + base * 3 + base[: p // 2] + [-2]
        assert pr.find_runs(np.array(w, np.int32), np.array([0])) == [[(3, 3 + 3 * p + p // 2, p)]]
        assert pr.find_runs(np.array(w[: 3 * p + 2], np.int32), np.array([0])) == [[]]  # one word less than three


def test_scales_cover_all_periods():
    at = pr.SCANNED + 1
    for least, most, gram, window in pr.scales(10**6, pr.SCANNED):
        assert least == at and gram >= most and window >= 1 and gram + window - 1 + least <= 3 * least
        at = most + 1
    assert 3 * at > 10**6


@pytest.mark.parametrize("chunk", [pr.CHUNK, 50])
def test_periodic_runs(spark, monkeypatch, chunk):
    monkeypatch.setattr(pr, "CHUNK", chunk)
    r = random.Random(6)
    texts = [" ".join(r.choice("ab c dd é x\u00a0y".split(" ")) for _ in range(r.randint(0, 200))) for _ in range(120)]
    texts += [None, "", " \t\n", "one " * 30, ("a b c d e " * 6).upper(), "w " * 20000, "\u2003 a\x1cb " * 30]
    rows = [(i if i % 9 else None, t, "z") for i, t in enumerate(texts)] + [(3, texts[3], "z")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = pr.run_digests(pr.periodic_runs(df, prepare=pr.with_planted_run)).collect()
    want = []
    for i, t, _ in rows:
        w = [x.decode() for x in pr.with_planted_run(i, [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")])]
        runs = brute_runs(w)
        gone = {k for s, e, p in runs for k in range(s + p, e)}
        best = min(((-Fraction(e - s, p), s, p, e - s) for s, e, p in runs), default=None)
        one = (best[1], best[3], best[2], 1000 * best[3] // best[2]) if best else (None,) * 4
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(runs), *one, sha("".join(f"{s},{e - s},{p}\n" for s, e, p in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and sum(x[1] for x in want) > 10
    assert pr.periodic_runs(df.limit(0)).count() == 0


def test_planted_run():
    for i in range(400):
        w = [str(k).encode() for k in range(i % 90)]
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        want = list(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            want = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        assert pr.with_planted_run(i, w) == want


# --- WARC ----------------------------------------------------------------------------


def pages(spark):
    big, other = "<p>é</p>" * 200, "<b>" + "x" * 997
    rows = [(1, "https://a.com/1", big), (2, None, big), (9, "https://a.com/9\r\nX: y", big), (3, "u", None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (7, "u", other), (8, "u", other[:-1]), (10, "u", other[:-1]),
            (None, "u", big), (None, "u", "y" * 5000), (None, "u", "y" * 5000), (11, "u", "z" * 300000), (11, "u", "z" * 300000), (12, "u", "WARC/1.1\r\n\r\n" * 100), (13, "u", other)]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, path string").repartition(3)


def test_warc_round_trip(spark):
    rows, df = pages(spark)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        lead = max(same) if len(data) >= 1000 and same and max(same) != page else None
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "response" if lead is None else "revisit", lead, None, True))
    assert sorted(map(repr, map(tuple, warc.warc_round_trip(df).collect()))) == sorted(map(repr, want))
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_archives_are_plain_warc(spark):
    """Read by another reader: one gzip member a record; revisits name their response."""
    rows, df = pages(spark)
    files = warc.write_archives(df, limit=900).collect()
    assert sum(f["n_records"] for f in files) == len(rows) and len(files) > 3
    ids, refers = set(), set()
    for f in files:
        data = open(f["path"].removeprefix("file:"), "rb").read()
        assert len(data) == f["n_bytes"] and data.count(b"\x1f\x8b\x08") >= f["n_records"] + 1
        whole = gzip.decompress(data)
        while whole:
            head, _, rest = whole.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            n = int(fields["Content-Length"])
            assert rest[n : n + 4] == b"\r\n\r\n" and fields["WARC-Block-Digest"] == warc.sha1_name(hashlib.sha1(rest[:n]).digest())
            whole = rest[n + 4 :]
            ids.add(fields["WARC-Record-ID"])
            refers |= {fields["WARC-Refers-To"]} if "WARC-Refers-To" in fields else set()
    assert refers and refers <= ids


def test_what_is_broken_is_told(spark, tmp_path):
    one = warc.page_record("1", "u", b"a" * 50, hashlib.sha1(b"a" * 50).hexdigest(), lead=None)
    bad = warc.page_record("2", "u", b"b" * 50, hashlib.sha1(b"c" * 50).hexdigest(), lead=None)  # says another digest
    wrong = gzip.compress(b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")
    twice = bytearray(one)
    twice[len(one) // 2] ^= 255
    cases = {"good": one + one, "digest": one + bad + one, "cut": one + one[:-20], "flipped": one + bytes(twice) + one, "length": one + wrong, "text": one + b"no gzip at all", "empty": b"", "headless": gzip.compress(b"hello")}
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    df = spark.createDataFrame([(str(tmp_path / n),) for n in cases], "path string")
    got = {}
    for r in warc.read_archives(df, with_payload=True).orderBy("path", "offset").collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["error"] is None, r["verified"], r["payload"]))
    ok = (True, True, bytearray(b"a" * 50))
    assert got == {"good": [ok, ok], "digest": [ok, (True, False, bytearray(b"b" * 50)), ok], "cut": [ok, (False, False, None)], "flipped": [ok, (False, False, None)], "length": [ok, (False, False, None)],
                   "text": [ok, (False, False, None)], "headless": [(False, False, None)]}


def test_members_of_any_size_are_read_piece_by_piece(monkeypatch):
    import io

    monkeypatch.setattr(warc, "PIECE", 7)
    data = [bytes([65 + k]) * (k * 37) for k in range(12)]
    source = io.BytesIO(b"".join(warc.page_record(str(k), "u", d, hashlib.sha1(d).hexdigest(), lead=None) for k, d in enumerate(data)))
    rows = list(warc.Reader(source, with_payload=True).records())
    assert [r["payload"] for r in rows] == data and all(r["verified"] for r in rows)
    source.seek(rows[5]["offset"])
    assert next(warc.Reader(source, with_payload=True).records())["page"] == "5"


def test_a_hot_payload(spark):
    df = spark.range(600).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, F.lit("h" * 1500)).otherwise(F.concat(F.lit("r" * 1200), "id")).alias("html"))
    got = warc.warc_round_trip(df).groupBy("record_type", "refers_to").count().collect()
    assert {(r["record_type"], r["refers_to"]): r["count"] for r in got} == {("response", None): 401, ("revisit", 597): 199}
