"""Operators on documents against brute force, on small tables with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from hostlens.llm import exact_dedup, grams, lm_scoring, mixing, near_dedup, quality, telephony
from hostlens.llm.grams import chunks, counted, shingles
from hostlens.llm.line_dedup import apply_bitmaps, line_bitmaps, line_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, kept string, size string, class_id string, score string"
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def texts():
    r = random.Random(7)
    words = "alpha beta Gamma delta É é straße ÜBER one two three four five six seven eight".split()
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = "This line stands in many documents, says the É one."
    out = [None, "", " ", "\n", "a\n\nb", "AB", "ab", "Äb", "äb", "x" * 5000, shared, f"  {shared.upper()}\t\n{shared}\nshort\nshort", "a\r\nb\x0b", "日本語 " * 40, "😀\x00"]
    out += [say(40) + "\n" + shared + "\n" + say(r.randint(0, 20)) for _ in range(30)]
    out += [out[20]] * 12 + [out[21].upper(), out[21]]
    base = say(400).split()
    for k in range(12):  # near copies
        w = list(base)
        w[7 * k + 3] = f"changed{k}"
        out.append(" ".join(w))
    out.append("\n".join(say(6) for _ in range(3000)))
    return out


def frame(spark, rows=None):
    rows = [(i, t, "en", [None, "s1", "s2", "s10"][i % 4], None) for i, t in enumerate(texts())] if rows is None else rows
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def test_exact_dedup(docs, empty):
    norm = {i: (t or "").translate(LOWER) for i, t in enumerate(texts())}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    for keep, best in (("largest", max), ("smallest", min)):
        got = {r["doc_id"]: tuple(r)[1:] for r in exact_dedup.exact_dedup(docs, keep=keep).collect()}
        assert got == {i: (best(groups[t]), len(groups[t]), best(groups[t]) == i, sha(t)) for i, t in norm.items()}
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_survives_collisions(docs):
    weak = lambda t: F.unhex(F.concat(F.substring(F.md5(t), 1, 1), F.lit("0")))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(exact_dedup.exact_dedup(docs, content_hash=weak)) == key(exact_dedup.exact_dedup(docs))


def test_exact_dedup_null_and_repeated_ids(spark):
    d = frame(spark, [(None, "A", None, None, None), (None, "a", None, None, None), (3, "a", None, None, None), (3, "a", None, None, None), (None, "b", None, None, None)])
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(d).collect())
    assert got == {(None, 3, 4, False): 2, (3, 3, 4, True): 2, (None, None, 1, True): 1}


def brute_lines(rows, least=10):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    first = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                first[key(x)] = min(first.get(key(x), i), i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or first[key(x)] == i]
        out[i] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


@pytest.mark.parametrize("hot", [2000, 3])
def test_line_dedup(docs, empty, monkeypatch, hot):
    monkeypatch.setattr("hostlens.llm.line_dedup.HOT_LEAST", hot)  # 3: the shared line is dealt into slots
    got = {r["doc_id"]: tuple(r)[1:] for r in line_dedup(docs).collect()}
    assert got == brute_lines(list(enumerate(texts())))
    assert line_dedup(empty).count() == 0
    again = apply_bitmaps(docs, line_bitmaps(docs))
    assert again.count() == docs.count() and set(docs.columns) <= set(again.columns)
    clash = docs.withColumns({"_lines": F.lit("x"), "_th": F.lit("y"), "n_lines": F.lit(-1)})
    again = apply_bitmaps(clash, line_bitmaps(docs)).collect()
    assert all(r["_lines"] == "x" and r["_th"] == "y" and r["n_lines"] >= 1 for r in again) and sum(r["n_dropped"] for r in again) > 0


def test_telephony(docs, empty):
    rows = {r["doc_id"]: r for r in telephony.telephony(docs, with_media=True, with_pcm=True).collect()}
    for i, t in enumerate(texts()):
        raw = (t or "").encode()
        pay = raw + b" " * (max(-(-len(raw) // 192), 1) * 192 - len(raw))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))
        tag, rate, _, data = telephony.read_wave(bytes(r["media"]))
        rate2, pcm = telephony.to_pcm(bytes(r["pcm"]))
        mu = telephony.MULAW_PCM[np.frombuffer(pay, np.uint8)].astype(int)
        assert rate2 == 16000 and (pcm[::2] == mu).all() and r["pcm_sha256"] == hashlib.sha256(r["pcm"]).hexdigest() and r["pcm_bytes"] == len(r["pcm"])
        x = np.concatenate((mu[:1], mu, mu[-1:], mu[-1:]))  # odd samples: the filter, one by one
        assert pcm[1::2].tolist() == [max(-32768, min(32767, (9 * (x[k + 1] + x[k + 2]) - x[k] - x[k + 3] + 8) >> 4)) for k in range(len(mu))]
        said = r["feature"].split()
        a = telephony.ALAW_PCM[np.frombuffer(pay, np.uint8)].astype(int)
        ima = telephony.decode_ima(np.frombuffer(pay, np.uint8).reshape(-1, 192)).astype(int)
        assert said == ["mulaw", str((mu**2).sum() // len(mu)), str(abs(mu).max()), str(((mu[1:] < 0) != (mu[:-1] < 0)).sum()), "alaw", str((a**2).sum() // len(a)), "ima", str((ima**2).sum() // ima.size)]
        assert bytes(data) == pay and (tag, rate) == (telephony.MULAW, 8000) and r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
    same = defaultdict(set)
    for i, t in enumerate(texts()):
        same[t or ""].add((rows[i]["feature"], rows[i]["pcm_sha256"]))
    assert all(len(x) == 1 for x in same.values()) and telephony.telephony(empty).count() == 0


def test_long_audio_goes_piece_by_piece(monkeypatch):
    texts_ = ["long text, said again. " * 400, "short", ""]
    files = [telephony.stored(t)[1] for t in texts_]
    whole = telephony.features(files)
    monkeypatch.setattr(telephony, "CHUNK", 1920)
    assert [telephony.features([f])[0] for f in files] == whole


def test_companding_and_adpcm(spark):
    # G.711: known codes, symmetry, monotony
    mu, a = telephony.MULAW_PCM.astype(int), telephony.ALAW_PCM.astype(int)
    assert (mu[0x00], mu[0x80], mu[0xFF], mu[0x7F]) == (-32124, 32124, 0, 0) and (a[0xD5], a[0x55], a[0x2A], a[0xAA]) == (8, -8, -32256, 32256)
    assert (mu[:128] == -mu[128:]).all() and (np.diff(mu[128:]) <= 0).all() and len(set(a)) == 256

    def one(block):  # sample by sample, as the format is defined
        v, i = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
        out = [v]
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(telephony.IMA_STEPS[i])
                move = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                v = max(-32768, min(32767, v - move if code & 8 else v + move))
                i = max(0, min(88, i + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
                out.append(v)
        return out

    blocks = np.random.default_rng(1).integers(0, 256, (20, 64), dtype=np.uint8)
    assert (telephony.decode_ima(blocks) == [one(bytes(b)) for b in blocks]).all()
    f = telephony.wave(bytes(blocks[0]), telephony.IMA, 8000, 4, 64)
    bad = spark.createDataFrame([(1, bytearray(f)), (2, bytearray(b"no")), (3, None)], "doc_id int, media binary")
    got = {r["doc_id"]: r for r in telephony.resample_media(bad).collect()}
    rate, pcm = telephony.to_pcm(bytes(got[1]["pcm"]))
    assert rate == 16000 and (pcm[::2] == one(bytes(blocks[0]))).all() and got[2]["error"] and got[3]["pcm"] is None


def test_targets_of_many_sources(spark):
    """Sources as many as hosts, in any order, some of them empty: filled up by weight."""
    r = random.Random(3)
    size = {f"s{r.randrange(10**6)}": r.choice([0, 1, 7, 500, 10**6]) * r.randrange(1, 9) for _ in range(3000)} | {"n": 123456}
    order = [*sorted(set(size) - {"n"}), "n"]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, todo, want = 1.5 * sum(size.values()), set(order), {}
    while over := {s for s in todo if left / sum(weight[x] for x in todo) * weight[s] > 2 * size[s]}:
        want |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        todo -= over
    want |= {s: left / sum(weight[x] for x in todo) * weight[s] for s in todo}
    totals = spark.createDataFrame([(s, s == "n", n) for s, n in size.items()], "_s string, _null boolean, source_size long").repartition(5)
    got = {x["_s"]: x["target"] for x in mixing.source_targets(totals, weights=(5, 2, 1), share=1.5, most=2).collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[s], want[s], rtol=1e-9) for s in want)
    assert mixing.source_targets(totals.limit(0), weights=(5, 2, 1), share=1.5, most=2).count() == 0


def test_mix(docs, empty):
    rows = mixing.mix(docs).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts())}
    assert {r["doc_id"]: r["size"] for r in rows} == size
    by = defaultdict(int)
    for i, n in size.items():
        by[[None, "s1", "s2", "s10"][i % 4]] += n
    order = ["s1", "s10", "s2", None]
    weight = dict(zip(order, (5, 2, 1, 5), strict=True))
    left, todo, target = 1.5 * sum(by.values()), set(order), {}
    while todo:
        level = left / sum(weight[s] for s in todo)
        over = {s for s in todo if level * weight[s] > 2 * by[s]}
        if not over:
            target |= {s: level * weight[s] for s in todo}
            break
        target |= {s: 2.0 * by[s] for s in over}
        left -= sum(2 * by[s] for s in over)
        todo -= over
    taken, longest = Counter(), Counter()
    for r in rows:
        s = [None, "s1", "s2", "s10"][r["doc_id"] % 4]
        assert r["source_size"] == by[s] and abs(r["target"] - target[s]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
        longest[s] = max(longest[s], r["size"])
    # whole copies can't meet a target better where one document is most of its source
    assert all(abs(taken[s] - target[s]) <= max(20, 0.02 * target[s], longest[s] / 2 if longest[s] > by[s] / 2 else 0) for s in order), (taken, target)
    assert sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()), key=repr) == sorted(map(tuple, rows), key=repr)
    assert mixing.mix(empty).count() == 0


def test_shingles_and_words():
    ts = texts()
    names = {}
    for at, words, bounds in chunks(pa.array(ts)):
        h, rows = shingles(words, bounds)
        for i in range(len(bounds) - 1):
            w = re.findall(r"[^\x20\x09-\x0D]+", (ts[at + i] or "").lower())
            want = [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] * bool(w)
            got = h[rows == i].tolist()
            assert len(got) == len(want) and all(names.setdefault(x, g) == g for x, g in zip(want, got, strict=True))
    assert len(set(names.values())) == len(names)


def test_samples_agree_as_often_as_weights():
    r = np.random.default_rng(3)
    h = r.integers(0, 1 << 63, 400).astype(np.uint64)
    a, b = np.sort(h[:300]), np.sort(h[100:])
    wa, wb = r.uniform(0.5, 4, 300).astype(np.float32), r.uniform(0.5, 4, 300).astype(np.float32)
    want = near_dedup.similarity((a, wa), (b, wb))
    n = 4000
    got = (near_dedup.samples(a, wa, np.array([0]), n) == near_dedup.samples(b, wb, np.array([0]), n)).mean()
    assert abs(got - want) < 4 * (want * (1 - want) / n) ** 0.5 + 0.005


def spans(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] * bool(w)


def test_near_classes(docs, empty, spark):
    ts = texts()

    bags = {i: Counter(spans(t)) for i, t in enumerate(ts)}
    frequent = dict(zip(*map(np.ndarray.tolist, near_dedup.frequent_shingles(docs.select(F.coalesce("text", F.lit("")).alias("t")), len(ts))), strict=True))
    names = {}
    for at, words, bounds in chunks(pa.array(ts)):
        h, rows = shingles(words, bounds)
        for i in range(len(bounds) - 1):
            names |= dict(zip(spans(ts[at + i]), h[rows == i].tolist(), strict=True))
    idf = {s: frequent.get(names[s], np.log1p(1 / near_dedup.FLOOR)) for b in bags.values() for s in b}
    assert len({round(x, 3) for x in idf.values()}) > 3  # words that many documents say weigh less
    up = {i: i for i in bags}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    reps = {}
    for i, t in enumerate(ts):
        reps.setdefault(t or "", i)
    for i, t in enumerate(ts):
        up[root(i)] = root(reps[t or ""])
    for i in reps.values():
        for j in reps.values():
            if i < j and bags[i] and bags[j]:
                both = sum(min(n, bags[j][s]) * idf[s] for s, n in bags[i].items())
                total = sum(n * idf[s] for b in (bags[i], bags[j]) for s, n in b.items()) - both
                if both / total >= 0.8:
                    up[max(root(i), root(j))] = min(root(i), root(j))
    least = defaultdict(list)
    for i in bags:
        least[root(i)].append(i)
    want = {i: min(x) for x in least.values() for i in x}
    rows = near_dedup.near_classes(docs).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == want and all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in rows)
    assert near_dedup.near_classes(empty).count() == 0
    same = "one two three four five six"
    odd = frame(spark, [(None, same, None, None, None), (4, same, None, None, None), (4, same, None, None, None), (None, None, None, None, None), (None, "", None, None, None), (7, "", None, "s", None)])
    got = near_dedup.near_classes(odd.filter("doc_id is null or doc_id < 7")).collect()
    assert sorted((r["doc_id"] is None, r["class_id"] == 4, r["kept"]) for r in got) == [(False, True, False), (False, True, True), (True, False, False), (True, False, True), (True, True, False)]
    carried = near_dedup.near_classes(odd, keep=["source", "doc_id"]).filter("kept").select("row.*").collect()
    assert sorted(map(tuple, carried), key=repr) == [("s", 7), (None, 4)]


def test_linked_members_of_a_large_group(spark):
    """Many texts share a passage at just under 0.8; some pairs of them are near copies."""
    passage = [f"p{k}" for k in range(300)]
    say = lambda name, n: [f"{name}x{k}" for k in range(n)]
    docs = {i: passage + say(f"own{i}", 44) for i in range(20)} | {500 + i: passage + say(f"own{500 + i}", 44) for i in range(20)}
    docs |= {100 + 2 * j + k: passage + say(f"pair{j}", 26) + say(f"half{j}_{k}", 18) for j in range(16) for k in range(2)}
    docs |= {1000 + i: say(f"filler{i}", 6) for i in range(260)}
    bags = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in docs.items()}
    near = lambda i, j: len(bags[i] & bags[j]) / len(bags[i] | bags[j]) >= 0.8
    ids = [i for i in docs if i < 1000]
    assert {(i, j) for i in ids for j in ids if i < j and near(i, j)} == {(100 + 2 * j, 101 + 2 * j) for j in range(16)}
    rows = near_dedup.near_classes(frame(spark, [(i, " ".join(w), None, None, None) for i, w in docs.items()])).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == {i: i - 1 if 100 <= i < 132 and i % 2 else i for i in docs}


def test_frequent_shingles(spark):
    """By documents, of which near and exact copies together are about one."""
    say = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    common = "often said by very many documents here"
    rows = [f"{say(i, 30)} {common if i < 400 else say(-1 - i, 3)} {say(-3000 - i, 30)}" for i in range(2000)]
    base = say(5000, 200).split()
    rows += [" ".join([*base[: k % 190], f"new{k}", *base[k % 190 + 1 :]]) for k in range(300)] + [say(6000, 20)] * 200
    d = spark.createDataFrame([(x,) for x in rows], "t string").repartition(7)
    h, idf = near_dedup.frequent_shingles(d, len(rows))
    share = dict(zip(h.tolist(), (1 / np.expm1(idf)).tolist(), strict=True))
    names = {}
    for _, words, bounds in chunks(pa.array([common, " ".join(base), say(6000, 20)])):
        hs, of = shingles(words, bounds)
        names |= {k: hs[of == k].tolist() for k in range(3)}
    assert all(abs(share[x] - 400 / 2500) < 0.02 for x in names[0])
    assert all(share.get(x, 0) < 10 / 2500 for x in names[1]) and not set(names[2]) & share.keys()
    plain = spark.createDataFrame([(x,) for x in rows[:2000]], "t string").repartition(3)
    h, idf = near_dedup.frequent_shingles(plain, 2000)
    df = Counter(x for t in rows[:2000] for x in set(spans(t)))
    assert len(h) == sum(n > 2 for n in df.values()) == 3 and np.allclose(np.expm1(idf), 5, rtol=0.1)


def test_recall_on_given_tables(spark):
    """Near copies of every fifth document, found by comparing it with all others."""
    try:
        d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").cache()
    except Exception:
        pytest.skip("no tables here")
    rows = d.collect()
    weights = near_dedup.Weights(*near_dedup.frequent_shingles(d.select(F.col("text").alias("t")), len(rows)))
    held = {}
    for at, words, bounds in chunks(pa.array([r["text"] for r in rows])):
        h, of, tf = counted(*shingles(words, bounds))
        for i in range(len(bounds) - 1):
            held[rows[at + i]["doc_id"]] = h[of == i], weights(h[of == i], tf[of == i])
    cls = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(d).collect()}
    near = [(i, j) for i in held if i % 5 == 0 for j in held if i != j and near_dedup.similarity(held[i], held[j]) >= 0.8]
    assert len(near) > 5 and np.mean([cls[i] == cls[j] for i, j in near]) >= 0.9


def test_words_of_very_long_texts(monkeypatch):
    """Hashed piece by piece; a word may be longer than a piece."""
    ts = [t or "" for t in texts()] + ["y" * 700 + " z " + "é" * 333, " ".join(["w"] * 500)]
    whole = np.concatenate([w for _, w, _ in chunks(pa.array(ts))])
    monkeypatch.setattr(grams, "CHUNK", 64)
    monkeypatch.setattr(grams, "_powers", [])
    parts = list(chunks(pa.array(ts)))
    assert len(parts) > 5 and (np.concatenate([w for _, w, _ in parts]) == whole).all()


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)]
    up = {x: x for e in edges for x in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    got = {x["node"]: x["least"] for x in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {x: min(y for y in up if root(y) == root(x)) for x in up}
    assert got == {x: m for x, m in least.items() if x != m}


def brute_losses(said, own, raw):
    """Mean bits of each text: target, then background, by the models' definition; a text is
    in neither model that scores it."""
    m, a = lm_scoring.PAIR_PRIOR, lm_scoring.WORD_PRIOR
    words = lambda ids: sum(len(said[i]) for i in ids)
    n, nt = words(said), words(own)
    bound = int(min(1.0, nt / n) * 2**32) if nt else 2**32
    near = {i for i in said if xxhash.xxh64(raw[i].encode(), seed=42).intdigest() & 0xFFFFFFFF < bound}
    nb, v = words(near), len({x for w in said.values() for x in w})
    models = []
    for ids in (own, near):
        uni, bi, ahead = Counter(), Counter(), Counter()
        for i in ids:
            uni.update(said[i])
            bi.update(zip([None, *said[i]], said[i], strict=False))
            ahead.update([None, *said[i]][: len(said[i])])
        models.append((set(ids), uni, bi, ahead))
    scale = [1.0, nt / nb if nt and nb else 1.0]
    out = {}
    for i, w in said.items():
        bits = []
        for (ids, uni, bi, ahead), k in zip(models, scale, strict=True):
            pairs = list(zip([None, *w], w, strict=False))
            less = lambda c, mine: Counter({x: c[x] - mine[x] for x in c}) if i in ids else c  # noqa: E731, B023
            u, b, h = less(uni, Counter(w)), less(bi, Counter(pairs)), less(ahead, Counter([None, *w][: len(w)]))
            all_ = sum(u.values())
            p = lambda x, y: (b[x, y] * k + m * (u[y] * k + a) / (all_ * k + a * v)) / (h[x] * k + m)  # noqa: E731, B023
            if w and i % 9 == 0:  # a proper model: it sums up to one
                assert np.isclose(sum(p(w[0], y) for y in {x for s in said.values() for x in s}), 1)
            bits.append(-np.mean([np.log2(p(x, y)) for x, y in pairs]) if w else 0.0)
        out[i] = bits
    return out


@pytest.mark.parametrize("small", [0, 1 << 16, 4])
def test_lm_scoring(docs, empty, spark, monkeypatch, small):
    if small:  # long texts are several runs, and keys are dealt into many buckets; runs in one group or several
        for name, value in (("RUN", 700), ("BUCKET", 50), ("GROUP", small)):
            monkeypatch.setattr(lm_scoring, name, value)
    said = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for i, t in enumerate(texts())}
    target = spark.createDataFrame([(i,) for i in range(15, 30)] + [(None,), (15,)], "doc_id long")
    for ids, own in ((target, set(range(15, 30))), (target.limit(0), set())):
        want = brute_losses(said, own, dict(enumerate(t or "" for t in texts())))
        rows = lm_scoring.cross_entropy_difference(docs, ids).collect()
        assert len(rows) == len(said)
        for r in rows:
            t, b = want[r["doc_id"]]
            assert r["n_tokens"] == len(said[r["doc_id"]]) and np.allclose([r["target_loss"], r["background_loss"], r["score"]], [t, b, t - b], rtol=1e-4, atol=1e-4)
    assert lm_scoring.cross_entropy_difference(empty, target).count() == 0
    odd = frame(spark, [(None, "a b", None, None, None), (None, "a c c", None, None, None), (3, "a b", None, None, None), (3, "a b", None, None, None)])
    got = lm_scoring.cross_entropy_difference(odd, target).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 2), (0, 3), (3, 2), (3, 2)] and len({r["score"] for r in got if r["n_tokens"] == 2}) == 1


def test_members_of_the_target_have_no_advantage(spark):
    """Two halves of one class score alike, and the other class does not."""
    r = random.Random(5)
    good, bad = [[f"{c}{k}" for k in range(400)] for c in "gb"]
    text = lambda own, other: " ".join(r.choice(own if r.random() < 0.8 else other) for _ in range(60))
    rows = [(i, text(good, bad) if i < 400 else text(bad, good), None, None, None) for i in range(800)]
    target = spark.createDataFrame([(i,) for i in range(0, 400, 2)], "doc_id long")
    score = {x["doc_id"]: x["score"] for x in lm_scoring.cross_entropy_difference(frame(spark, rows), target).collect()}
    y = [i % 2 for i in range(400)]
    assert 0.45 <= rank_auc(np.array([score[i] for i in range(400)]), np.array(y)) <= 0.55
    unseen = [i for i in range(1, 400, 2)] + list(range(400, 800))
    assert rank_auc(np.array([score[i] for i in unseen]), np.array([int(i >= 400) for i in unseen])) > 0.9


def test_quality(spark, empty):
    r = random.Random(2)
    good = lambda: " ".join(r.choice("the of and quiet river under stone bridge morning light walked home slowly".split()) for _ in range(60)) + "."
    bad = lambda: " ".join(r.choice("BUY!! NOW!! $$$ CLICK*** WIN### FREE&&&".split()) for _ in range(60))
    rows = [(i, good() if i % 4 else bad(), None, None, None) for i in range(400)] + [(1000, None, None, None, None), (None, "", None, None, None)]
    d = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 400)] + [(None, 1), (5, None)], "doc_id long, quality int")
    out = {x["doc_id"]: x for x in quality.quality_scores(d, labels).collect()}
    assert len(out) == 402 and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in out.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i]["held_out"] == (i in held) for i in range(400)) and out[1000]["score"] == out[None]["score"]
    assert np.mean([out[i]["predicted"] == int(i % 4 > 0) for i in held]) > 0.95
    assert quality.quality_scores(empty, labels).count() == 0
    alone = quality.quality_scores(d, labels.filter("quality = 1")).collect()
    assert all(x["predicted"] == 1 for x in alone)


def rank_auc(score, y):
    score, y = np.asarray(score), np.asarray(y)
    return np.mean([(a > b) + (a == b) / 2 for a in score[y == 1] for b in score[y == 0]])


def test_quality_is_the_calibrated_difference(spark):
    """Every score again, from the dictionaries; held-out labels; long texts differ too."""
    try:
        d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    except Exception:
        pytest.skip("no tables here")
    m = quality.train(d, labels)
    packers = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(x), write_content_size=False) for x in (m.good, m.bad)]
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality.score(d.select("doc_id", "text"), m).collect()
    for r in rows:
        raw = r["text"].encode()
        good, bad = (len(p.compress(raw)) for p in packers)
        assert abs(r["score"] - 1 / (1 + np.exp(-((bad - good) / (len(raw) + 1) * m.weight + m.offset)))) < 1e-6
    assert m.weight > 0
    held = [r for r in rows if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert rank_auc([r["score"] for r in held], [truth[r["doc_id"]] for r in held]) > 0.85
    long = d.withColumn("text", F.repeat(F.concat("text", F.lit(" ")), 12))
    assert quality.quality_scores(long, labels).select(F.countDistinct("score")).first()[0] > 500


def test_scores_do_not_depend_on_held_out_labels(spark):
    d = frame(spark, [(i, f"text number {i} " * 5, None, None, None) for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    flipped = labels.withColumn("quality", F.when(quality.is_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    key = lambda x: sorted(map(tuple, x.collect()))
    assert key(quality.quality_scores(d, labels)) == key(quality.quality_scores(d, flipped))


def test_dictionary_of_little_text():
    assert quality.train_dictionary([b"ab"]) == b"ab" and zstandard.__version__


def test_rare_shingles_are_not_shuffled(spark, monkeypatch):
    """Counting in cells first leaves out most shingles, and loses none that is frequent."""
    monkeypatch.setattr(near_dedup, "FLOOR", 0.01)
    common = ["one two three four five six", "a very common line of words here"]
    texts = [" ".join(f"w{k}x{j}" for j in range(40)) + " " + common[k % 2] for k in range(400)]
    texts = spark.createDataFrame([(x,) for x in texts], "t string").repartition(3)
    words = lambda x: (" ".join(x[i : i + 5]) for i in range(len(x) - 4))
    told = {}
    for (x,) in texts.collect():
        for s in set(words(x.split())):
            told[s] = told.get(s, 0) + 1
    cells = texts.mapInArrow(near_dedup._cells, "part int, counts binary").groupBy("part").applyInArrow(near_dedup._full(4), "part int, full binary")
    full = {r["part"]: bytes(r["full"]) for r in cells.collect()}
    sent = texts.mapInArrow(near_dedup._seen(full), "h long, n long").groupBy("h").agg({"n": "sum"}).toDF("h", "n")
    assert sent.count() < len(told) / 20
    frequent = sum(n > 4 for n in told.values())
    assert sent.filter("n > 4").count() == frequent == len(near_dedup.frequent_shingles(texts, 400)[0]) > 0
