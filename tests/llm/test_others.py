"""Tokenizer, URL filters, HTML and the pipeline."""

import hashlib
import html
import random
import re
import time

import pytest

from hostlens.llm import html_text, url_filters
from hostlens.llm.queries import HOST_RULES, PATTERNS, model_path
from hostlens.llm.sentencepiece_bpe import Coder, encode_documents, load_pieces

try:
    MODEL = model_path()
except ImportError:
    MODEL = None
needs_model = pytest.mark.skipif(MODEL is None, reason="no tokenizer files here")


@pytest.fixture(scope="module")
def coder():
    return Coder(load_pieces(MODEL))


@needs_model
def test_same_as_library(coder):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    r = random.Random(1)
    parts = ["a", "e", "the", "ing", " ", "  ", "\n", "é", "ß", "😀", "0", "12", "!!", "***", "▁", "\t", "公", "<s>", "<0x41>", "\x00", "ｱ", "er", "on", "    ", "ا", "²", ".", "http", "_", "x" * 40]
    for _ in range(6000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        ids = sp.encode(t)
        assert coder.encode(t) == ids and coder.decode(ids) == sp.decode(ids) and coder.text(t)[1] == sp.decode(ids)


@needs_model
def test_pairs_meet_as_defined(coder):
    r = random.Random(2)
    pieces = list(coder.ids)
    for _ in range(20000):
        w = r.choice(pieces)
        k = r.randint(1, len(w))
        a, b = (w[:k], w[k:]) if r.random() < 0.4 else (w, r.choice(pieces))
        if a in coder.ids and b in coder.ids:
            assert coder.meets(a, b) == (coder.merged(a + b) == [a, b])


@needs_model
def test_what_is_decoded_comes_from_the_ids():
    c = Coder(load_pieces(MODEL))
    csv, ids, decoded = c.round_trip("two words")
    assert decoded == "two words" and csv == ",".join(map(str, ids)) and c.round_trip("") == ("", [], "")
    c.bytes[ids[-1]] = b"?"  # an id that means something else shows
    assert c.round_trip("two words")[2] == c.decode(ids) != "two words"


@needs_model
def test_encode_documents(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(1, "Hello  world\n"), (2, None), (2, None), (None, ""), (4, "word " * 30000), (5, "x" * 20000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_tokens string")
    for r in encode_documents(df, MODEL, with_ids=True).collect():
        t = next(x or "" for i, x in rows if i == r["doc_id"])
        ids = sp.encode(t)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == sp.decode(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert encode_documents(df.limit(0), MODEL).count() == 0


URLS = [
    ("https://m.a.example.net/en/25#top", "m.a.example.net", "/en/25", "example.net/en/", "allow"), ("http://EXAMPLE.net/de/1", "example.net", "/de/1", "net/", "block"),
    ("https://x.example.com/de/", "x.example.com", "/de/", "example.com/de/", "block"), ("https://x.example.com/DE/", "x.example.com", "/DE/", None, "allow"), ("https://a.org/fr/x?y", "a.org", "/fr/x", "org/fr/", "allow"),
    ("https://a.org/fr", "a.org", "/fr", None, "allow"), ("https://a.net", "a.net", "", None, "allow"), ("https://notexample.net/en/", "notexample.net", "/en/", "net/", "block"), ("x.net/en/", "", "", None, "allow"),
    (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("https://www.casino-win.example.org/en/1", "www.casino-win.example.org", "/en/1", None, "block"), ("https://m.casino-win.example.org/fr/1", "m.casino-win.example.org", "/fr/1", "org/fr/", "allow"),
    ("http://É.net:80/a", "É.net:80", "/a", None, "allow"),
]


def test_url_filters(spark):
    rules = [url_filters.host_rule(*r) for r in HOST_RULES] + [url_filters.pattern_rule(*r) for r in PATTERNS]
    df = spark.createDataFrame([(i, u[0], "x", "x") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, verdict string")
    got = url_filters.filter_urls(df, rules).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        assert (r["url"], r["host"], r["path"], r["rule"], r["verdict"]) == URLS[r["page_id"] % len(URLS)]
    assert url_filters.filter_urls(df.limit(0), rules).count() == 0
    assert url_filters.filter_urls(df, rules[:1]).filter("rule is not null").select("rule").distinct().count() == 1


def test_thousands_of_rules(spark):
    """The index gives the same as trying every rule on every url."""
    r = random.Random(9)
    lines = ["# a list", ""] + [f"{r.choice(['allow', 'block'])} h{r.randint(0, 900)}.{r.choice(['com', 'net'])}/{r.choice(['', 'en/', 'de/x', 'a'])}" for _ in range(3000)]
    lines += [f"block ^w{k}^" for k in range(0, 1000, 7)] + [f"block ^w{k}^*zz" for k in range(5)] + ["allow ^w7^"]
    rules = url_filters.parse_rules(lines)
    urls = [f"https://{r.choice(['', 'm.', 'w14.'])}h{r.randint(0, 999)}.{r.choice(['com', 'net', 'org'])}/{r.choice(['en/', 'de/x', 'ab', ''])}{r.choice(['', '/w21', '-w1.zz', 'w21'])}?q" for _ in range(400)]
    got = {x["url"]: (x["rule"], x["verdict"]) for x in url_filters.filter_urls(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()}
    for u in urls:
        at = u.split("://")[1].split("?")[0]
        host, path = at.split("/", 1)[0], "/" + at.split("/", 1)[1]
        fit = [x for x in rules if x["kind"] == "host" and (host == x["rule"].split("/")[0] or host.endswith("." + x["rule"].split("/")[0])) and path.startswith("/" + x["rule"].split("/", 1)[1])]
        best = min(fit, key=lambda x: (-len(x["rule"]), x["rule"], x["verdict"])) if fit else None
        hits = [x["verdict"] for x in rules if x["kind"] == "pattern" and re.search(x["regex"], at)]
        assert got[u] == ((best["rule"], best["verdict"]) if best else (None, max(hits, default="allow")))
    with pytest.raises(ValueError, match="no rule"):
        url_filters.parse_rules(["deny x/"])


def test_rules_need_a_token(spark):
    with pytest.raises(ValueError, match="literal"):
        url_filters.rules_table(spark, [url_filters.pattern_rule("*", "block")])


def text_of(page, templates=frozenset()):
    root = html_text.parse(page)
    html_text.hash_subtrees(root)
    return html_text.main_text(root, templates)


PAGES = [
    ("", ""), ("plain", "plain"), ("<article><h1>A&amp;B</h1><p>x<b>y</b>z<br>w<p> two\n\n words</article>", "A&B xyz w two words"),
    ("<nav>n</nav><div class='ad'>buy</div><article><p>t</p></article><footer>f", "t"), ("<article>a<script>var t='</p>';</script><style>x</style>b</article>", "ab"),
    ("<body><div>one</div><div class='sidebar'>no</div><form><p>no</form><p>two", "one no two"), ("<article>a<div class='comments'>c</div></article>", "a c"), ("<article>1 &lt; 2 &#65; &amp;lt;</article>", "1 < 2 A &lt;"),
    ("<p title='a>b'>q</p>", "q"), ("<!-- <p>c</p> --><p>d</p>", "d"), ("<ul><li>a<li>b</ul>", "a b"), ("<article>x<header>h</header></article>", "x h"), ("<script>never closed <p>x", ""),
    ("<main><article>a</article><aside>b</aside>c</main>", "a c"), ("</div><p>a</div>b", "ab"),
]


@pytest.mark.parametrize("at", range(len(PAGES)))
def test_main_text(at):
    assert text_of(PAGES[at][0]) == PAGES[at][1]


def test_templates_of_a_host_go(spark):
    rows = [(i, f"https://a.com/{i}", f"<body><div>Same box on each page</div><div>Own text {i}</div><article></article></body>".replace("<article></article>", "")) for i in range(12)]
    rows += [(50 + i, f"https://b{i}.com/", "<body><div>Same box on each page</div></body>") for i in range(6)]
    rows += [(80 + i, "https://c.com/", "<nav>n</nav><article><p>Shared passage</p></article>") for i in range(9)]
    rows += [(90, None, None), (91, "https://a.com/x", "<p>" + "long " * 50000), (None, "https://a.com/x", "<article>t</article>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_text.extract_text(df).collect()}
    assert all(got[i]["text"] == f"Own text {i}" for i in range(12)) and all(got[50 + i]["text"] == "Same box on each page" for i in range(6))
    assert all(got[80 + i]["text"] == "Shared passage" for i in range(9)) and got[90]["text"] == "" and got[91]["n_chars"] == 5 * 50000 - 1 and got[None]["text"] == "t"
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_counts_decide_about_slots(spark):
    """A name alone deletes nothing where pages can be counted; a recurring shell goes, whatever it holds."""
    page = "<main><p>Own {0}</p><div class='comments'><p>reader {0} said</p></div><p>End {0}</p></main>"
    rows = [(i, f"https://a.com/{i}", page.format(i)) for i in range(12)]
    rows += [(50, "https://a.com/50", "<main><p>x</p><section class='related work'><p>cited by the author</p></section></main>")]
    rows += [(60, "https://b.com/1", page.format(60))]  # too few pages to count: all that HTML does not mark stays
    rows += [(100 + i, f"https://c.com/{'s' if i < 40 else 'o'}/{i}", f"<body><div>text {i}</div>{'<div>Menu of a section</div>' if i in range(12) else ''}</body>") for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()}
    assert all(got[i] == f"Own {i} End {i}" for i in range(12)) and got[50] == "x cited by the author" and got[60] == "Own 60 reader 60 said End 60"
    assert all(got[100 + i] == f"text {i}" for i in range(400))  # 12 of 400 pages, but of 40 in the section
    never = {r["page_id"]: r["text"] for r in html_text.extract_text(df, min_pages=10**6).collect()}
    assert "Menu of a section" in never[100]  # without templates the result is another


def test_templates_are_those_of_a_full_count(spark):
    """Subtrees of some hundred pages counted by dicts, by host and by section."""
    r = random.Random(3)
    boxes = [f"<div class='b{k}'><p>box {k}</p></div>" for k in range(12)]
    rows = []
    for i in range(300):
        host, section = r.choice(["a.com", "a.com", "b.org", f"c{i % 40}.net"]), r.choice(["", "x/", "x/", "y/"])
        inner = "".join(r.sample(boxes, r.randint(0, 3)))
        body = "".join(r.sample(boxes, r.randint(0, 3))) + r.choice(["", f"<main><p>own {r.randint(0, 5)}</p>{inner}</main>"]) + "<aside class='comments'>c</aside>" * r.randint(0, 1)
        rows.append((host, section.strip("/"), f"<body>{body}</body>"))
    want = {True: {}, False: {}}
    for by_section in want:
        groups = {}
        for host, section, page in rows:
            groups.setdefault((host, section) if by_section else (host,), []).append(page)
        for group, pages in groups.items():
            outside, inside = {}, {}
            for page in pages:
                every = html_text.hash_subtrees(html_text.parse(page))
                tops = tuple(p.key for e in every if not e.main for p in e.parts if isinstance(p, html_text.Element) and p.main)
                for e in every[1:]:
                    if html_text.can_be_template(e):
                        if e.main:
                            inside.setdefault(e.key, set()).add(tops)
                        else:
                            outside.setdefault(e.key, []).append(id(page))
                    if (slot := html_text.shell(e)) is not None:
                        outside.setdefault(slot, []).append(id(page))
            keys = outside.keys() | inside.keys()
            count = {k: len(set(outside.get(k, ()))) + len(inside.get(k, ())) for k in keys}
            least = max(5, 0.05 * len(pages))
            if often := sorted(k for k, n in count.items() if n >= least):
                want[by_section][group] = often
    df = spark.createDataFrame([(h, x, f"{p}<!-- {i} -->") for i, (h, x, p) in enumerate(rows)], "_host string, _section string, _html string")
    hosts, sections = html_text.recurring(df, min_pages=5, min_share=0.05)
    assert {(x["_host"],): x["_keys"] for x in hosts.collect()} == want[False] and len(want[False]) >= 2
    assert {(x["_host"], x["_section"]): x["_more"] for x in sections.collect()} == want[True]


def test_rules_know_no_case_in_patterns_only(spark):
    """Upper-case, mixed and border urls: as by trying every rule; columns of any name stay."""
    rules = [url_filters.host_rule(*x) for x in [*HOST_RULES, ("example.org", "/CaSe/", "block")]] + [url_filters.pattern_rule(*x) for x in [*PATTERNS, ("^MixedUp^", "block")]]
    urls = ["https://a.example.org/CASINO/x", "https://a.example.org/Casino", "https://a.io/BIGcasino/x", "https://a.io/casinoBIG", "https://A.IO/x-CaSiNo-Win", "https://a.io/mixedup", "https://a.io/MIXEDUP?x",
            "https://x.example.org/CaSe/1", "https://x.example.org/case/1", "https://x.NET/EN/", "https://example.NET/en/x", "https://a.io/É-porn", "https://a.io/éporn", None, "no url", "https://a.io/PORN#casino", "https://casino"]
    df = spark.createDataFrame([(i, u, "h", "p", "u", "old") for i, u in enumerate(urls)], "page_id int, url string, _host string, _pattern string, _u string, host string")
    rows = url_filters.filter_urls(df, rules).collect()
    assert len(rows) == len(urls) and set(rows[0].asDict()) == {"page_id", "url", "_host", "_pattern", "_u", "host", "path", "rule", "verdict"} and rows[0]["_u"] == "u"
    for x in rows:
        whole = f"{x['host']}{x['path']}"
        fits = [q for q in rules if re.search(q["regex"], whole if q["kind"] == "host" else whole.lower())]
        best = max((q for q in fits if q["kind"] == "host"), key=lambda q: len(q["rule"]), default=None)
        assert x["verdict"] == (best["verdict"] if best else max((q["verdict"] for q in fits), default="allow")), x["url"]
    said = {x["url"]: x["verdict"] for x in rows}
    assert said["https://a.example.org/CASINO/x"] == said["https://a.io/MIXEDUP?x"] == "block" and said["https://a.io/BIGcasino/x"] == "allow" and said["https://x.example.org/CaSe/1"] == "block"


@pytest.mark.parametrize("page", ["<b " * 350000 + '"', "<b>" * 150000 + "<div></div>" * 50000, "<i>" * 100000 + "</p>" * 200000, "<script>" + "</script" * 120000, "<p a='" * 150000, "<!--" * 250000])
def test_malformed_pages_take_linear_time(page):
    began = time.perf_counter()
    text_of(page)
    assert time.perf_counter() - began < 20


def test_templates_inside_main_go(spark):
    box = "<div class='x1'><p>Read our other stories</p></div>"
    rows = [(i, f"https://a.com/{i}", f"<main><div class='x2'><p>Own {i}</p>{box}<p>Said by many</p></div></main>") for i in range(12)]
    rows += [(50 + i, f"https://b{i}.com/", f"<main>{box}</main>") for i in range(6)]
    rows += [(80 + i, f"https://c.com/{i}", "<article><div><p>One article in copies</p></div></article>") for i in range(9)]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Own {i} Said by many" for i in range(12)) and all(got[50 + i] == "Read our other stories" for i in range(6))
    assert all(got[80 + i] == "One article in copies" for i in range(9))


def test_given_pages(spark):
    try:
        rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    except Exception:
        pytest.skip("no tables here")
    for r in rows:
        a = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        assert text_of(r["html"]) == " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|br|h1)>", " ", a))).split())


@needs_model
def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(240):
        bad = i % 6 == 0
        t = " ".join(r.choice(["BUY!!", "NOW!!", "WIN###"]) if bad else r.choice(words) for _ in range(80))
        rows.append((i, t + ("\nA line that stands in every document here." if i % 2 else ""), "en", f"s{i % 3}", len(t)))
        labels.append((i, int(not bad), 0))
    first = rows[3][1].split("\n")[0].split()
    rows += [(300 + k, " ".join([*first[: 15 * k + 5], f"new{k}", *first[15 * k + 6 :]]), "en", "s1", 1) for k in range(5)] + [(400, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left, counts = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, left, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        left = spark.read.parquet(f"{tmp_path}/stage{k}")
        assert left.columns == corpus_pipeline.COLUMNS
        counts.append({x["doc_id"] for x in left.collect()})
    good = {i for i in range(240) if i % 6}
    assert not any(i in counts[0] for i in range(0, 240, 6)) and len(good - counts[0]) <= 3
    assert sum("A line that stands" in (x["text"] or "") for x in spark.read.parquet(f"{tmp_path}/stage1").collect()) == 1
    assert not any(300 + k in counts[2] for k in range(5)) and good & counts[1] <= counts[2]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in out} == counts[3] and len(out) >= len(counts[3])


@needs_model
def test_stages_on_an_empty_table(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, size long, kept string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0, name
        assert name.startswith("Sentence") or out.columns == corpus_pipeline.COLUMNS


def test_near_copies_without_ids_go(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    same = " ".join(f"w{k}" for k in range(100))
    near = same.replace("w50 ", "other ")
    rows = [(None, same), (None, near), (3, near), (None, None), (None, ""), (8, "alone here and not alike to any of them")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"] or 0), r["text"] or "") for r in corpus_pipeline.near_copies(spark, docs, "").collect())
    assert got == [(0, ""), (3, near), (8, rows[5][1])]


def test_mixture_keeps_null_and_repeated_ids(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from hostlens.llm.mixing import mix

    ids = [None if i < 40 else 7 if i < 80 else i for i in range(160)]
    rows = [(x, " ".join([f"t{i}"] * (i % 9 + 1)), "en", f"s{i % 3}", i) for i, x in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()
    want = {r["row"]["n_chars"]: r["copies"] for r in mix(docs, keep=corpus_pipeline.COLUMNS).collect()}
    got = corpus_pipeline.mixture(spark, docs, "").collect()
    assert len(want) == 160 and any(r["doc_id"] is None for r in got) and any(r["doc_id"] == 7 for r in got)
    for i in range(160):
        mine = [tuple(r) for r in got if r["n_chars"] == i]
        assert mine == [rows[i]] * want[i]
    targets = {r["source_size"]: r["target"] for r in mix(docs).collect()}
    for s in range(3):
        taken = sum(len(r["text"].split()) for r in got if r["source"] == f"s{s}")
        size = sum(len(t.split()) for _, t, _, x, _ in rows if x == f"s{s}")
        assert abs(taken - targets[size]) <= 20
