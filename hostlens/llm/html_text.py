"""HTML extraction: site templates are subtrees that recur across pages of a host."""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .url_filters import host_and_path

# Fixed values of HTML: elements without content, of raw text, and those that break text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math select".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i ins kbd mark q s samp small span strong sub sup time u var wbr del label tt big".split())
PARAGRAPH = frozenset(["p"])
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

#: What HTML itself says is no main text, wherever it stands.
DROPPED = frozenset("nav footer aside form button dialog menu head script style textarea title noscript template iframe svg math select".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())
#: Names that sites give to slots whose content changes from page to page. A name alone
#: decides nothing: such an element is counted by its shell (tag, class, id) instead of
#: by its content, and goes where the shell recurs across the host.
SLOTS = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|breadcrumbs?|comments?|cookies?|consent|footer|menu|nav|navbar|navigation|newsletter|notice|popup|promo|related|share|sharing|sidebar|social|sponsored|subscribe)(?:$|[\s_-])", re.I)
MAIN = frozenset(("article", "main"))
#: Inside main elements these can be templates; paragraphs, headings and quotes are the author's.
CONTAINERS = frozenset("address center details div dl figure header ol section table ul".split())

#: Each alternative ends at the end of the text at the latest and none goes back, so that
#: reading is linear whatever is not closed. Quotes count after "=" only.
TOKEN = re.compile(r"""<!--(?:(?!-->).)*+(?:-->)?+|<[!?][^>]*+>?+|</?([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"?+|'[^']*+'?+)?+)*+)>?+""", re.S)
ATTR = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"?+|'([^']*+)'?+|([^\s>]++)))?+""")

#: A subtree is template when at least so many pages of its host hold it, and this share
#: of the host's pages or of those of its section (the first part of the path). So a host
#: or section has at most (subtrees of a page / share) templates.
MIN_PAGES, MIN_SHARE = 5, 0.05


class Element:
    __slots__ = ("tag", "attrs", "parts", "main", "key", "block")

    def __init__(self, tag: str, attrs: dict[str, str], main: bool, block: int) -> None:
        self.tag, self.attrs, self.main, self.block = tag, attrs, main, block
        self.parts: list[Element | str] = []
        self.key = 0


class Stack:
    """Open elements, with how many of each tag, and where the innermost block is."""

    def __init__(self) -> None:
        self.held = [Element("", {}, False, 0)]
        self.open: dict[str, int] = {}

    def push(self, e: Element) -> None:
        self.held.append(e)
        self.open[e.tag] = self.open.get(e.tag, 0) + 1

    def pop_to(self, size: int) -> None:
        while len(self.held) > size:
            self.open[self.held.pop().tag] -= 1

    def close(self, tag: str) -> None:
        """The innermost of that tag, and what it holds; a stray end is skipped."""
        if self.open.get(tag):
            while (gone := self.held.pop()).tag != tag:
                self.open[gone.tag] -= 1
            self.open[tag] -= 1


def raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*+>?+|\Z", re.I)


RAW_END = {tag: raw_end(tag) for tag in RAW}


def parse(text: str) -> Element:
    """A tree of elements; unclosed ones end with what holds them, stray ends are skipped.

    Takes time linear in the length of the text.
    """
    stack, at = Stack(), 0
    root = stack.held[0]
    while m := TOKEN.search(text, at):
        if m.start() > at:
            stack.held[-1].parts.append(text[at : m.start()])
        at = m.end()
        tag = (m[1] or "").lower()
        if not tag:
            continue
        if text.startswith("</", m.start()):
            stack.close(tag)
            continue
        ended = CLOSES.get(tag) or (PARAGRAPH if tag in ENDS_P else None)
        if ended:  # an open p ends at a block, an open li at the next; inline elements between end too
            k = stack.held[-1].block
            if stack.held[k].tag in ended:
                stack.pop_to(k)
        top = stack.held[-1]
        attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTR.findall(m[2])} if m[2].strip(" /") else {}
        block = top.block if tag in INLINE else len(stack.held)
        e = Element(tag, attrs, top.main or tag in MAIN or attrs.get("role") == "main", block)
        top.parts.append(e)
        if tag in RAW:
            end = RAW_END[tag].search(text, at)  # not closed: all that follows is its content
            e.parts.append(text[at : end.start()])
            at = end.end()
        elif tag not in VOID and not m[0].endswith("/>"):
            stack.push(e)
    stack.held[-1].parts.append(text[at:])
    return root


def elements(root: Element) -> list[Element]:
    """All elements, holders before what they hold."""
    out = [root]
    for e in out:
        out += [p for p in e.parts if p.__class__ is Element]
    return out


def hash_subtrees(root: Element) -> list[Element]:
    """Sets each element's key from its tag, class, id, text and parts.

    What holds main elements is the same whatever is inside them.
    """
    every = elements(root)
    for e in reversed(every):
        said = [e.tag, e.attrs.get("class", ""), e.attrs.get("id", "")]
        said += [" ".join(p.split()) if isinstance(p, str) else f"\1{p.key if e.main or not p.main else 0:x}" for p in e.parts]
        e.key = xxhash.xxh3_64_intdigest("\0".join(x for x in said)) - (1 << 63)
    return every


def is_dropped(e: Element) -> bool:
    """By what HTML says of the element."""
    return e.tag in DROPPED or (e.tag == "header" and not e.main) or e.attrs.get("role", "").lower() in ROLES or "hidden" in e.attrs


def shell(e: Element) -> int | None:
    """The key of a slot without its content; null for other elements."""
    if not e.attrs or e.tag in ("", "body", "html") or e.tag in MAIN or e.attrs.get("role") == "main":
        return None
    said = f"{e.attrs.get('class', '')} {e.attrs.get('id', '')}"
    return xxhash.xxh3_64_intdigest(f"\2{e.tag} {said}") - (1 << 63) if SLOTS.search(said) else None


def can_be_template(e: Element) -> bool:
    return e.tag in CONTAINERS and e.attrs.get("role") != "main" if e.main else e.tag not in ("html", "body")


def main_text(root: Element, templates: frozenset[int]) -> str:
    """The text left without dropped elements, templates and recurring slots.

    A page with an article (or main) element consists of these, without the containers
    inside them that are templates; paragraphs stay. Other pages consist of all that is
    left. On a host with too few pages to count there are no templates, and only what HTML
    itself marks goes.
    """
    gone = lambda e: bool(templates) and shell(e) in templates

    tops, todo = [], [root]
    while todo:  # the outermost main elements in page order, outside dropped ones
        e = todo.pop()
        if e.main:
            tops.append(e)
        elif e is root or not (is_dropped(e) or gone(e) or (e.key in templates and can_be_template(e))):
            todo += [p for p in e.parts if p.__class__ is Element][::-1]
    tops = [e for e in tops if not is_dropped(e)] or [root]
    out: list[str] = []
    todo = tops[::-1]
    while todo:
        e = todo.pop()
        if isinstance(e, str):
            out.append(html_lib.unescape(e) if "&" in e else e)
        elif not is_dropped(e):
            gap = "" if e.tag in INLINE else " "
            out.append(gap)
            if gone(e) or (e.key in templates and can_be_template(e)):
                continue
            todo.append(gap)
            todo += e.parts[::-1]
    return " ".join("".join(out).split())


def subtree_keys(pages: DataFrame) -> DataFrame:
    """(_host, _section, _key, _in): each page's distinct subtrees and slots, from (_host,
    _section, _html).

    ``_in`` stands for all that the page's main elements hold where the subtree is inside
    one, and is null elsewhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, keys, inside = [], [], []
            for at, page in enumerate(batch.column(2)):
                every = hash_subtrees(parse(page.as_py()))
                tops = [p.key for e in every if not e.main for p in e.parts if p.__class__ is Element and p.main]
                held = xxhash.xxh3_64_intdigest(repr(tops)) - (1 << 63)
                own = {(e.key, held if e.main else None) for e in every[1:] if can_be_template(e)}
                own |= {(slot, None) for e in every[1:] if (slot := shell(e)) is not None}
                row += [at] * len(own)
                keys += [k for k, _ in own]
                inside += [i for _, i in own]
            take = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(keys, pa.int64()), pa.array(inside, pa.int64())], ["_host", "_section", "_key", "_in"])

    return pages.select("_host", "_section", "_html").mapInArrow(run, "_host string, _section string, _key long, _in long")


def recurring(pages: DataFrame, *, min_pages: int, min_share: float) -> tuple[DataFrame, DataFrame]:
    """Templates as (_host, _keys) and (_host, _section, _more), from (_host, _section, _html).

    Sums by section come first (with partial sums), and those of a host from them. A
    subtree inside main elements counts once for all pages whose main elements are equal:
    an article in copies is no template.
    """
    held = subtree_keys(pages).groupBy("_host", "_section", "_key", "_in").agg(F.count("*").alias("_n"))
    held = materialize(held, "html-subtrees")
    pages_of = materialize(pages.groupBy("_host", "_section").agg(F.count("*").alias("_pages")), "html-sections")
    one = F.sum(F.when(F.col("_in").isNull(), F.col("_n")).otherwise(1)).alias("_n")

    def often(*by: str) -> DataFrame:
        sizes = pages_of.groupBy(*by).agg(F.sum("_pages").alias("_pages"))
        got = held.groupBy(*by, "_key", "_in").agg(F.sum("_n").alias("_n")).groupBy(*by, "_key").agg(one).filter(F.col("_n") >= min_pages)
        return got.join(sizes, list(by)).filter(F.col("_n") >= F.col("_pages") * min_share).groupBy(*by).agg(F.array_sort(F.collect_list("_key")).alias("_keys"))

    return materialize(often("_host"), "html-hosts"), materialize(often("_host", "_section").withColumnRenamed("_keys", "_more"), "html-templates")


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(id, url, ``text``, ``n_chars``) of every row.

    Null html counts as empty and gives an empty text; pages with a null url (or none
    with a host) form one site; a page that is there twice counts twice; an empty table
    gives an empty result; other columns are not read.

    Subtree hashes are counted by host and by section of it, with partial sums. The
    templates are written before they are joined, so that Spark knows their size: small
    tables are broadcast and the pages are not shuffled.
    """
    host, path = host_and_path(F.col(url_col))
    p = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), host.alias("_host"), F.regexp_extract(path, "^/([^/]*)/", 1).alias("_section"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    hosts, sections = recurring(p, min_pages=min_pages, min_share=min_share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, keys, more in zip(*batch.columns[2:], strict=True):
                root = parse(page.as_py())
                hash_subtrees(root)
                texts.append(main_text(root, frozenset([*(keys.as_py() or ()), *(more.as_py() or ())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [id_col, url_col, "text", "n_chars"])

    kind = {f.name: f.dataType.simpleString() for f in p.schema}
    known = p.join(hosts, "_host", "left").join(sections, ["_host", "_section"], "left")
    return small_batches(known).select("_id", "_url", "_html", "_keys", "_more").mapInArrow(run, f"`{id_col}` {kind['_id']}, `{url_col}` {kind['_url']}, text string, n_chars long")
