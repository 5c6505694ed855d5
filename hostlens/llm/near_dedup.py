"""MinHash near-dedup: consistent weighted samples of TF-IDF shingles, banded, verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize
from .grams import chunks, counted, mix, shingles

SHINGLE, SIMILAR = 5, 0.8
#: Samples a band, and bands: texts of similarity 0.8 meet with probability 0.9992.
ROWS, BANDS = 3, 10
#: Inverse document frequency: ln(1 + 1 / max(share of the documents, FLOOR)). So at most
#: (shingles of a document / FLOOR) shingles have another idf than the rest, at any
#: size of the input, and each task holds these.
FLOOR = 0.001
#: Plain MinHash samples a band, and bands, that tell copies from other documents while
#: document frequencies are counted.
COPY_ROWS, COPY_BANDS = 2, 6
#: Documents are counted in whole parts, so that sums do not depend on their order.
UNIT = 1 << 32
#: Cells in which shingles are counted first, and the parts in which cells are summed up.
CELLS, CELL_PARTS = 1 << 20, 64
#: Weights are summed in floats: bounds give way by so much.
SLACK = 1 - 1e-5


# --- document frequencies ----------------------------------------------------------


def _distinct(texts: pa.Array) -> Iterator[np.ndarray]:
    """The shingles of each document of a run, once each."""
    for _, words, bounds in chunks(texts):
        yield counted(*shingles(words, bounds, SHINGLE))[0]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, counts): documents' shingles of a task counted in ``CELLS`` cells by their hash."""
    cells = np.zeros(CELLS, np.int64)
    for batch in batches:
        for h in _distinct(batch.column(0)):
            cells += np.bincount((h & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
    for part, some in enumerate(np.split(cells, CELL_PARTS)):
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([some.astype(np.int32 if some.max() < 1 << 31 else np.int64).tobytes()])], ["part", "counts"])
    pa.default_memory_pool().release_unused()


def _full(least_count: float):
    """(part, full): which of a part's cells hold more than ``least_count`` over all tasks, as bits."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = CELLS // CELL_PARTS
        total = np.zeros(size, np.int64)
        for batch in batches:
            for held in batch.column(batch.schema.get_field_index("counts")):
                raw = held.as_py()
                total += np.frombuffer(raw, np.int32 if len(raw) == 4 * size else np.int64)
        bits = np.packbits(total > least_count).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([bits])], ["part", "full"])

    return run


def _seen(full: dict[int, bytes]):
    """(h, n): in how many documents of a run each shingle of a full cell is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((CELL_PARTS, CELLS // CELL_PARTS), bool)
        for part, bits in full.items():
            kept[part] = np.unpackbits(np.frombuffer(bits, np.uint8))
        kept = kept.ravel()
        for batch in batches:
            for h in _distinct(batch.column(0)):
                h, n = np.unique(h[kept[(h & np.uint64(CELLS - 1)).astype(np.int64)]], return_counts=True)
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])
        pa.default_memory_pool().release_unused()

    return run


def least(h: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """(n, documents) plain MinHash samples."""
    out = np.empty((n, len(starts)), np.uint64)
    for j in range(n):
        out[j] = np.minimum.reduceat(mix(h ^ np.uint64((j + 101) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), starts)
    return out


def _sketched(wanted: np.ndarray):
    """(row, keys, hits) of (row, t): keys of the copy bands, and which wanted shingles it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, words, bounds in chunks(batch.column(1)):
                h, rows, _ = counted(*shingles(words, bounds, SHINGLE))
                if not len(h):
                    continue
                present, starts = np.unique(rows, return_index=True)
                keys = band_keys(least(h, starts, COPY_ROWS * COPY_BANDS), COPY_ROWS).view(np.int64)
                found = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1) if len(wanted) else np.zeros(len(h), int)
                hit = wanted[found] == h if len(wanted) else np.zeros(len(h), bool)
                ends = np.append(np.searchsorted(rows[hit], present), hit.sum()).astype(np.int32)
                cols = [batch.column(0).take(pa.array(at + present)), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), COPY_BANDS).cast(pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(ends), pa.array(found[hit].astype(np.int32)))], ["row", "keys", "hits"])
        pa.default_memory_pool().release_unused()

    return run


def frequent_shingles(texts: DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, idf) of all shingles in over FLOOR of the documents (``t``).

    Copies do not make a shingle frequent: else what many near copies have in common
    would weigh less than their differences, and they would drift apart. A document
    counts as one part of the largest group that shares one of its copy bands, so that
    exact and near copies together count as about one document.

    All shingles are counted, first in cells by their hash: what is in over FLOOR of the
    rows fills its cell beyond that, so only shingles of such cells are counted each, with
    partial sums. Only those in over FLOOR of the rows are counted by groups: there are at
    most (shingles of a document / FLOOR) of them.
    """
    cells = materialize(texts.mapInArrow(_cells, "part int, counts binary").groupBy("part").applyInArrow(_full(FLOOR * n_docs), "part int, full binary"), "near-cells")
    full = {r["part"]: bytes(r["full"]) for r in cells.collect()}  # a bit a cell
    discard(cells)
    seen = texts.mapInArrow(_seen(full), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") > FLOOR * n_docs)
    seen = materialize(seen.select("h"), "near-seen")  # so that its shuffle files go at once
    wanted = np.sort(np.array([r["h"] for r in seen.collect()], np.int64).view(np.uint64))
    discard(seen)
    if not len(wanted):
        return np.zeros(0, np.uint64), np.zeros(0, np.float32)
    d = texts.select(F.monotonically_increasing_id().alias("row"), "t")
    sketch = materialize(d.mapInArrow(_sketched(wanted), "row long, keys array<long>, hits array<int>"), "near-sketch")
    bands = sketch.select("row", F.posexplode("keys").alias("band", "key"))
    sizes = materialize(bands.groupBy("band", "key").agg(F.count("*").alias("c")).filter("c > 1"), "near-sizes")  # apart, so that a join on a hot key can be split
    parts = materialize(bands.join(sizes, ["band", "key"]).groupBy("row").agg(F.max("c").alias("c")), "near-parts")
    hits = sketch.join(parts, "row", "left").select(F.explode("hits").alias("k"), F.round(F.lit(UNIT) / F.coalesce("c", F.lit(1))).cast("long").alias("part"))
    shares = materialize(hits.groupBy("k").agg(F.sum("part").alias("part")), "near-shares")
    rows = sorted((r["k"], r["part"]) for r in shares.collect())
    discard(sketch, sizes, parts, shares)
    share = np.array([r[1] for r in rows], float) / UNIT / n_docs
    at = np.array([r[0] for r in rows], int)[share > FLOOR]
    return wanted[at], np.log1p(1 / share[share > FLOOR]).astype(np.float32)


class Weights:
    """TF-IDF of counted shingles."""

    def __init__(self, hashes: np.ndarray, idf: np.ndarray) -> None:
        self.hashes, self.idf, self.most = hashes, idf, np.float32(np.log1p(1 / FLOOR))

    def __call__(self, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
        idf = np.full(len(h), self.most)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            idf = np.where(self.hashes[at] == h, self.idf[at], idf)
        return tf.astype(np.float32) * idf


# --- consistent weighted sampling ---------------------------------------------------

_BITS = 16
_gamma: list[np.ndarray] = []


def _gamma_tables() -> list[np.ndarray]:
    """Quantiles of Gamma(2, 1) by 16 bits: r, 1/r, ln c, and of the uniform."""
    if not _gamma:
        u = (np.arange(1 << _BITS) + 0.5) / (1 << _BITS)
        x = np.where(u < 0.5, np.sqrt(2 * u), 2.0)
        for _ in range(60):  # Newton on 1 - (1 + x) exp(-x) = u
            x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / np.maximum(x * np.exp(-x), 1e-300), 1e-6)
        _gamma.extend(a.astype(np.float32) for a in (x, 1 / x, np.log(x), u))
    return _gamma


def samples(h: np.ndarray, weights: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """(n, documents) identifiers of improved consistent weighted samples.

    ``h`` are distinct shingles by document; documents start at ``starts``. A sample is
    the shingle, and the step of its weight, with the least a = c / (y exp(r)).
    """
    r_of, inv_of, lnc_of, beta_of = _gamma_tables()
    lw = np.log(weights)
    out = np.empty((n, len(starts)), np.uint32)
    mask = np.uint64((1 << _BITS) - 1)
    for j in range(n):
        z = mix(h ^ np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        ri = (z & mask).astype(np.int32)
        r, beta = r_of[ri], beta_of[(z >> np.uint64(16) & mask).astype(np.int32)]
        t = np.floor(lw * inv_of[ri] + beta)
        ln_a = lnc_of[(z >> np.uint64(32) & mask).astype(np.int32)] - r * (t - beta + 1)
        bits = ln_a.view(np.uint32)
        order = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
        name = (z >> np.uint64(32)).astype(np.uint32) ^ (t.astype(np.int32).astype(np.uint32) * np.uint32(0x9E3779B1))
        out[j] = (np.minimum.reduceat(order << np.uint64(32) | name, starts) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out


def band_keys(s: np.ndarray, rows: int) -> np.ndarray:
    """(documents, bands) keys of the samples of each band of ``rows``."""
    s = s.astype(np.uint64).reshape(len(s) // rows, rows, -1)
    keys = np.zeros((len(s), s.shape[2]), np.uint64)
    for k in range(rows):
        keys = mix(keys * np.uint64(0x8CB92BA72F3D8DD7) + s[:, k])
    return keys.T


def _signed(weights: Weights, text_at: int | None, field: str = ""):
    """Texts are the column ``text_at``, or a field of the last column (a struct)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [k for k in range(batch.num_columns) if k != text_at]
            rows = batch.column(batch.num_columns - 1)
            for at, words, bounds in chunks(batch.column(text_at) if text_at is not None else rows.flatten()[rows.type.get_field_index(field)]):
                n = len(bounds) - 1
                h, rows, tf = counted(*shingles(words, bounds, SHINGLE))
                bands: list = [[] for _ in range(n)]
                if len(h):
                    present, starts = np.unique(rows, return_index=True)
                    keys = band_keys(samples(h, weights(h, tf), starts, ROWS * BANDS), ROWS).view(np.int64)
                    for k, row in zip(present, keys, strict=True):
                        bands[k] = row
                cols = [batch.column(k).slice(at, n) for k in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(bands, pa.list_(pa.int64()))], [*(batch.schema.names[k] for k in keep), "bands"])
        pa.default_memory_pool().release_unused()

    return run


# --- verification ------------------------------------------------------------------


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (sorted hashes, weights)."""
    total = float(a[1].sum(dtype=float) + b[1].sum(dtype=float))
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    same = a[0][at] == b[0] if len(a[0]) else np.zeros(0, bool)
    both = float(np.minimum(a[1][at[same]], b[1][same]).sum(dtype=float))
    return both / (total - both) if total > both else 1.0


def _verified(weights: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            ok = []
            ids = batch.column(1).to_pylist()
            for at, words, bounds in chunks(batch.column(2)):
                h, rows, tf = counted(*shingles(words, bounds, SHINGLE))
                w = weights(h, tf)
                ends = np.searchsorted(rows, np.arange(len(bounds)))
                for k in range(len(bounds) - 1):
                    if ids[at + k] != last or held is None:  # rows come sorted by the second text
                        last = ids[at + k]
                        (_, w2, b2), = chunks(batch.column(3).slice(at + k, 1))
                        h2, _, tf2 = counted(*shingles(w2, b2, SHINGLE))
                        held = h2, weights(h2, tf2)
                    s = slice(ends[k], ends[k + 1])
                    ok.append(similarity((h[s], w[s]), held))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.float64())], ["a", "b", "similarity"])
        pa.default_memory_pool().release_unused()

    return run


def _postings(weights: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, words, bounds in chunks(batch.column(1)):
                h, rows, tf = counted(*shingles(words, bounds, SHINGLE))
                w = weights(h, tf).astype(float)
                total = np.bincount(rows, w, minlength=len(bounds) - 1)
                take = pa.array(at + rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(h.view(np.int64)), pa.array(w), pa.array(total[rows])], ["n", "h", "w", "total"])
        pa.default_memory_pool().release_unused()

    return run


def unlinked(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(n, c, g): texts of groups that hold two classes, with their class and these groups."""
    r = rows.select("band", "key", "n").join(classes, rows["n"] == classes["node"], "left").select("band", "key", "n", F.coalesce("least", "n").alias("c"))
    r = materialize(r, "near-rest")
    live = materialize(r.groupBy("band", "key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 < c1").select("band", "key"), "near-live")
    met = r.join(live, ["band", "key"]).groupBy("n").agg(F.min("c").alias("c"), F.collect_set(F.xxhash64("band", "key")).alias("g"))
    met = materialize(met, "near-met")
    discard(r, live)
    return met


def first_shingles(met: DataFrame, postings: DataFrame, similar: float) -> DataFrame:
    """(n, c, h, rest, total): the shingles of a text one of which a similar text must hold.

    A pair of weights A <= B is similar only if both hold t / (1 + t) * (A + B) in common.
    Only shingles of two or more classes count for that; in one order of them all, the
    rarest first, the first common one must be followed (itself included) by that much
    (``rest``) on both sides. What many texts have in common stands last, and does not
    join them unless it is enough by itself.
    """
    own = materialize(postings.join(met.select("n", "c"), "n"), "near-own")
    often = materialize(own.groupBy("h").agg(F.count("*").alias("k"), F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 < c1").select("h", "k"), "near-common")
    rest = F.sum("w").over(Window.partitionBy("n").orderBy(F.desc("k"), F.desc("h")).rowsBetween(Window.unboundedPreceding, 0))
    first = own.join(often, "h").withColumn("rest", rest).filter(F.col("rest") >= F.col("total") * similar * SLACK)
    first = materialize(first.select("n", "c", "h", "rest", "total"), "near-first")
    discard(own, often)
    return first


def star_pairs(first: DataFrame, similar: float) -> DataFrame:
    """(a, b): of each class one text by shingle, with one of those of the shingle.

    As many pairs as first shingles at most. A text meets another pivot with each of its
    shingles, so that most classes become one before all their pairs are looked at.
    """
    share = similar / (1 + similar)
    side = first.groupBy("h", "c").agg(F.min_by(F.struct("n", "rest", "total"), F.xxhash64("n", "h")).alias("s"))
    side = materialize(side.select("h", "c", "s.*"), "near-sides")
    pivot = side.groupBy("h").agg(F.min_by(F.struct("c", "n", "rest", "total"), F.xxhash64("n", "h")).alias("p"), F.count("*").alias("k")).filter("k > 1")
    pivot = materialize(pivot.select("h", *(F.col(f"p.{x}").alias(f"{x}1") for x in ("c", "n", "rest", "total"))), "near-pivots")
    enough = F.least("rest", "rest1") >= (F.col("total") + F.col("total1")) * share * SLACK
    near = side.join(pivot, "h").filter(enough & (F.col("c") != F.col("c1")) & (F.least("total", "total1") >= F.greatest("total", "total1") * similar * SLACK))
    return near.select(F.greatest("n", "n1").alias("a"), F.least("n", "n1").alias("b")).distinct()


def left_pairs(met: DataFrame, first: DataFrame, similar: float) -> DataFrame:
    """(a, b): all pairs of a group and of two classes that may be similar enough.

    Exact, by the bounds of ``first_shingles``: the first shingles of texts meet the
    classes of a shingle before they meet the texts of those.
    """
    share = similar / (1 + similar)
    first = materialize(first.join(met.select("n", "g"), "n"), "near-first")
    sides = materialize(first.groupBy("h", "c").agg(F.max("rest").alias("rest1"), F.min("total").alias("total0"), F.max("total").alias("total1")).withColumnRenamed("c", "c2"), "near-sides")
    may = F.least("rest", "rest1") >= (F.col("total") + F.col("total0")) * share * SLACK
    one = first.join(sides, "h").filter(may & (F.col("c") != F.col("c2")) & (F.col("total1") >= F.col("total")))
    one = materialize(one.select("h", "c2", F.col("n").alias("a"), F.col("rest").alias("rest1"), F.col("total").alias("total1"), F.col("g").alias("g1")), "near-meet")
    two = first.withColumnRenamed("c", "c2").join(one, ["h", "c2"])
    enough = F.least("rest", "rest1") >= (F.col("total") + F.col("total1")) * share * SLACK
    two = two.filter(enough & (F.col("total1") <= F.col("total")) & (F.col("total1") >= F.col("total") * similar * SLACK) & F.arrays_overlap("g", "g1"))
    return two.select(F.greatest("a", "n").alias("a"), F.least("a", "n").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, least) of the connected components of (a, b), by large and small stars."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        low = materialize(low, "near-low")  # apart, so that a join on a hot node can be split
        made.append(low)
        j = both.join(low, "a")
        if large:
            j = j.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            j = j.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        return j.filter("a <> b").distinct()

    made: list[DataFrame] = []

    def sign(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    e = materialize(edges.select("a", "b").filter("a <> b").distinct(), "near-edges")
    was = None
    while (now := sign(e)) != was:
        was = now
        made.append(e)
        e = materialize(star(star(e, True), False), "near-edges")
        discard(*made)
        made.clear()
    return e.select(F.col("a").alias("node"), F.col("b").alias("least"))


def near_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, keep: list[str] | None = None) -> DataFrame:
    """(id, ``class_id``, ``kept``) of every row.

    Two texts are linked when the weighted Jaccard similarity of their TF-IDF five-word
    shingles is at least ``similar``; classes are connected components, named by their
    smallest id, whose document is ``kept``. Texts under five words are one shingle;
    texts without words are alike only when equal. Null texts count as empty. Ids are
    whole numbers. Rows that repeat an id are one document, kept in one row for each of
    its texts. A null id has a name of its own (from 2**62 on, made from the text),
    which is its ``class_id`` where no other id is in its class; of equal texts without
    ids one is kept. An empty table gives an empty result. Other columns are not read,
    but for those named in ``keep``, which each row brings as the struct ``row``.

    Equal texts collapse first. In a band's group, all texts are compared with one
    pivot (not each with each). Classes left in one group then meet by their rarest
    shingles, each with a pivot of its own (``star_pairs``). Of the pairs then left (one
    group, two classes) all are compared that the exact bounds of ``left_pairs`` do not
    rule out. Nothing is capped. Only texts in groups are shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = F.coalesce(F.col(id_col).cast("long"), F.abs(F.xxhash64(text) % (1 << 62)) + (1 << 62))
    more = [F.struct(*(f"`{c}`" for c in keep)).alias("row")] if keep else []
    src = docs.select(named.alias("n"), F.col(id_col).alias("_id"), text.alias("t"), *more)
    n_docs = src.count()
    weights = Weights(*frequent_shingles(src.select("t"), n_docs))
    own = src.select("n", "_id", F.md5("t").alias("th"), F.monotonically_increasing_id().alias("at"), *(["row"] if keep and text_col in keep else ["t", *(["row"] if keep else [])]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != "t")
    signed = materialize(own.mapInArrow(_signed(weights, own.columns.index("t") if "t" in own.columns else None, text_col), f"{kinds}, bands array<long>"), "near-signed")  # fixes the rows' numbers
    copies = signed.groupBy("th").agg(F.min(F.struct("n", "at")).alias("_r")).select("th", F.col("_r.n").alias("rep"), F.col("_r.at").alias("rep_at"))
    copies = materialize(copies, "near-copies")  # apart, so that a join on a hot text can be split
    rep = signed.select("n", "th", "at", "bands").join(copies, "th").filter("at = rep_at").select("n", "bands").distinct()
    bands = materialize(rep.select("n", F.posexplode("bands").alias("band", "key")), "near-bands")
    groups = materialize(bands.groupBy("band", "key").agg(F.count("*").alias("c"), F.min("n").alias("pivot")).filter("c > 1").drop("c"), "near-pivots")
    rows = materialize(bands.join(groups, ["band", "key"]), "near-groups")  # groups of two or more
    discard(bands, groups)

    # the texts of all groups, fetched once; the ids grow with the input and are not broadcast
    grouped = rows.select("n").distinct().hint("merge")
    texts = materialize(src.select("n", "t").join(grouped, "n", "left_semi"), "near-texts")

    def untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
        pairs = pairs.join(tested, ["a", "b"], "left_anti")
        return pairs.join(tested.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")

    edges = classes = None
    made = [rows, texts]

    def link(pairs: DataFrame) -> None:
        """Verifies pairs and makes the classes anew."""
        nonlocal edges, classes
        a, b = (texts.select(F.col("n").alias(x), F.col("t").alias(f"t{x}")) for x in "ab")
        joined = pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb")
        found = materialize(joined.mapInArrow(_verified(weights), "a long, b long, similarity double").filter(F.col("similarity") >= similar).select("a", "b"), "near-found")
        made.append(found)
        edges = found if edges is None else edges.unionByName(found)
        discard(classes)
        classes = materialize(components(edges), "near-classes")

    # first each text of a group with the group's pivot
    tested = materialize(rows.filter("n <> pivot").select(F.col("n").alias("a"), F.col("pivot").alias("b")).distinct(), "near-pairs")
    made.append(tested)
    link(tested)
    # then the classes that are left in a group, with a pivot for each of their first shingles
    met = unlinked(rows, classes)
    postings = materialize(texts.join(met.select("n"), "n").select("n", "t").mapInArrow(_postings(weights), "n long, h long, w double, total double"), "near-postings")
    first = first_shingles(met, postings, similar)
    star = materialize(untested(star_pairs(first, similar), tested), "near-pairs")
    made += [met, postings, first, star]
    link(star)
    # then all pairs of what is left
    tested = tested.unionByName(star)
    met = unlinked(rows, classes)
    first = first_shingles(met, postings, similar)
    rest = materialize(untested(left_pairs(met, first, similar), tested), "near-pairs")
    made += [met, first, rest]
    link(rest)
    discard(*made)

    named_copies = copies.join(classes, copies["rep"] == classes["node"], "left").select("th", "rep_at", F.coalesce("least", "rep").alias("class_id"))
    out = signed.select("n", "_id", "th", "at", *(["row"] if keep else [])).join(named_copies, "th")
    kept = (F.col("n") == F.col("class_id")) & (F.col("at") == F.col("rep_at"))
    return out.select(F.col("_id").alias(id_col), "class_id", kept.alias("kept"), *(["row"] if keep else []))
