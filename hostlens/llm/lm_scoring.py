"""LM scoring: cross-entropy difference of a target and a background bigram model.

The words of all documents, and all their pairs, are counted exactly. Texts become runs
of some hundred thousand words. A run sends each distinct key once, dealt into buckets by
its hash; a bucket sums up its keys over all runs, and sends the sums back to the runs
in the order in which they came. So each run has the counts of its own words and pairs
over the whole corpus, and no task, nor the driver, has a table of all of them.

A word that stands in every run sends one key a run to its bucket. So runs beyond GROUP
go in groups: each group has buckets of its own, their sums are dealt into parts and
summed over the groups, and come back by the same way. No bucket holds more keys of one
word than a group has runs, nor a part more than there are groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches
from .grams import chunks, mix

#: Words that the Dirichlet prior weighs as much as: of a pair's model by its unigrams,
#: and of the unigrams by equal shares, for each word of the vocabulary.
PAIR_PRIOR, WORD_PRIOR = 2.0, 0.1
#: Words of a run (a longer text is several runs), and keys of a bucket.
RUN, BUCKET = 1 << 19, 1 << 19
#: Runs of a group: a word of every run takes up to an eighth of a bucket.
GROUP = 1 << 16
#: Losses are whole parts of a bit, so that sums do not depend on their order.
UNIT = 1 << 20


@dataclass
class Run:
    """Some documents in a row, or a part of one."""

    own: np.ndarray  # of each document: in the target
    near: np.ndarray  # of each document: in the background's sample
    n: np.ndarray  # of each document: its words here
    words: np.ndarray  # distinct hashes, sorted
    seq: np.ndarray  # which of them stand here, one after another
    before: int  # the one ahead of the first (of a text's beginning: that of hash 0)
    row: int = 0  # the first document's

    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        """(the word ahead of each word, its document)"""
        ahead = np.empty(len(self.seq), np.int64)
        ahead[1:] = self.seq[:-1]
        begin = np.cumsum(self.n) - self.n
        ahead[begin[(begin < len(ahead)) & (self.n > 0)]] = np.searchsorted(self.words, 0)
        if len(ahead):
            ahead[0] = self.before
        doc = np.repeat(np.arange(len(self.n)), self.n)
        return ahead, doc

    def word_counts(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Distinct words; as word and as the one ahead, in background and target."""
        ahead, doc = self.sides()
        count = lambda x: np.bincount(x, minlength=len(self.words))
        return self.words, [count(x[which[doc]]) for x in (self.seq, ahead) for which in (self.near, self.own)]

    def pair_codes(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct pairs, which of them stand here)"""
        ahead, _ = self.sides()
        return np.unique(ahead * len(self.words) + self.seq, return_inverse=True)

    def pair_counts(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Hashes of the distinct pairs; their counts in background and target."""
        codes, at = self.pair_codes()
        doc = self.sides()[1]
        a, b = (self.words[x] for x in np.divmod(codes, max(len(self.words), 1)))
        keys = mix(a * np.uint64(0x8CB92BA72F3D8DD7) + mix(b.copy()))
        return keys, [np.bincount(at[which[doc]], minlength=len(codes)) for which in (self.near, self.own)]

    def _own_keys(self, keys: np.ndarray) -> np.ndarray:
        """Keys of what stands in this document, whatever part of it."""
        return mix(keys ^ mix(np.array([self.row], np.int64).view(np.uint64)))

    def own_word_counts(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of a part of a long text: its words, as word and as the one ahead."""
        return self._own_keys(self.words.copy()), [np.bincount(x, minlength=len(self.words)) for x in (self.seq, self.sides()[0])]

    def own_pair_counts(self) -> tuple[np.ndarray, list[np.ndarray]]:
        codes, at = self.pair_codes()
        return self._own_keys(self.pair_counts()[0]), [np.bincount(at, minlength=len(codes))]


def within(doc: np.ndarray, what: np.ndarray) -> np.ndarray:
    """For each word how often ``what`` stands there in its own document."""
    _, at, n = np.unique(doc * (what.max(initial=0) + 1) + what, return_inverse=True, return_counts=True)
    return n[at]


RUN_TYPE = "rows array<long>, own array<boolean>, mark array<long>, n array<long>, words binary, seq binary, before int, pairs long"


def runs(docs: DataFrame) -> DataFrame:
    """(row, part, ids, RUN_TYPE) of (row, id, own, mark, t); named by its first row and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[int, np.ndarray, np.ndarray]] = []
            for at, words, bounds in chunks(batch.column(4)):
                n = np.diff(bounds)
                long = np.flatnonzero(n > RUN)
                for a, b in pairwise(sorted({0, len(n), *long, *(long + 1)})):
                    one = at + a, words[bounds[a] : bounds[b]], n[a:b]
                    if n[a] > RUN or sum(len(h[1]) for h in held) >= RUN:
                        yield from made(batch, held)
                        held = []
                    if n[a] > RUN:
                        yield from made(batch, [one])
                    else:
                        held.append(one)
            yield from made(batch, held)

    def made(batch: pa.RecordBatch, held: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        words, n, at = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]), held[0][0]
        for part in range(max(-(-len(words) // RUN), 1) if len(n) == 1 else 1):
            now = words[part * RUN : (part + 1) * RUN] if len(n) == 1 else words
            own = np.asarray(batch.column(2).slice(at, len(n)).is_valid())
            before = words[part * RUN - 1] if part else np.uint64(0)
            distinct, seq = np.unique(np.concatenate((np.array([before, 0], np.uint64), now)), return_inverse=True)
            r = Run(own, own, n if len(n) > 1 else np.array([len(now)]), distinct, seq[2:], int(seq[0]))
            one = lambda x, t: pa.array([x], pa.list_(t))
            rows = np.asarray(batch.column(0).slice(at, len(n)))
            ids = pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), batch.column(1).slice(at, len(n)))
            cols = [pa.array([rows[0]]), pa.array([part], pa.int32()), ids, one(rows, pa.int64()), one(own, pa.bool_()), one(np.asarray(batch.column(3).slice(at, len(n))), pa.int64()), one(r.n, pa.int64()), pa.array([distinct.tobytes()], pa.binary()), pa.array([packed(r.seq)], pa.binary())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([r.before], pa.int32()), pa.array([len(r.pair_codes()[0])], pa.int64())], ["row", "part", "ids", "rows", "own", "mark", "n", "words", "seq", "before", "pairs"])

    return small_batches(docs).mapInArrow(run, f"row long, part int, ids array<{docs.schema['id'].dataType.simpleString()}>, {RUN_TYPE}")


def read_run(row: dict[str, pa.Array], bound: int) -> Run:
    """A run; documents with a mark below ``bound`` (of 2**32) are the background."""
    flat = lambda c, t: np.asarray(row[c].values).astype(t, copy=False)
    near = (flat("mark", np.int64).view(np.uint64) & np.uint64(0xFFFFFFFF)) < np.uint64(bound)
    return Run(flat("own", bool), near, flat("n", np.int64), np.frombuffer(row["words"].as_py(), np.uint64), unpacked(row["seq"].as_py()), row["before"].as_py(), int(row["rows"].values[0].as_py()))


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Scalar]]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch.column(j)[k] for j, c in enumerate(batch.schema.names)}


@dataclass(frozen=True)
class Deal:
    """How keys are dealt: the groups of runs, the buckets of each, the parts of a bucket."""

    groups: int
    buckets: int
    parts: int

    @classmethod
    def of(cls, keys: int, runs: int) -> Deal:
        groups = max(1, -(-runs // GROUP))
        return cls(groups, max(1, -(-keys // (BUCKET * groups))), groups)


def dealt(keys: np.ndarray, buckets: int, above: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(order of the keys by bucket, where each bucket begins and the end); ``above`` are
    the buckets by which the keys were dealt before."""
    at = (mix(keys.copy()) // np.uint64(above) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    return order, np.searchsorted(at[order], np.arange(buckets + 1))


def packed(numbers: np.ndarray) -> bytes:
    """Most counts are small: compressed they take few bits."""
    return zstandard.ZstdCompressor(level=1, write_content_size=True).compress(np.ascontiguousarray(numbers, "<i8").tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i8")


def summed(table: pa.Table, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, their sums, where each is first sent, which of them each row's keys
    are, where the rows end) of rows of keys and counts."""
    sent = [np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()]
    keys, first, at = np.unique(np.concatenate(sent), return_index=True, return_inverse=True)
    values = np.concatenate([unpacked(x).reshape(kinds, -1) for x in table["counts"].to_pylist()], axis=1)
    sums = np.array([np.bincount(at, v, len(keys)) for v in values])  # whole below 2**53
    return keys, sums, first, at, np.cumsum([len(x) for x in sent])


def totals(held: DataFrame, counts: Callable[[Run], tuple[np.ndarray, list[np.ndarray]]], kinds: int, deal: Deal, bound: int, name: str) -> DataFrame:
    """(row, part, bucket, counts, fresh): sums over all runs for the keys of a run's part of
    a bucket, in their order. ``fresh`` counts each key of the corpus once."""
    out = "row long, part int, bucket long, counts binary, fresh long"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            keys, values = counts(read_run(row, bound))
            order, cuts = dealt(keys, deal.buckets)
            some = np.flatnonzero(np.diff(cuts))
            sent, values = keys[order], np.array(values, np.int64).reshape(kinds, -1)[:, order]
            parts = [(sent[cuts[k] : cuts[k + 1]].tobytes(), packed(values[:, cuts[k] : cuts[k + 1]])) for k in some]
            cols = [pa.array(np.full(len(some), row["row"].as_py(), np.int64)), pa.array(np.full(len(some), row["part"].as_py(), np.int32)), pa.array(some, pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array([x[j] for x in parts], pa.binary()) for j in (0, 1))], ["row", "part", "bucket", "keys", "counts"])

    def add(table: pa.Table) -> pa.Table:
        _, sums, first, at, ends = summed(table, kinds)
        fresh = np.diff(np.searchsorted(np.sort(first), ends), prepend=0)
        cols = {c: table[c] for c in table.column_names if c not in ("keys", "counts")}
        return pa.table(cols | {"counts": pa.array(map(packed, np.split(sums[:, at], ends[:-1], axis=1)), pa.binary()), "fresh": pa.array(fresh, pa.int64())})

    def of_group(table: pa.Table) -> pa.Table:
        keys, sums, *_ = summed(table, kinds)
        order, cuts = dealt(keys, deal.parts, deal.buckets)
        some = np.flatnonzero(np.diff(cuts))
        cut = lambda x: np.split(x[..., order], cuts[1:-1], axis=-1)
        parts = [(a.tobytes(), packed(b)) for a, b in zip(cut(keys), cut(sums), strict=True) if len(a)]
        cols = {c: pa.array(np.full(len(some), table[c][0].as_py(), np.int64)) for c in ("group", "bucket")}
        return pa.table(cols | {"at": pa.array(some, pa.int64()), **{c: pa.array([x[j] for x in parts], pa.binary()) for j, c in enumerate(("keys", "counts"))}})

    def back(sent: pa.Table, found: pa.Table) -> pa.Table:
        keys, sums, _, at, ends = summed(sent, kinds)
        found = found.sort_by("at")
        sums[:, dealt(keys, deal.parts, deal.buckets)[0]] = np.concatenate([unpacked(x).reshape(kinds, -1) for x in found["counts"].to_pylist()], axis=1)
        fresh = np.zeros(len(ends), np.int64)
        fresh[0] = np.sum(found["fresh"].to_numpy())
        cols = {c: sent[c] for c in ("row", "part", "bucket")}
        return pa.table(cols | {"counts": pa.array(map(packed, np.split(sums[:, at], ends[:-1], axis=1)), pa.binary()), "fresh": pa.array(fresh)})

    rows = held.mapInArrow(send, "row long, part int, bucket long, keys binary, counts binary")
    if deal.groups == 1:
        return materialize(rows.groupBy("bucket").applyInArrow(add, out), name)
    rows = rows.withColumn("group", F.pmod(F.xxhash64("row", "part"), F.lit(deal.groups)))
    of_groups = rows.groupBy("group", "bucket").applyInArrow(of_group, "group long, bucket long, at long, keys binary, counts binary")
    sums = materialize(of_groups.groupBy("bucket", "at").applyInArrow(add, "group long, bucket long, at long, counts binary, fresh long"), f"{name}-groups")
    found = materialize(rows.groupBy("group", "bucket").cogroup(sums.groupBy("group", "bucket")).applyInArrow(back, out), name)
    discard(sums)
    return found


def by_run(sums: DataFrame, name: str) -> DataFrame:
    """(row, part, name): a run's sums, one bucket after another."""
    return sums.groupBy("row", "part").agg(F.array_sort(F.collect_list(F.struct("bucket", "counts"))).alias(name))


def gathered(parts: pa.ListScalar, order: np.ndarray, kinds: int) -> np.ndarray:
    """A run's sums in the order of its keys."""
    out = np.zeros((kinds, len(order)))
    if len(order):
        out[:, order] = np.concatenate([unpacked(x.as_py()).reshape(kinds, -1) for x in parts.values.field(1)], axis=1)
    return out


def cross_entropy_difference(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``n_tokens``, ``target_loss``, ``background_loss``, ``score``) of every row.

    ``target`` holds ids of the documents that make the target corpus. The background is a
    sample of all rows, by a hash of their texts, of as many words (its counts are scaled
    to make up what chance left over), so that neither model is surer for being larger.
    Losses are bits a word; ``score`` is target less background loss, lower for texts like
    the target. A document is scored by all others: its own counts are left out of both
    models, so that to be in the target is no advantage.

    A null text counts as empty; without words all three are 0. With an empty target its
    model is uniform, and the background is all rows. Repeated rows are counted and scored
    each, so that a copy in the target is no secret; null ids are never in the target; an
    empty table gives an empty result; other columns are not read.

    Both are bigram models with Dirichlet priors: a pair's probability is (its count +
    PAIR_PRIOR * its word's probability) / (count of the word ahead + PAIR_PRIOR), and
    a word's is (its count + WORD_PRIOR) / (all counts + WORD_PRIOR for each word of the
    vocabulary), which is every word of the documents. For each word ahead they sum up
    to 1.

    The texts meet the target's ids in one shuffle; from there on only hashes of distinct
    words and pairs are shuffled, once there and their sums once back.
    """
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("mark", F.xxhash64("t"))
    # the target's ids grow with the input and are not broadcast
    own = target.select(F.col(id_col).alias("id")).filter("id is not null").distinct().withColumn("own", F.lit(1)).hint("merge")
    held = materialize(runs(d.join(own, "id", "left").select("row", "id", "own", "mark", "t")), "lm-runs")
    size = held.agg(F.count("*").alias("runs"), F.sum(F.octet_length("words") / 8).cast("long").alias("words"), F.sum("pairs").alias("pairs")).first()
    deals = [Deal.of(size[c] or 0, size["runs"]) for c in ("words", "pairs")]
    buckets = [x.buckets for x in deals]
    # hash 0 is no word
    seen = F.aggregate(F.transform("n", lambda x: x), F.lit(0).cast("long"), lambda a, x: a + x)
    of = lambda kind, ok: F.sum(F.aggregate(F.arrays_zip("n", kind), F.lit(0).cast("long"), lambda a, x: a + F.when(ok(x[kind]), x["n"]).otherwise(0)))
    n, nt = (x or 0 for x in held.agg(F.sum(seen), of("own", lambda x: x)).first())
    bound = int(min(1.0, nt / n) * (1 << 32)) if nt else 1 << 32
    nb = held.agg(of("mark", lambda x: F.pmod(x, F.lit(1 << 32)) < bound)).first()[0] or 0
    share = nt / nb if nt and nb else 1.0
    words = totals(held, Run.word_counts, 4, deals[0], bound, "lm-words")
    pairs = totals(held, Run.pair_counts, 2, deals[1], bound, "lm-pairs")
    # texts of several parts, if there are any: what each holds in all of them
    long = held.filter("part > 0").select("row").distinct()
    has_long = len(long.take(1)) > 0
    own_words = own_pairs = None
    if has_long:
        parts = held.join(long, "row", "left_semi")
        whole = parts.groupBy("row").agg(F.sum(seen).alias("_whole"))
        own_words = totals(parts, Run.own_word_counts, 2, deals[0], bound, "lm-own-words")
        own_pairs = totals(parts, Run.own_pair_counts, 1, deals[1], bound, "lm-own-pairs")
    v = max((words.agg(F.sum("fresh")).first()[0] or 0) - 1, 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            r = read_run(row, bound)
            ahead, doc = r.sides()
            _, at = r.pair_codes()
            w = gathered(row["_words"], dealt(r.words, buckets[0])[0], 4)
            p = gathered(row["_pairs"], dealt(r.pair_counts()[0], buckets[1])[0], 2)
            if has_long and row["_own_words"].is_valid:  # a part: what all parts of the text hold
                ow = gathered(row["_own_words"], dealt(r.own_word_counts()[0], buckets[0])[0], 2)
                mine = [gathered(row["_own_pairs"], dealt(r.own_pair_counts()[0], buckets[1])[0], 1)[0][at], ow[0][r.seq], ow[1][ahead]]
                sizes = np.array([row["_whole"].as_py()])
            else:
                mine, sizes = [within(doc, x) for x in (at, r.seq, ahead)], r.n
            sums = []
            for c, cw, ch, all_, k, which in ((p[1], w[1], w[3], nt, 1.0, r.own), (p[0], w[0], w[2], nb, share, r.near)):
                left = which[doc]  # these have their own counts in the model
                pair, word, first, rest = c[at] - left * mine[0], cw[r.seq] - left * mine[1], ch[ahead] - left * mine[2], all_ - left * sizes[doc]
                one = (word * k + WORD_PRIOR) / (rest * k + WORD_PRIOR * v)
                prob = (pair * k + PAIR_PRIOR * one) / (first * k + PAIR_PRIOR)
                sums.append(np.bincount(doc, np.round(-np.log2(prob) * UNIT), minlength=len(r.n)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([row["rows"].values, row["ids"].values, pa.array(r.n), *map(pa.array, sums)], ["row", "id", "n", "t", "b"])

    known = held.join(by_run(words, "_words"), ["row", "part"]).join(by_run(pairs, "_pairs"), ["row", "part"], "left")
    if has_long:
        known = known.join(by_run(own_words, "_own_words"), ["row", "part"], "left").join(by_run(own_pairs, "_own_pairs"), ["row", "part"], "left").join(whole, "row", "left")
    kind = docs.schema[id_col].dataType.simpleString()
    losses = materialize(known.mapInArrow(score, f"row long, id {kind}, n long, t long, b long"), "lm-losses")
    discard(held, words, pairs, own_words, own_pairs)
    whole = losses.groupBy("row").agg(F.first("id").alias("id"), *(F.sum(c).alias(c) for c in ("n", "t", "b")))
    mean = lambda x: F.when(F.col("n") > 0, F.col(x) / F.col("n") / UNIT).otherwise(0.0)
    return whole.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), mean("t").alias("target_loss"), mean("b").alias("background_loss"), (mean("t") - mean("b")).alias("score"))
