"""Prefix trie of conversations: subtree totals by time-forward processing."""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Messages that a queue holds in memory; what is beyond goes to sorted runs on disk.
QUEUE = 200_000
#: Subtrees of at most so many turns are worked on whole in one task, where the tables are
#: so small that their share for each partition is less.
SHARD_LEAST = 200
#: Ids that one piece of a member list holds at most.
PIECE = 1000

MESSAGE = struct.Struct("<6q")
TOTALS = "n_children long, n_leaves long, saved_tokens long"


class SpillingQueue:
    """A priority queue of (level, p1, p2) -> sums of three; memory is bounded.

    What does not fit is written as a sorted run to an unnamed file of the task, which
    goes with it and which no other task reads, as Spark's own sorts do.
    """

    def __init__(self, limit: int) -> None:
        self.limit, self.spilled = limit, 0
        self.heap: list[tuple[int, ...]] = []
        self.runs: list[tuple[tuple[int, ...], int, Iterator[tuple[int, ...]]]] = []  # next message, number, rest

    def push(self, level: int, p1: int, p2: int, kids: int, leaves: int, saved: int) -> None:
        heapq.heappush(self.heap, (level, p1, p2, kids, leaves, saved))
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        file = tempfile.TemporaryFile()  # noqa: SIM115 - closed where its last message is read
        self.heap.sort()
        file.write(b"".join(MESSAGE.pack(*m) for m in self.heap))
        file.seek(0)
        self.heap = []
        self.spilled += 1
        self._next(self.spilled, self._read(file))

    def _read(self, file: BinaryIO) -> Iterator[tuple[int, ...]]:
        while data := file.read(MESSAGE.size * 4096):
            yield from MESSAGE.iter_unpack(data)
        file.close()

    def _next(self, number: int, rest: Iterator[tuple[int, ...]]) -> None:
        if (m := next(rest, None)) is not None:
            heapq.heappush(self.runs, (m, number, rest))

    def take(self, level: int, p1: int, p2: int) -> tuple[int, int, int]:
        """The sums of what was sent to this node."""
        key, kids, leaves, saved = (level, p1, p2), 0, 0, 0
        while True:
            in_memory = self.heap and self.heap[0][:3] == key
            on_disk = self.runs and self.runs[0][0][:3] == key
            if in_memory:
                m = heapq.heappop(self.heap)
            elif on_disk:
                m, number, rest = heapq.heappop(self.runs)
                self._next(number, rest)
            else:
                return kids, leaves, saved
            kids, leaves, saved = kids + m[3], leaves + m[4], saved + m[5]


def keyed_turns(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, part, at, ``offset``, key, n_chars): a row for each turn, without its text.

    ``key`` is the MD5 of role and text (null: empty); ``offset + at`` counts the turns of
    a conversation from 1 on, by turn (null first), then key. Rows without a conv_id are
    of no conversation and left out. Turns are dealt by ranges and numbered within each,
    so that a conversation of any length is never in one task.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("_turn"), F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("key"), F.length(text).cast("long").alias("n_chars")
    )
    dealt = rows.repartitionByRange("conv_id", F.col("_turn").asc_nulls_first(), "key").withColumn("part", F.spark_partition_id())
    order = Window.partitionBy("conv_id", "part").orderBy(F.col("_turn").asc_nulls_first(), "key")
    turns = materialize(dealt.withColumn("at", F.row_number().over(order)).drop("_turn"), "trie-turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = turns.groupBy("conv_id", "part").agg(F.count("*").alias("_n")).withColumn("offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return turns.join(parts, ["conv_id", "part"])


def plain(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, part, pos, key, n_chars) and (conv_id, length) of the conversations as they are."""
    rows = materialize(turns.select("conv_id", "part", (F.col("offset") + F.col("at")).alias("pos"), "key", "n_chars"), "trie-plain")
    return rows, rows.groupBy("conv_id").agg(F.max("pos").alias("length"))


def with_openings(turns: DataFrame, *, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """As ``plain``, but each conversation c begins with the first h turns of conversation
    c - c % every (all if there are fewer), h being the CRC-32 of c in decimal % most, and
    goes on with its own turns after the first h."""
    rows = materialize(turns.select("conv_id", "part", (F.col("offset") + F.col("at")).alias("pos"), "key", "n_chars"), "trie-own")
    opening = F.array_sort(F.collect_list(F.struct("pos", "key", "n_chars")))
    bases = rows.filter((F.col("conv_id") % every == 0) & (F.col("pos") < most)).groupBy(F.col("conv_id").alias("_base")).agg(opening.alias("_opening"))  # most - 1 turns each
    convs = rows.groupBy("conv_id", "part").agg(F.count("*").alias("_n"))
    whole = convs.groupBy("conv_id").agg(F.sum("_n").alias("_n")).withColumn("_base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % most)
    first = F.slice(F.coalesce("_opening", F.array().cast("array<struct<pos:bigint,key:binary,n_chars:bigint>>")), F.lit(1), F.col("h").cast("int"))
    plan = whole.join(bases, "_base", "left").withColumn("_opening", first)
    plan = materialize(plan.select("conv_id", "h", "_opening", (F.size("_opening") + F.greatest(F.col("_n") - F.col("h"), F.lit(0))).cast("long").alias("length")), "trie-plan")
    opened = plan.select("conv_id", F.lit(-1).alias("part"), F.inline("_opening")).select("conv_id", "part", "pos", "key", "n_chars")
    shifts = convs.select("conv_id", "part").join(plan.select("conv_id", "h", (F.size("_opening") - F.col("h")).alias("_shift")), "conv_id")
    own = rows.join(shifts, ["conv_id", "part"]).filter("pos > h").select("conv_id", "part", (F.col("pos") + F.col("_shift")).alias("pos"), "key", "n_chars")
    return materialize(opened.unionByName(own), "trie-rebuilt"), plan.select("conv_id", "length")


def prefixes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, p1, p2, q1, q2, n_chars, length): each turn's prefix and its parent.

    A prefix's 128-bit name is the exclusive or of a hash for each (position, turn), so it
    runs on from part to part of a long conversation; the empty prefix is (0, 0).
    """
    named = rows.withColumn("z1", F.xxhash64("pos", "key")).withColumn("z2", F.xxhash64(F.lit("second"), "key", "pos"))
    sums = named.groupBy("conv_id", "part").agg(F.bit_xor("z1").alias("_c1"), F.bit_xor("z2").alias("_c2"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("conv_id", "part", *(F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(c) for c in ("_c1", "_c2"))).join(convs, "conv_id")
    running = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = named.withColumn("_r1", F.bit_xor("z1").over(running)).withColumn("_r2", F.bit_xor("z2").over(running)).join(carried, ["conv_id", "part"])
    p = p.withColumn("p1", F.col("_r1").bitwiseXOR(F.col("_c1"))).withColumn("p2", F.col("_r2").bitwiseXOR(F.col("_c2")))
    return p.select("conv_id", F.col("pos").alias("depth"), "p1", "p2", F.col("p1").bitwiseXOR(F.col("z1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("z2")).alias("q2"), "n_chars", "length")


def time_forward(nodes: DataFrame, *, queue: int) -> DataFrame:
    """``nodes`` with their subtree totals, partition by partition.

    A partition is sorted by level, deepest first (Spark's sort spills). Each node takes
    what its children sent and sends its totals to its parent, which comes later; a node
    with ``last`` sends nothing, as its parent is in no partition of this pass. Rows
    without a conv_id are messages of an earlier pass to the node (p1, p2).
    """
    columns = ["conv_id", "depth", "p1", "p2", "q1", "q2", "n_convs", "n_chars", "parent_conv_id", "last"]
    kinds = dict(nodes.dtypes)
    head = ", ".join(f"{c} {kinds[c]}" for c in columns)
    given = [x.split()[0] for x in TOTALS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = SpillingQueue(queue)
        for batch in batches:
            col = {n: batch.column(k).to_pylist() for k, n in enumerate(batch.schema.names)}
            keep, out = [], ([], [], [])
            for k in range(batch.num_rows):
                level, p1, p2 = -col["depth"][k], col["p1"][k], col["p2"][k]
                if col["conv_id"][k] is None:
                    held.push(level, p1, p2, *(col[n][k] for n in given))
                    continue
                kids, leaves, saved = held.take(level, p1, p2)
                leaves, saved = leaves or 1, saved + (col["n_convs"][k] - 1) * col["n_chars"][k]
                if not col["last"][k]:
                    held.push(level + 1, col["q1"][k], col["q2"][k], 1, leaves, saved)
                keep.append(k)
                for values, x in zip(out, (kids, leaves, saved), strict=True):
                    values.append(x)
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), *(pa.array(x, pa.int64()) for x in out)], [*columns, *given])

    ordered = nodes.select(*columns, *(c for c in given if c in nodes.columns)).sortWithinPartitions(F.desc("depth"), "p1", "p2", F.asc_nulls_first("conv_id"))
    return ordered.mapInArrow(run, f"{head}, {TOTALS}")


def list_digests(ends: DataFrame) -> DataFrame:
    """(p1, p2, ``ends_sha256``) of the conv_ids that end at each node, from (p1, p2, conv_id).

    Ids of one thousand are one piece (each ends once); a node's pieces stream through one
    task in their order, and nothing is held of them.
    """
    pieces = ends.groupBy("p1", "p2", F.expr(f"floor(conv_id / {PIECE})").alias("_piece")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done: list[tuple[int, int, str]] = []
            for p1, p2, ids in zip(*(batch.column(c).to_pylist() for c in ("p1", "p2", "_ids")), strict=True):
                if (p1, p2) == now:
                    digest.update(b"," + ids.encode())
                else:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = (p1, p2), hashlib.sha256(ids.encode())
            yield of(done)
        if now is not None:
            yield of([(*now, digest.hexdigest())])

    def of(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
        a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], ["p1", "p2", "ends_sha256"])

    return pieces.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "_piece").mapInArrow(run, "p1 long, p2 long, ends_sha256 string")


def prefix_trie(rows: DataFrame, convs: DataFrame, *, shard_rows: int | None = None, queue: int = QUEUE) -> DataFrame:
    """The nodes of the trie of ``rows`` (conv_id, part, pos, key, n_chars), where ``convs``
    (conv_id, length) has all conversations, also those without turns.

    A node is named by its smallest member ``conv_id`` and its ``depth``; it has the
    parent's ``parent_conv_id`` (root: null), ``n_convs`` members, ``n_children``, and of its
    subtree ``n_leaves`` and ``saved_tokens``, the sum of (members - 1) * characters of the
    last turn; ``ends_sha256`` is of the members that end there. No conversations, no nodes.

    A subtree of at most ``shard_rows`` turns whose parent's has more is a shard; whole
    shards go to a task and are worked on deepest level first. Their totals, summed up by
    parent, then go through the nodes above them in the same way: these are at most
    (turns / shard_rows) a level, and stream through one task.
    """
    spark = rows.sparkSession
    path = materialize(prefixes(rows, convs), "trie-paths")
    if shard_rows is None:
        shard_rows = max(SHARD_LEAST, path.count() // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # every member of a node has the same turns up to it, so any row tells of them
    same = [F.min(c).alias(c) for c in ("depth", "q1", "q2", "n_chars")]
    below = path.groupBy("p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("length") - F.col("depth") + 1).alias("_turns"), *same)
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(
        zero.alias("p1"), zero.alias("p2"), "conv_id", "n_convs", F.lit(None).cast("long").alias("_turns"), *(zero.alias(c) for c in ("depth", "q1", "q2", "n_chars"))
    )
    nodes = materialize(below.unionByName(root), "trie-nodes").withColumn("_big", F.col("_turns").isNull() | (F.col("_turns") > shard_rows))
    parents = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), F.col("_big").alias("last"))
    # the root's q is its own name: no parent
    nodes = nodes.withColumn("q1", F.when(F.col("depth") > 0, F.col("q1"))).join(parents, ["q1", "q2"], "left")
    nodes = materialize(nodes, "trie-linked")

    tops = nodes.filter("last and not _big").select("p1", "p2", F.col("p1").alias("s1"), F.col("p2").alias("s2"))
    shards = path.select("conv_id", "p1", "p2").join(tops, ["p1", "p2"]).select("conv_id", "s1", "s2")
    small = nodes.filter("not _big").join(shards, "conv_id").repartition("s1", "s2")
    inner = materialize(time_forward(small, queue=queue), "trie-shards")

    sent = inner.filter("last").groupBy("q1", "q2").agg(
        F.min(F.col("depth") - 1).alias("depth"), F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
    ).withColumnsRenamed({"q1": "p1", "q2": "p2"})
    above = nodes.filter("_big").withColumn("last", F.col("depth") == 0)
    outer = time_forward(above.unionByName(sent, allowMissingColumns=True).repartition(1), queue=queue)

    ends = path.filter("depth = length").select("p1", "p2", "conv_id").unionByName(convs.filter("length = 0").select(zero.alias("p1"), zero.alias("p2"), "conv_id"))
    digests = materialize(list_digests(ends), "trie-ends")
    every = inner.unionByName(outer).join(digests, ["p1", "p2"], "left")
    return every.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    )


def conversation_trie(conversations: DataFrame, *, openings: bool = False, shard_rows: int | None = None, queue: int = QUEUE) -> DataFrame:
    """The trie of whole conversations, or with ``openings`` of those by ``with_openings``.

    Null roles and texts are empty, a null turn comes first, turns of one number by their
    MD5; rows that repeat count as turns. An empty table has no nodes. Other columns than
    conv_id, turn, role and text are not read.
    """
    rows, convs = (with_openings if openings else plain)(keyed_turns(conversations))
    return prefix_trie(rows, convs, shard_rows=shard_rows, queue=queue)
