"""The memory of reverse-DNS answers as state of a stream."""

from __future__ import annotations

import json
import sys
from bisect import bisect_right
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.ip import reverse_name
from ..functions.text import short_hostnames
from ..operators.ptr import FIELDS, TTL_SECONDS, is_address, no_hosts, unaddressed, usable

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "spark.sql.streaming.stateStore.providerClass"
STAMPS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}
OUT = "event string, hosts array<string>, status string"
#: Slices of time are so many times the answers' TTL, and clients are dealt into so many
#: buckets: what is kept as one state, and the streams' tasks at a time.
SPAN, BUCKETS = 4, 16


class Memory(StatefulProcessor):
    """What is known of a bucket of clients in one slice of time, and the events that wait.

    An event waits until the watermark has passed it, as then no earlier observation can
    come; it goes with the latest answer of its client that still holds. Answers that a
    later one or the watermark has outdated are forgotten, and when the watermark has
    passed the slice its state is gone.

    A timer stands for the first moment at which something is due, and when that is done
    it is set again: so a slice takes a few calls of its state, however many events it has.
    """

    def __init__(self, ttl: int, span: int) -> None:
        self.ttl, self.span = ttl * 1_000_000, span * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # the rows of a micro-batch are one value: JSON lists, which outlive a release
        self.held = handle.getListState("held", "answers string, waiting string")

    def end(self, key: tuple) -> int:
        """Where the slice ends: nothing of it is waited for after that."""
        return (key[1] + 1) * self.span

    def wake(self, key: tuple, events: list[tuple]) -> None:
        """Sets the timer of the first of ``events``, else of the slice's end."""
        first = min((e[1] for e in events), default=self.end(key))
        self.handle.registerTimer(-(-first // 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        answers, events = [], []
        for r in rows:
            if r.event is None:
                answers.append((r.client, r.micros, r.status, r.hosts))
            else:
                events.append((r.client, r.micros, r.event))
        self.held.appendValue((json.dumps(answers), json.dumps(events)))
        self.wake(key, events)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due, rest = [], []
        known: dict[str, list[tuple]] = {}
        for answers, waiting in self.held.get():
            for c, *answer in json.loads(answers):
                known.setdefault(c, []).append(answer)
            for w in json.loads(waiting):
                (due if w[1] <= passed else rest).append(w)
        for of_client in known.values():
            of_client.sort()
        for c, micros, event in due:
            of_client = known.get(c, [])
            at = bisect_right(of_client, micros, key=lambda x: x[0])
            held = at > 0 and micros < of_client[at - 1][0] + self.ttl
            yield Row(event=event, hosts=of_client[at - 1][2] if held else [], status=of_client[at - 1][1] if held else "not_observed")
        self.held.clear()
        if passed >= self.end(key):
            return
        # the last one before the watermark still counts while it holds
        still = [(c, *a) for c, of in known.items() for a in of[max(bisect_right(of, passed, key=lambda x: x[0]) - 1, 0) :] if a[0] + self.ttl > passed]
        if still or rest:
            self.held.appendValue((json.dumps(still), json.dumps(rest)))
        self.wake(key, rest)

    def close(self) -> None:
        pass


def with_ptr_stream(events: DataFrame, observations: DataFrame, *, ttl: int = TTL_SECONDS, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """``ptr.with_ptr`` for streams: the same columns, and the same rows as the batch where
    nothing comes later than ``late``; what does is left out.

    Both streams meet by bucket of clients and slice of time, so state is spread over both
    and ends by itself; the calls of it grow with the slices, not with clients or events.
    More ``buckets`` are for more cores; a checkpoint keeps its number. Events are given
    when the watermark has passed them. Needs the RocksDB state store (see ``state_store``).
    """
    own = [c for c in events.columns if c not in FIELDS]
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    packed = F.struct(*(f"`{c}`" for c in own))
    span, holds = SPAN * ttl * 1_000_000, ttl * 1_000_000
    bucket = F.pmod(F.xxhash64("client"), F.lit(buckets)).alias("bucket")
    o = usable(observations).select(bucket, "client", F.col("observed_at").cast("timestamp").alias("at"), micros("observed_at").alias("micros"), "status", "hosts", F.lit(None).cast("string").alias("event"))
    # an answer goes to each slice in which it holds: mostly one, at most two
    o = o.withColumn("slice", F.explode(F.expr(f"array_distinct(array(micros div {span}, (micros + {holds - 1}) div {span}))")))
    e = events.filter(is_address(F.col("client"))).select(bucket, "client", F.col("ts").cast("timestamp").alias("at"), micros("ts").alias("micros"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("array<string>").alias("hosts"), F.to_json(packed, STAMPS).alias("event"))
    e = e.withColumn("slice", F.expr(f"micros div {span}"))
    rows = o.unionByName(e).withWatermark("at", late)
    # the process that starts the operator does not see files sent to the workers
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    found = rows.groupBy("bucket", "slice").transformWithState(Memory(ttl, SPAN * ttl), OUT, "append", "eventTime")
    kind = events.select(packed.alias("_e")).schema["_e"].dataType
    known = found.select(F.from_json("event", kind, {k: v for k, v in STAMPS.items() if k != "ignoreNullFields"}).alias("_e"), "hosts", "status").select("_e.*", "hosts", "status")
    named = [F.col("hosts"), short_hostnames(F.col("hosts")), reverse_name("client"), F.col("status")]
    known = known.select(*(f"`{c}`" for c in own), *(x.alias(n) for x, n in zip(named, FIELDS, strict=True)))
    return known.unionByName(unaddressed(events).select(known.columns))


def state_store(spark) -> None:
    """Sets the session's state store to the one that such state needs."""
    spark.conf.set(STATE, PROVIDER)
