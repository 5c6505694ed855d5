"""Consuming events as a stream, by the same functions as batches.

A batch's documents and verdicts appear together, with the one commit that names both;
readers follow commits. Events are not deduplicated by content, for identical events are
real traffic; a batch that comes again after its commit is not written again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import enrich, sieve
from ..operators.sinks import folder_of
from ..plans.jobs import Reference, enrich_browser, enrich_dns
from ..session import written
from ..sources import events as src

VERDICTS = ("kept", "dropped", "unreadable")
COMMIT = "batch_id long, documents string, verdicts string, index_built_at long, kept long, dropped long, unreadable long"


def identified(payloads: DataFrame, batch_id: int) -> DataFrame:
    """Adds ``event_id``: there is no natural key, so it is made once and kept."""
    return payloads.withColumn("event_id", F.concat_ws("-", F.lit(batch_id), F.monotonically_increasing_id()))


def _why(rows: DataFrame, feed: str, sift: Callable[[DataFrame], DataFrame], audit: Callable[[Column], Column]) -> DataFrame:
    """Adds ``_<feed>``: verdict, reason and line of the feed's events, by its own columns.

    All rows go through it, so that each payload is gone through once."""
    own = [f"`{c}`" for c in rows.columns]
    judged = sift(rows.select(F.struct(*own).alias("_row"), "type", f"{feed}.*"))
    # a kept event that lacks a needed field costs itself only
    judged = sieve.with_verdict(judged, F.col("complete") | F.col("drop_reason").isNotNull())
    return judged.select("_row.*", F.struct("verdict", "drop_reason", audit(F.col("verdict")).alias("line")).alias(f"_{feed}"))


def sifted(parsed: DataFrame, ref: Reference) -> DataFrame:
    """``parsed`` with ``verdict``, ``drop_reason`` and ``line``, unreadable payloads too."""
    rows = _why(parsed, "dns", lambda e: sieve.sieve_dns(e, ref.ignore), sieve.dns_audit)
    rows = _why(rows, "web", lambda e: sieve.sieve_browser(e, ref.ignore), sieve.browser_audit)
    other = F.struct(F.when(F.col("readable"), "dropped").otherwise("unreadable").alias("verdict"), F.lit("type").alias("drop_reason"), F.lit(None).cast("string").alias("line"))
    said = F.when(F.col("dns").isNotNull(), F.col("_dns")).when(F.col("web").isNotNull(), F.col("_web")).otherwise(other)
    return rows.withColumn("_said", said).select(*parsed.columns, "_said.*")


def verdicts(parsed: DataFrame, ref: Reference) -> DataFrame:
    """(event_id, verdict, drop_reason, line) of every payload."""
    return sifted(parsed, ref).select("event_id", "verdict", "drop_reason", "line")


def process(payloads: DataFrame, ref: Reference, *, mode: str = "ancestor", cut: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """Documents of both feeds from payloads with ``event_id``; for ``cut`` see ``enrich_dns``."""
    return documents(cut(sifted(src.parse(payloads), ref)), ref, mode=mode, cut=cut)


def documents(rows: DataFrame, ref: Reference, *, mode: str = "ancestor", cut: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """Documents of the kept rows of ``sifted``, which are not parsed again."""
    stamp = F.col("timestamp").try_cast("timestamp").alias("ts")
    kept = rows.filter("verdict = 'kept'").drop("verdict", "drop_reason", "line")
    dns, web = src.dns_fields(kept).select("*", stamp), src.browser_fields(kept).select("*", stamp)
    parts = [enrich_dns(dns, ref, mode=mode, cut=cut, sieved=True), enrich_browser(web, ref, mode=mode, cut=cut, sieved=True)]
    return enrich.united(*map(enrich.documents, parts))


def consume(
    stream: DataFrame, reference: Callable[[], Reference], path: str, checkpoint: str, *, mode: str = "ancestor", every: str = "2 seconds", once: bool = False
) -> StreamingQuery:
    """Starts a query that writes each micro-batch's documents and verdicts below ``path``.

    ``reference`` is asked anew for each batch (see ``LastGood``), so a newly published
    generation is used from the next batch on. A restart goes on from the checkpoint.

    A payload is parsed and sieved once; its verdict is counted as that is stored. Both
    outputs go to folders of this attempt; the batch's commit names them. An attempt that
    fails leaves folders that no commit names, and the batch comes again; one that comes
    again after its commit is left as it is. So each batch is there once or not at all.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        if is_committed(spark, path, batch_id):
            return
        ref, attempt = reference(), uuid.uuid4().hex
        counted = Observation()
        counts = [F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS]
        rows = written(sifted(src.parse(identified(df, batch_id)), ref).observe(counted, *counts))
        names = {part: f"{part}/batch_id={batch_id}/attempt={attempt}" for part in ("documents", "verdicts")}
        documents(rows, ref, mode=mode, cut=written).write.parquet(f"{path}/{names['documents']}")
        rows.select("event_id", "verdict", "drop_reason", "line").write.parquet(f"{path}/{names['verdicts']}")
        commit(spark, path, {"batch_id": batch_id, **names, "index_built_at": ref.built_at, **counted.get})

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def commit(spark: SparkSession, path: str, row: dict) -> None:
    """One file that is there whole or not at all: written beside, then renamed."""
    final, fs = folder_of(spark, f"{path}/commits/{row['batch_id']}.json")
    beside, _ = folder_of(spark, f"{path}/commits/.{row['batch_id']}-{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(row).encode()))
    out.close()
    if not fs.rename(beside, final) and not fs.exists(final):
        raise OSError(f"{final} can't be written")


def is_committed(spark: SparkSession, path: str, batch_id: int) -> bool:
    p, fs = folder_of(spark, f"{path}/commits/{batch_id}.json")
    return fs.exists(p)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """A row for each committed batch: what it wrote, by which generation, and its counts."""
    p, fs = folder_of(spark, f"{path}/commits")
    return spark.read.schema(COMMIT).json(f"{path}/commits/*.json") if fs.exists(p) else spark.createDataFrame([], COMMIT)


def committed(spark: SparkSession, path: str, part: str = "documents") -> DataFrame:
    """All rows of ``documents`` or ``verdicts`` that a commit names, with their ``batch_id``."""
    names = [f"{path}/{r[part]}" for r in commits(spark, path).select(part).collect()]  # a name a batch
    if not names:
        raise ValueError(f"{path}: nothing committed")
    return spark.read.option("basePath", f"{path}/{part}").option("mergeSchema", "true").parquet(*names).drop("attempt")


def hourly(stream: DataFrame, *, late: str = "1 day", time: str = "ts") -> DataFrame:
    """A streaming histogram; events later than ``late`` are left out."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, "1 hour").alias("_w")).agg(F.count("*").alias("events"))
    return w.select(F.col("_w.start").alias("start"), "events")


def without_repeats(stream: DataFrame, *, late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Only for sources that give an ``event_id`` of their own."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(["event_id"])


def progress(query: StreamingQuery) -> dict:
    """The last batch's number, rows and rate."""
    p = query.lastProgress
    return {} if p is None else {"batch": p["batchId"], "rows": p["numInputRows"], "rate": p["processedRowsPerSecond"]}
