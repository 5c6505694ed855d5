"""Exact dedup: group by a 128-bit content hash, compare bytes inside the groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalize=ascii_lower, content_hash=md5_128) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when ``normalize(text)`` is the same byte for byte; a null text
    counts as empty. Of equal texts the row with the smallest (or ``keep="largest"``)
    id stays. Rows that repeat an id belong to one document: all of them carry the
    same ``kept``, and each counts in ``group_size``. A null id never wins against
    another; a group of null ids only has ``keep_id`` null and is kept. An empty table
    gives an empty result. Columns other than the two named are not read.

    Plan: hashes (not texts) are grouped, with partial sums before the shuffle. Rows
    whose hash occurs again have their text fetched, by a join on the id that shuffles
    each text once where these ids are too many to broadcast, and equality is decided by
    grouping them on (hash, bytes): a hot group shrinks to one row a task before it is
    shuffled. Where one hash has several texts, the same rows are assigned by their
    bytes instead of by hash.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    src = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def hashed(df: DataFrame) -> DataFrame:
        return df.withColumn("_norm", normalize(F.col("_text"))).withColumn("_h", content_hash(F.col("_norm")))

    sig = materialize(hashed(src).select("_id", "_h", F.sha2("_norm", 256).alias("_sha")), "exact-sig")
    # written apart, so that Spark can split a hot hash's part of the join
    again = materialize(sig.groupBy("_h").agg(F.count("*").alias("_c")).filter("_c > 1").select("_h"), "exact-again")
    ids = sig.join(again, "_h", "left_semi").select("_id").distinct()
    member = hashed(src.join(ids, src["_id"].eqNullSafe(ids["_id"]), "left_semi"))
    classes = member.groupBy("_h", "_norm").agg(best("_id").alias("_keep"), F.count("*").alias("_n"))
    by_hash = materialize(classes.groupBy("_h").agg(F.count("*").alias("_texts"), F.max("_keep").alias("_keep"), F.max("_n").alias("_n")), "exact-classes")

    plain = sig.join(by_hash, "_h", "left")
    collided = by_hash.filter("_texts > 1").select("_h")
    if collided.isEmpty():
        rows = plain.select("_id", "_sha", "_keep", "_n")
    else:
        rows = plain.filter("_texts is null or _texts = 1").select("_id", "_sha", "_keep", "_n")
        apart = hashed(src).join(collided, "_h", "left_semi").select("_id", "_h", "_norm", F.sha2("_norm", 256).alias("_sha"))
        rows = rows.unionByName(apart.join(classes, ["_h", "_norm"]).select("_id", "_sha", "_keep", "_n"))
    keep_id = F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return rows.select(
        F.col("_id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep_id).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
