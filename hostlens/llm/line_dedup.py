"""Line dedup: range-partitioned line hashes, streamed first occurrences, keep bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

#: A key is hot from this part of all lines on, or from a shuffle partition's mean where
#: there are more partitions, so there are at most as many hot keys; they are broadcast.
#: Below HOT_LEAST rows no key is worth splitting.
HOT_SHARE, HOT_LEAST = 1000, 2000
#: Slots that a hot key's lines are dealt into, or as many as partitions if these are more.
SLOTS = 128


def line_key(line: Column) -> Column:
    """The line without spaces and U+0009 to U+000D at its ends, A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(" \t\n\x0b\x0c\r")))


def line_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """Compressed bitmaps of the lines to drop: (id, ``text_hash``, ``n_dropped``, ``words``).

    ``words`` is a sorted array of (word, bits): bit b of word w stands for line
    64 * w + b, words without a dropped line are left out, and documents that keep
    all their lines have no row. Lines whose key has at least ``min_chars`` code
    points stay only in the smallest id that holds the key. Rows of one id are one
    document (``text_hash`` tells them apart); a null id comes after all others.

    Key hashes (128 bits) are range-partitioned and sorted by document and position;
    a running window streams each key's first document, holding no group. A key with
    over 1/1000 of all lines, or over a partition's mean if that is less, is dealt into
    slots whose first documents meet the key's own, taken from partial minima.
    """
    key = F.col("_key")
    src = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    lines = (
        src.select("_id", F.xxhash64("_text").alias("_th"), F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
        .withColumn("_key", line_key(F.col("_line")))
        .filter(F.length(key) >= min_chars)
        .select("_id", "_th", "_pos", F.xxhash64(key).alias("_h1"), F.xxhash64(F.lit("second"), key).alias("_h2"))
    )
    lines = materialize(lines.withColumn("_ord", F.coalesce("_id", F.lit((1 << 63) - 1))), "line-keys")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = max(HOT_LEAST, lines.count() // max(HOT_SHARE, partitions))
    hot = lines.groupBy("_h1", "_h2").agg(F.count("*").alias("_n"), F.min("_ord").alias("_first")).filter(F.col("_n") > least).drop("_n")
    dealt = lines.join(F.broadcast(hot), ["_h1", "_h2"], "left").withColumn(
        "_slot", F.when(F.col("_first").isNull(), 0).otherwise(F.pmod(F.xxhash64("_ord"), F.lit(max(SLOTS, partitions)))).cast("int")
    )
    by_key = ["_h1", "_h2", "_slot"]
    ordered = dealt.repartitionByRange(*by_key).sortWithinPartitions(*by_key, "_ord", "_pos")
    running = Window.partitionBy(*by_key).orderBy("_ord", "_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.least(F.first("_ord").over(running), F.col("_first"))
    dropped = ordered.withColumn("_lead", first).filter("_ord > _lead")
    words = dropped.groupBy("_id", "_th", F.expr("_pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, _pos % 64)")).alias("bits"))
    return words.groupBy("_id", "_th").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words")
    ).select(F.col("_id").alias(id_col), F.col("_th").alias("text_hash"), "n_dropped", "words")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``_kept_text``, ``n_lines`` and ``n_dropped``.

    All columns stay but those with the names of these three, which are replaced. Ids
    are whole numbers.
    """
    b = bitmaps.select(F.col(id_col).alias("_b_id"), F.col("text_hash").alias("_b_th"), F.struct("n_dropped", "words").alias("_b"))
    d = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("_d"), F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).withColumn("_th", F.xxhash64("_t"))
    joined = d.join(b, d["_id"].eqNullSafe(b["_b_id"]) & (d["_th"] == b["_b_th"]), "left").withColumn("_lines", F.split("_t", "\n"))
    gone = F.expr(
        "flatten(transform(_b.words, w -> transform(filter(sequence(0, 63), b -> (shiftright(w.bits, b) & 1L) = 1L), b -> w.word * 64 + b)))"
    )
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), gone)
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("_lines"), i)), "\n")
    new = [F.when(F.col("_b").isNull(), F.col("_t")).otherwise(kept).alias("_kept_text"), F.size("_lines").cast("long").alias("n_lines"), F.coalesce("_b.n_dropped", F.lit(0)).cast("long").alias("n_dropped")]
    stay = [F.col(f"_d.`{c}`").alias(c) for c in docs.columns if c not in ("_kept_text", "n_lines", "n_dropped")]
    return joined.select("_d", F.struct(*new).alias("_new")).select(*stay, "_new.*")  # in two steps: names may clash


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(id, ``n_lines``, ``n_dropped``, ``kept_sha256``) of every row.

    A null or empty text is one empty line; an empty table gives an empty result. An
    empty kept text and one whose lines are all gone have the hash of no bytes.
    """
    docs = docs.select(id_col, text_col)
    out = apply_bitmaps(docs, line_bitmaps(docs, id_col=id_col, text_col=text_col, min_chars=min_chars), id_col=id_col, text_col=text_col)
    return out.select(id_col, "n_lines", "n_dropped", F.sha2("_kept_text", 256).alias("kept_sha256"))
