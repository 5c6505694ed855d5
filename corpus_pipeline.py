"""From raw documents to tokens: five stages, each over all that the one before kept.

For every stage: a null text counts as empty, rows without an id or with one that repeats
are rows of their own, columns beside those of documents are left out, and an empty table
gives an empty result. Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.llm.common import materialize, table
from hostlens.llm.line_dedup import apply_bitmaps, line_bitmaps
from hostlens.llm.mixing import mix
from hostlens.llm.near_dedup import near_classes
from hostlens.llm.quality import score, train
from hostlens.llm.queries import model_path
from hostlens.llm.sentencepiece_bpe import encode_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go, each row by its own text.

    Without labels of both classes the smoothed share of the one decides for all alike.
    """
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs.select(COLUMNS), model).filter("predicted = 1").select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; documents of which nothing is left too.

    Documents that were empty before stay. Rows without an id come last, as one document.
    """
    kept = apply_bitmaps(docs.select(COLUMNS), line_bitmaps(docs)).withColumn("text", F.col("_kept_text"))
    kept = kept.filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays.

    Rows without an id are judged by their texts; of equal ones a single row stays, as of
    rows that repeat both id and text. A null or empty text is only like another such.
    """
    return near_classes(docs, keep=COLUMNS).filter("kept").select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it (none, once or twice).

    Null and repeated ids are rows of their own, each with its own copies. Texts without
    words are taken once; a null source is a source.
    """
    taken = mix(docs, keep=COLUMNS).filter("copies > 0").select("row.*", "copies")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, as digests and with their count."""
    return encode_documents(docs, model_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_copies),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)


#: Neither the classifier nor the mix can be said in SQL; tests hold stages against brute force.
ORACLE_SQL = None
