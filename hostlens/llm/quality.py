"""Compression classifier: zstandard dictionaries of good and of bad text."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches

#: The classifier is fitted on at most so many labelled documents a class for its
#: dictionaries, and as many others for its calibration. They are taken in the order of a
#: hash of their ids and with their whole texts; the dictionaries' documents of a class end
#: with the one that reaches DICT_TEXT bytes.
DICT_DOCS, FIT_DOCS, DICT_TEXT = 1500, 3000, 64 << 20
#: Bytes of a dictionary, and the level of compression.
DICT_BYTES, LEVEL = 112 << 10, 3


def is_held_out(doc_id: Column, folds: int = 5) -> Column:
    """crc32(id as text) mod 5 is 0. A null id counts as an empty text and is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def train_dictionary(texts: list[bytes]) -> bytes:
    """Where zstandard finds too little to train on, the texts themselves."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, texts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(texts)[-DICT_BYTES:]


class Sizes:
    """Compressed sizes of a text under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.by = []
        for d in (good, bad):
            data = zstandard.ZstdCompressionDict(d) if len(d) >= 8 else None
            if data:
                data.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False))

    def difference(self, text: str) -> float:
        """What the good dictionary saves against the bad one, for each byte of the text."""
        raw = text.encode()
        good, bad = (len(c.compress(raw)) for c in self.by)
        return (bad - good) / (len(raw) + 1)


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and offset of the calibration, by Newton's method with a little ridge."""
    mean, dev = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.c_[(x - mean) / dev, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w)), a.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1] / dev, float(w[-1] - (w[:-1] * mean / dev).sum())


class Model:
    """Small (under 300 kB): it goes out with the tasks."""

    def __init__(self, good: bytes, bad: bytes, weight: float | None, offset: float) -> None:
        self.good, self.bad, self.weight, self.offset = good, bad, weight, offset

    def scores(self, sizes: Sizes | None, texts: list[str]) -> np.ndarray:
        if self.weight is None or not texts:
            return np.full(len(texts), 1 / (1 + math.exp(-self.offset)))
        z = np.array([sizes.difference(t) for t in texts]) * self.weight + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def sample(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(the labels to learn from; of each class ``_y`` the first documents ``_t`` by ``_k``).

    At most 2 * (DICT_DOCS + FIT_DOCS) ids a class meet the documents, as a labelled id
    may have none or several.
    """
    lab = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~is_held_out(F.col(id_col))).groupBy(id_col).agg(F.max(label_col).alias("_y"))
    order = [F.xxhash64(F.col(id_col)), F.col(id_col)]
    ids = [lab.filter(F.col("_y") == y).orderBy(*order).limit(2 * (DICT_DOCS + FIT_DOCS)) for y in (0, 1)]
    picked = F.broadcast(ids[0].unionByName(ids[1]))  # 4 * (DICT_DOCS + FIT_DOCS) ids at most
    found = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_t")).join(picked, id_col)
    place = F.row_number().over(Window.partitionBy("_y").orderBy(*order, F.xxhash64("_t")))
    return lab, materialize(found.select("_y", "_t", place.alias("_k")).filter(F.col("_k") <= DICT_DOCS + FIT_DOCS), "quality-sample")


def differences(texts: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """(_y, x) of (_y, _t)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(good, bad)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sizes.difference(t.as_py()) for t in batch.column(1)], pa.float64())], ["_y", "x"])

    return small_batches(texts).select(F.col("_y").cast("int"), "_t").mapInArrow(run, "_y int, x double")


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learns from labelled rows that are not held out (see ``sample`` for their bound).

    An id labelled twice has its larger label. A class with one document only has it in
    its dictionary and in the calibration. With one class only, or none, the model gives
    that class's smoothed share as everyone's score. The calibration's weights of the
    classes are those of all labels.
    """
    lab, rows = sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    n = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}  # two rows
    n = [n.get(y, 0) for y in (0, 1)]
    if not n[0] or not n[1]:
        return Model(b"", b"", None, math.log((n[1] + 1) / (n[0] + 1)))
    k = [min(DICT_DOCS, (m + 1) // 2) for m in n]
    dictionaries = []
    for y in (0, 1):
        texts, size = [], 0
        for r in rows.filter((F.col("_y") == y) & (F.col("_k") <= k[y])).orderBy("_k").select("_t").toLocalIterator():
            texts.append(r["_t"].encode())
            size += len(texts[-1])
            if size >= DICT_TEXT:
                break
        dictionaries.append(train_dictionary(texts))
    bad, good = dictionaries
    fit = F.lit(False)
    for y in (0, 1):
        fit = fit | ((F.col("_y") == y) & (F.col("_k") > (k[y] if n[y] > k[y] else 0)))
    got = differences(rows.filter(fit), good, bad).collect()  # 2 * (DICT_DOCS + FIT_DOCS) numbers at most
    x, y = np.array([r["x"] for r in got]), np.array([float(r["_y"]) for r in got])
    order = np.lexsort((y, x))  # sums don't depend on the order of the rows
    weights, offset = fit_logistic(x[order, None], y[order])
    shares = {r["_y"]: r["n"] for r in lab.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    offset += math.log(shares[1] / shares[0]) - math.log(y.sum() / (len(y) - y.sum()))
    return Model(good, bad, float(weights[0]), offset)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model.good, model.bad) if model.weight is not None else None
        for batch in batches:
            s = model.scores(sizes, [t.as_py() or "" for t in batch.column(batch.schema.get_field_index(text_col))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], [*batch.schema.names, "score"])

    d = docs.drop("score", "predicted")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema)
    return small_batches(d).mapInArrow(run, f"{fields}, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, ``held_out``, ``score``, ``predicted``) of every row.

    Equal texts get equal scores. Repeated rows are scored each; an empty table gives an
    empty result; other columns are not read, and score and id are independent.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    out = score(docs.select(id_col, text_col), model, text_col=text_col, threshold=threshold)
    return out.select(id_col, is_held_out(F.col(id_col)).alias("held_out"), "score", "predicted")
