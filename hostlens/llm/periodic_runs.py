"""Periodic runs of words: minimizers at several scales seed them, short periods are scanned."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Periods up to this are found by a scan at each lag.
SCANNED = 24
#: Words that are worked on at once: many documents, or one long one.
CHUNK = 400_000
#: Words that a seed's extension compares at a time.
STRIDE = 4096

Run = tuple[int, int, int]  # start, end, period


def scales(longest: int, scanned: int) -> Iterator[tuple[int, int, int, int]]:
    """(least period, greatest period, gram, window) that together cover all periods over
    ``scanned`` of runs with three periods in ``longest`` words.

    A gram of at least a period occurs in the run at whole periods' distance only. Gram
    and window fit twice, one period apart, into three periods. So the window's minimum
    and the next equal gram are a period apart.
    """
    least = scanned + 1
    while 3 * least <= longest:
        greatest = least + (least + 1) // 2 - 1
        yield least, greatest, greatest, 2 * least + 1 - greatest
        least = greatest + 1


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, neither linear in them nor the same when they change places."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


class Grams:
    """Hashes of all stretches of a length, from those of powers of two."""

    def __init__(self, codes: np.ndarray) -> None:
        start = codes.astype(np.uint64)
        self.powers = [mixed(start, start)]

    def of(self, size: int) -> np.ndarray:
        top = size.bit_length() - 1
        while len(self.powers) <= top:
            h, step = self.powers[-1], 1 << len(self.powers) - 1
            self.powers.append(mixed(h[:-step], h[step:]))
        h, rest = self.powers[top], size - (1 << top)
        return mixed(h[: len(h) - rest], h[rest:]) if rest else h


def sliding(h: np.ndarray, size: int, f: np.ufunc) -> np.ndarray:
    """f over each window of ``size``, by doubling."""
    done = 1
    while done < size:
        step = min(done, size - done)
        h = f(h[:-step], h[step:])
        done += step
    return h


def minimizers(h: np.ndarray, window: int) -> np.ndarray:
    """Places that are the least of some window which holds them (all of them on ties)."""
    low = sliding(h, window, np.minimum)
    edge = np.zeros(window - 1, h.dtype)
    best = sliding(np.concatenate((edge, low, edge)), window, np.maximum)
    return np.flatnonzero(best == h)


def stretches(at: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """(first, end) of whole numbers in a row in sorted ``at``, of ``least`` or more."""
    if len(at) < least:
        return
    cut = np.flatnonzero(np.diff(at) != 1) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(at)]))
    for k in np.flatnonzero(last - first >= least):
        yield int(at[first[k]]), int(at[last[k] - 1]) + 1


def reach(x: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The stretch of places i around ``at`` with x[i] == x[i + lag]."""
    first, end, most = at, at, len(x) - lag
    while end < most:
        stop = min(end + STRIDE, most)
        differ = np.flatnonzero(x[end:stop] != x[end + lag : stop + lag])
        if len(differ):
            end += int(differ[0])
            break
        end = stop
    while first > 0:
        stop = max(first - STRIDE, 0)
        differ = np.flatnonzero(x[stop:first] != x[stop + lag : first + lag])
        if len(differ):
            first = stop + int(differ[-1]) + 1
            break
        first = stop
    return first, end


def seeded(x: np.ndarray, grams: Grams, least: int, greatest: int, gram: int, window: int, min_length: int) -> Iterator[Run]:
    """Runs with a period of one scale, from adjacent equal minimizers."""
    h = grams.of(gram) if len(x) >= gram else x[:0].astype(np.uint64)
    if len(h) < window:
        return
    at = minimizers(h, window)
    order = np.argsort(h[at], kind="stable")
    places, names = at[order], h[at][order]
    lags = np.diff(places)
    found = np.flatnonzero((names[1:] == names[:-1]) & (lags >= least) & (lags <= greatest))
    if not len(found):
        return
    places, lags = places[found], lags[found]
    known: dict[int, int] = {}  # lag: end of what was compared last
    for k in np.lexsort((places, lags)):
        lag, place = int(lags[k]), int(places[k])
        if place >= known.get(lag, 0):
            first, end = reach(x, place, lag)
            known[lag] = end
            if end - first >= max(2 * lag, min_length - lag):
                yield first, end + lag, lag


def find_runs(codes: np.ndarray, starts: np.ndarray, *, min_length: int = 24, scanned: int = SCANNED) -> list[list[Run]]:
    """For each document the runs with three or more periods, sorted, from all documents'
    word codes and where each begins.

    Before each document stands a code that is nowhere else, so that no run goes across.
    A stretch with two periods has the smaller one, as it is three of the greater long
    and so the smaller divides it. Time is near linear in the words.
    """
    sizes = np.diff(np.append(starts, len(codes)))
    longest = int(sizes.max(initial=0))

    def joined(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of some documents, each after a mark of its own; where each begins."""
        keep = np.repeat(which, sizes)
        n = sizes[which]
        begin = np.concatenate(([0], np.cumsum(n + 1)))[:-1] + 1
        out = np.empty(int((n + 1).sum()), np.int32)
        marks = np.zeros(len(out), bool)
        marks[begin - 1] = True
        out[marks] = -1 - np.arange(len(n))
        out[~marks] = codes[keep]
        return out, begin

    found: list[dict[tuple[int, int], int]] = [{} for _ in starts]

    def add(which: np.ndarray, begin: np.ndarray, runs: Iterator[Run]) -> None:
        ids = np.flatnonzero(which)
        for first, end, period in runs:
            k = int(np.searchsorted(begin, first, "right")) - 1
            at = (first - int(begin[k]), end - int(begin[k]))
            own = found[ids[k]]
            own[at] = min(period, own.get(at, period))

    def scan(x: np.ndarray, lag: int) -> Iterator[Run]:
        for first, end in stretches(np.flatnonzero(x[lag:] == x[:-lag]), max(2 * lag, min_length - lag)):
            yield first, end + lag, lag

    which = sizes >= min_length
    if which.any():
        x, begin = joined(which)
        for lag in range(1, scanned + 1):
            if max(3 * lag, min_length) <= longest:
                add(which, begin, scan(x, lag))
    x = None
    for least, greatest, gram, window in scales(longest, scanned):
        now = sizes >= max(3 * least, min_length)
        if x is None or now.sum() < which.sum():
            which = now
            x, begin = joined(which)
            grams = Grams(x)
        add(which, begin, seeded(x, grams, least, greatest, gram, window, min_length))
    return [sorted((s, e, p) for (s, e), p in own.items()) for own in found]


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """Without what repeats: of each run the words after its first period."""
    gone = np.zeros(len(words), bool)
    for first, end, period in runs:
        gone[first + period : end] = True
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def greatest(runs: list[Run]) -> Run | None:
    """By exact length / period; of equals the first start, then the least period."""
    best = None
    for run in runs:
        if best is None or (run[1] - run[0]) * best[2] > (best[1] - best[0]) * run[2]:
            best = run
    return best


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = 24, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(id, ``runs``, ``best``, ``collapsed``) of every row.

    Words are what stands between spaces and U+0009 to U+000D. A run is a stretch of at
    least ``min_length`` words and three of its least periods, which neither neighbour
    extends; ``runs`` are (start, length, period) by start and period, ``best`` is the one
    with most periods. ``collapsed`` has the words left when each run keeps its first
    period, joined by spaces. ``prepare`` may change a document's words first.

    A null or empty text has no words, no runs and an empty ``collapsed``; ids may be null
    or repeat; an empty table gives an empty result; other columns are not read. A task
    holds ``CHUNK`` words and a document at once; nothing is shuffled.
    """
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    said = lambda r: r and {"start": r[0], "length": r[1] - r[0], "period": r[2]}

    def rows(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        codes = pa.array([w for words in texts for w in words], pa.large_binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32)
        sizes = np.array([len(words) for words in texts], np.int64)
        runs = find_runs(codes, np.cumsum(sizes) - sizes, min_length=min_length)
        kept = [b" ".join(kept_words(words, own) if own else words) for words, own in zip(texts, runs, strict=True)]
        columns = [ids, pa.array([[said(r) for r in own] for own in runs], pa.list_(run_type)), pa.array([said(greatest(own)) for own in runs], run_type), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, [id_col, "runs", "best", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, texts = 0, 0, []
            for at, (key, text) in enumerate(zip(batch.column(0), batch.column(1), strict=True)):
                words = (text.as_py() or "").encode().split()
                texts.append(prepare(key.as_py(), words) if prepare else words)
                held += len(words)
                if held >= CHUNK:
                    yield rows(batch.column(0).slice(first, at + 1 - first), texts)
                    first, held, texts = at + 1, 0, []
            if texts:
                yield rows(batch.column(0).slice(first), texts)

    d = docs.select(id_col, text_col)
    kind = d.schema[0].dataType.simpleString()
    return small_batches(d).mapInArrow(run, f"`{id_col}` {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, best struct<start: bigint, length: bigint, period: bigint>, collapsed string")


def with_planted_run(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """By the CRC-32 of its id, one document in ten repeats some of its own words to its
    end. A null id changes nothing."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    at = g % n
    period = 1 + (n - at) // (3 + g % 8)
    return words[:at] + [words[at + (i - at) % period] for i in range(at, n)]


def run_digests(found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(id, ``n_runs``, the best run's start, length, period and ``exponent_milli``,
    ``runs_sha256``, ``collapsed_sha256``) from ``periodic_runs``."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
