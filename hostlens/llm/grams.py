"""Word and shingle hashes of whole Arrow batches, by numpy over their bytes.

Words are what stands between white space (bytes 9 to 13 and 32), in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once (one document more at most).
CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15  # odd: has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit values (in place)."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA24BAED4963EE407)
    x ^= x >> np.uint64(32)
    return x


def _power_tables() -> list[np.ndarray]:
    """Powers of the base and of its inverse, up to CHUNK bytes: longer texts go piece by piece."""
    if not _powers:
        _powers.extend(np.cumprod(np.array([1] + [b] * (CHUNK - 1), np.uint64), dtype=np.uint64) for b in (_BASE, _INVERSE))
    return _powers


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, first word of each row and the end) of runs of rows."""
    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield at, *_words(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power_tables()
    words, carry = np.empty(len(starts), np.uint64), np.uint64(0)
    for at in range(0, len(data), CHUNK):  # running sums of a piece; a word may end in a later one
        piece = data[at : at + CHUNK]
        scale = [np.uint64(pow(b, at, 1 << 64)) for b in (_BASE, _INVERSE)]
        sums = np.empty(len(piece) + 1, np.uint64)
        sums[0] = carry
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * power[: len(piece)], out=sums[1:])
        sums[1:] *= scale[0]
        sums[1:] += carry
        carry = sums[-1]
        s = slice(*np.searchsorted(starts, (at, at + len(piece))))
        e = slice(*np.searchsorted(ends, (at, at + len(piece)), "right"))
        words[s] = sums[starts[s] - at]
        done = sums[ends[e] - at] - words[e]
        # to the power of where the word begins, here or in an earlier piece
        begin = starts[e]
        if len(begin) and begin[0] < at:
            done[:1] *= np.uint64(pow(_INVERSE, int(begin[0]), 1 << 64))
            done[1:] *= inverse[begin[1:] - at] * scale[1]
        else:
            done *= inverse[begin - at] * scale[1]
        words[e] = done
    return mix(words), np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``size`` words; rows with fewer have one of all theirs."""
    n = np.diff(bounds)
    m = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    rows = np.repeat(np.arange(len(n)), m)
    starts = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(bounds[:-1], m)
    short = np.repeat(n, m)
    out = np.zeros(len(starts), np.uint64)
    factor = 0x8CB92BA72F3D8DD7
    for k in range(size):
        f = np.uint64(pow(factor, k + 1, 1 << 64))
        if (n[n > 0] >= size).all():
            out += words[starts + k] * f
        else:
            ok = short > k
            out[ok] += words[starts[ok] + k] * f
    return mix(out), rows


def counted(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, row) sorted by row and hash, and how often each occurs."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    return h[at], r[at], np.diff(np.append(at, len(h)))
