"""Telephony audio: mu-law and A-law by table, IMA ADPCM across blocks, resampled PCM."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

PCM, ALAW, MULAW, IMA = 1, 6, 7, 17  # format tags of RIFF/WAVE
RATE = 8000
#: Payloads are padded to whole blocks of this many bytes.
BLOCK = 192
#: Payload bytes that are worked on at once: many documents, or a piece of a long one. A
#: whole number of blocks.
CHUNK = (2 << 20) // BLOCK * BLOCK

# Fixed values of the IMA ADPCM format: step sizes, and index changes by code.
IMA_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253,
    279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026,
    4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _mulaw_table() -> np.ndarray:
    """Expansion of G.711 mu-law: inverted code, bias 33 (132 at 16 bits)."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    """Expansion of G.711 A-law: even bits inverted, no segment shift below 2."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    seg, part = code >> 4 & 7, (code & 15) << 4
    size = np.where(seg == 0, part + 8, part + 0x108 << np.maximum(seg - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW_PCM, ALAW_PCM = _mulaw_table(), _alaw_table()


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """(n, size) bytes of mono IMA ADPCM blocks to (n, 2 * (size - 4) + 1) samples.

    The loop goes over the samples of a block; each step decodes all blocks at once. A
    step index over 88 counts as 88.
    """
    value = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8).astype(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((2 * len(codes) + 1, len(blocks)), np.int16)
    out[0] = value
    for k in range(2 * len(codes)):
        code = (codes[k >> 1] >> 4 * (k & 1)).astype(np.int32) & 15
        step = IMA_STEPS[index]
        move = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -move, move), -32768, 32767)
        index = np.clip(index + IMA_INDEX[code & 7], 0, 88)
        out[k + 1] = value
    return out.T


def doubled(pcm: np.ndarray) -> np.ndarray:
    """Resampled to twice the rate: a half-band filter (-1, 9, 9, -1)/16 in whole numbers,
    piece by piece with the neighbours of each."""
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    for at in range(0, len(pcm), CHUNK):
        end = min(at + CHUNK, len(pcm))
        x = pcm[np.clip(np.arange(at - 1, end + 2), 0, len(pcm) - 1)].astype(np.int32)
        out[2 * at + 1 : 2 * end : 2] = np.clip((9 * (x[1:-2] + x[2:-1]) - x[:-3] - x[3:] + 8) >> 4, -32768, 32767)
    return out


def sums(values: np.ndarray, starts: np.ndarray, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums of f(values) from each start to the next. Several documents are one piece; the
    pieces of a long document are summed up one by one."""
    if len(starts) > 1 or len(values) <= CHUNK:
        return np.add.reduceat(f(values), starts, dtype=np.int64)
    return np.array([sum(int(f(values[at : at + CHUNK]).sum(dtype=np.int64)) for at in range(0, len(values), CHUNK))])


def wave(data: bytes, tag: int, rate: int, bits: int, align: int) -> bytes:
    """A mono RIFF/WAVE file; ``data`` has an even length or gets a pad byte."""
    pad = b"\0" * (len(data) % 2)
    fmt = struct.pack("<HHIIHH", tag, 1, rate, rate * align, align, bits)
    return b"RIFF" + struct.pack("<I", 20 + len(fmt) + len(data) + len(pad)) + b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + pad


def read_wave(file: bytes) -> tuple[int, int, int, memoryview]:
    """(tag, rate, align, data) of a file whose chunks may come in any order."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE file")
    at, found = 12, {}
    while at + 8 <= len(file):
        (n,) = struct.unpack_from("<I", file, at + 4)
        found[file[at : at + 4]] = memoryview(file)[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    tag, _, rate, _, align, _ = struct.unpack_from("<HHIIHH", found[b"fmt "])
    return tag, rate, align, found[b"data"]


def to_pcm(file: bytes) -> tuple[int, np.ndarray]:
    """(rate, 16-bit samples) of a mono file in any of the formats above."""
    tag, rate, align, data = read_wave(file)
    raw = np.frombuffer(data, np.uint8)
    if tag == MULAW:
        return rate, MULAW_PCM[raw]
    if tag == ALAW:
        return rate, ALAW_PCM[raw]
    if tag == IMA:
        return rate, decode_ima(raw[: len(raw) // align * align].reshape(-1, align)).ravel()
    if tag == PCM:
        return rate, raw[: len(raw) // 2 * 2].view("<i2")
    raise ValueError(f"format {tag}")


def resample_media(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Stores each file's audio as PCM at twice its rate: (id, ``pcm``, ``error``).

    A null or unreadable file has a null ``pcm`` and says why in ``error``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pcm, error = [], []
            for x in batch.column(1):
                try:
                    if not x.is_valid:
                        raise ValueError("null")
                    rate, samples = to_pcm(x.as_py())
                    pcm.append(wave(doubled(samples).astype("<i2").tobytes(), PCM, 2 * rate, 16, 2))
                    error.append(None)
                except (ValueError, KeyError, struct.error) as e:
                    pcm.append(None)
                    error.append(str(e) or type(e).__name__)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pcm, pa.binary()), pa.array(error, pa.string())], [id_col, "pcm", "error"])

    d = media.select(id_col, media_col)
    return small_batches(d).mapInArrow(run, f"`{id_col}` {d.schema[0].dataType.simpleString()}, pcm binary, error string")


def stored(text: str) -> tuple[int, bytes]:
    """(unpadded length, mu-law file) of a text's bytes, padded by spaces to whole blocks."""
    raw = text.encode()
    return len(raw), wave(raw.ljust(max(-(-len(raw) // BLOCK), 1) * BLOCK, b" "), MULAW, RATE, 8, 1)


def features(files: list[bytes]) -> list[dict]:
    """What the stored bytes of each file say, read back. All in whole numbers, so that
    equal payloads have equal features in any company."""
    data = [read_wave(f)[3] for f in files]
    raw = np.frombuffer(b"".join(data), np.uint8)
    lengths = np.array([len(x) for x in data])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    mu = MULAW_PCM[raw]
    square = lambda x: x.astype(np.int64) ** 2
    energy = sums(mu, starts, square) // lengths
    peak = np.maximum(np.maximum.reduceat(mu, starts).astype(int), -np.minimum.reduceat(mu, starts).astype(int))
    turns = np.append((mu[1:] < 0) != (mu[:-1] < 0), False)
    turns[starts[1:] - 1] = False
    crossings = np.add.reduceat(turns, starts, dtype=np.int64)
    a_energy = sums(raw, starts, lambda x: square(ALAW_PCM[x])) // lengths
    blocks = raw.reshape(-1, BLOCK)
    samples = 2 * (BLOCK - 4) + 1
    decoded = np.concatenate([square(decode_ima(blocks[k : k + CHUNK // BLOCK])).sum(axis=1) for k in range(0, len(blocks), CHUNK // BLOCK)])
    ima_energy = np.add.reduceat(decoded, starts // BLOCK) // (lengths // BLOCK * samples)
    out = []
    for k, (s, n) in enumerate(zip(starts, lengths, strict=True)):
        pcm = wave(doubled(mu[s : s + n]).astype("<i2").tobytes(), PCM, 2 * RATE, 16, 2)
        payload = data[k]
        out.append({
            "payload_bytes": int(n),
            "payload_sha256": hashlib.sha256(payload).hexdigest(),
            "tail_crc32": zlib.crc32(payload[-16:]),
            "media_bytes": len(files[k]),
            "media_sha256": hashlib.sha256(files[k]).hexdigest(),
            "feature": f"mulaw {energy[k]} {peak[k]} {crossings[k]} alaw {a_energy[k]} ima {ima_energy[k]}",
            "pcm_bytes": len(pcm),
            "pcm_sha256": hashlib.sha256(pcm).hexdigest(),
            "pcm": pcm,
        })
    return out


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string"


def telephony(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False, with_pcm: bool = False) -> DataFrame:
    """Each text's bytes as mu-law samples, stored, read back and measured.

    Null texts count as empty, and an empty payload is one block of spaces; the id may
    be null or repeat; an empty table gives an empty result; other columns are not read.
    ``with_media`` adds the file (``media``), ``with_pcm`` the audio expanded and resampled
    to 16 kHz (``pcm``, four bytes for each of the text), which ``pcm_*`` tell of. A task
    holds CHUNK payload bytes and a document at once.
    """
    names = [x.split()[0] for x in FEATURES.split(", ")]
    types = {"long": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                files, sizes, held = [], [], 0
                while at + len(files) < batch.num_rows and held < CHUNK:
                    n, file = stored(batch.column(1)[at + len(files)].as_py() or "")
                    sizes.append(n)
                    files.append(file)
                    held += len(file)
                rows = features(files)
                cols = [batch.column(0).slice(at, len(files)), pa.array(sizes, pa.int64())]
                cols += [pa.array([r[n] for r in rows], types[x.split()[1]]) for n, x in zip(names, FEATURES.split(", "), strict=True)]
                if with_media:
                    cols.append(pa.array(files, pa.binary()))
                if with_pcm:
                    cols.append(pa.array([r["pcm"] for r in rows], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, [id_col, "n_bytes", *names, *["media"] * with_media, *["pcm"] * with_pcm])
                at += len(files)

    d = docs.select(id_col, text_col)
    return small_batches(d).mapInArrow(run, f"`{id_col}` {d.schema[0].dataType.simpleString()}, n_bytes long, {FEATURES}" + ", media binary" * with_media + ", pcm binary" * with_pcm)
