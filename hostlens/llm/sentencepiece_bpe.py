"""SentencePiece (merge type) encoding by a prefix table, and decoding.

For merge-type models each prefix of a text has one last token only. A pass over the
text stores it: of the pieces that end at a position (found by an Aho-Corasick
automaton), it is the one compatible with the last token of what stands before it. Two
tokens are compatible when their joint text encodes to just these two. The ids are then
read backwards from the end. The table needs time linear in the length of the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

SPACE = "▁"
#: Entries of a worker's memo of encoded words; when full it becomes the older memo. And
#: answers on pairs of tokens that are remembered; when full they are forgotten.
MEMO, PAIRS = 100_000, 300_000
#: Longer words are not remembered.
MEMO_CHARS = 64

#: Letters after a space run, other characters after one, or a line feed. No piece of the
#: models taken here holds a space after another character, a line feed beside one, or
#: a letter beside another kind of character (superscript and fraction digits count as
#: no letters); no merge crosses such a border, and what lies between is encoded alone.
ODD = "\u00b2\u00b3\u00b9\u00bc-\u00be"
WORDS = re.compile(rf"{SPACE}*[^\W\d_{ODD}]+|{SPACE}+[\d_{ODD}]*(?:[^\w\n{SPACE}]+[\d_{ODD}]*)*|(?:[^\w\n{SPACE}]|[\d_{ODD}])+|\n")


def load_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id; kind 0: control or unknown, 1: normal, 2: byte."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: 2 if sp.is_byte(i) else 0 if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else 1
    pieces = [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())]
    normal = [p for p, _, k in pieces if k == 1]
    if any(len(WORDS.findall(p)) > 1 for p in normal) or sum(k == 2 for *_, k in pieces) != 256 or sp.decode(sp.encode("  a  b ")) != "  a  b ":
        raise ValueError(f"{path}: needs a merge-type model with byte fallback, identity normalisation, a prefix space and pieces within words")
    return pieces


class Coder:
    def __init__(self, pieces: list[tuple[str, float, int]]) -> None:
        normal = [(p, s, i) for i, (p, s, k) in enumerate(pieces) if k == 1]
        self.ids = {p: i for p, _, i in normal}
        self.score = {p: s for p, s, _ in normal}
        self.known = {c for p in self.ids for c in p}
        self.byte_id = {int(p[1:-1], 16): i for i, (p, _, k) in enumerate(pieces) if k == 2}
        self.bytes = [bytes([int(p[1:-1], 16)]) if k == 2 else p.replace(SPACE, " ").encode() if k == 1 else b"" for p, _, k in pieces]
        self.found = ahocorasick.Automaton()
        for p in self.ids.keys() | self.known:  # a known character that is no piece ends up as bytes unless merged
            csv = str(self.ids[p]) if p in self.ids else self.byte_ids(p)
            # length, piece, ids, what they decode to, and what may follow
            self.found.add_word(p, (len(p), p, csv, p.replace(SPACE, " "), {}))
        self.found.make_automaton()
        self.begin = (0, "", "", "", {})
        self.pairs = 0
        self.edges: dict[str, tuple[list, list] | None] = {}
        self.memo: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}

    def merged(self, text: str) -> list[str]:
        """By the definition: the best-scored pair merges first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score.get(a + b, float("-inf")), -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] == float("-inf"):
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def edge_lives(self, piece: str) -> tuple[list, list] | None:
        """Of the symbols at the right and at the left end while the piece is built:
        (symbol, score of the merge that made it, of the one that ends it). None if the
        piece is no encoding of itself, or isn't built from the best score down."""
        if piece not in self.edges:
            parts, now = list(piece), float("inf")
            lives = [[parts[-1], now, None]], [[parts[0], now, None]]
            while len(parts) > 1:
                best, i = max((self.score.get(a + b, float("-inf")), -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if best == float("-inf") or best > now:
                    break
                now, i = best, -i
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                for side, at in ((lives[0], len(parts) - 1), (lives[1], 0)):
                    if side[-1][0] != parts[at]:
                        side[-1][2] = now
                        side.append([parts[at], now, None])
            for side in lives:
                side[-1][2] = float("-inf")
            self.edges[piece] = lives if len(parts) == 1 else None
        return self.edges[piece]

    def meets(self, a: str, b: str) -> bool:
        """Whether a and b stay apart: no pair of symbols at the border merges while both live.

        A merge at the border comes before one of equal score on its right and after one
        on its left.
        """
        left, right = self.edge_lives(a), self.edge_lives(b)
        if left is None or right is None:
            return self.merged(a + b) == [a, b]
        score = self.score
        for x, made_x, ends_x in left[0]:
            for y, made_y, ends_y in right[1]:
                s = score.get(x + y)
                if s is not None and (at := min(s, made_x, made_y)) > ends_x and at >= ends_y:
                    return False
        return True

    def compatible(self, a: tuple, b: tuple) -> bool:
        """a may be the beginning of the text."""
        self.pairs += 1
        if self.pairs > PAIRS:
            self.pairs = 0
            for token in [self.begin, *self.found.values()]:
                token[4].clear()
        got = a[4][b[1]] = self.meets(a[1], b[1]) if a[0] else self.merged(b[1]) == [b[1]]
        return got

    def tokens(self, run: str) -> list[tuple] | None:
        """The tokens of a run; null if it has unknown characters."""
        last: list = [None] * (len(run) + 1)
        last[0] = self.begin
        for end, token in self.found.iter(run):
            end += 1
            if last[end] is None:
                before = last[end - token[0]]
                if before is not None:
                    fit = before[4].get(token[1])
                    if self.compatible(before, token) if fit is None else fit:
                        last[end] = token
        out, end = [], len(run)
        while end:
            token = last[end]
            if token is None:
                return None
            out.append(token)
            end -= token[0]
        out.reverse()
        return out

    def byte_ids(self, text: str) -> str:
        return ",".join(str(self.byte_id[b]) for b in text.encode())

    def part(self, part: str) -> tuple[str, str]:
        got = self.tokens(part)
        if got is not None:
            return ",".join([x[2] for x in got]), "".join([x[3] for x in got])
        found, start = [], 0
        for i in range(len(part) + 1):
            if i == len(part) or part[i] not in self.known:
                known = self.tokens(part[start:i])
                if known is None:  # cannot be: each known character is a token
                    raise ValueError(f"no tokens for {part[start:i]!r}")
                found += [x[2:4] for x in known]
                if i < len(part):
                    found.append((self.byte_ids(part[i]), part[i]))
                start = i + 1
        return ",".join([x[0] for x in found]), "".join([x[1] for x in found])

    def encode(self, text: str) -> list[int]:
        csv = self.text(text)[0]
        return [int(x) for x in csv.split(",")] if csv else []

    def decode(self, ids: Iterable[int]) -> str:
        """Bytes that are no UTF-8 (never from ``encode``) become U+FFFD."""
        return b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace").removeprefix(" ")

    def coded(self, word: str) -> tuple[str, str]:
        """Ids joined by commas, and what they decode to."""
        got = self.older.get(word) or self.part(word)
        if len(word) <= MEMO_CHARS:
            if len(self.memo) >= MEMO:
                self.older, self.memo = self.memo, {}
            self.memo[word] = got
        return got

    def text(self, text: str) -> tuple[str, str]:
        """The ids joined by commas and what they decode to."""
        if not text:
            return "", ""
        memo, coded = self.memo, self.coded
        got = [memo.get(w) or coded(w) for w in WORDS.findall(SPACE + text.replace(" ", SPACE))]
        return ",".join([x[0] for x in got]), "".join([x[1] for x in got]).removeprefix(" ")


    def round_trip(self, text: str) -> tuple[str, list[int], str]:
        """The ids joined by commas, the ids, and what decoding those gives."""
        csv = self.text(text)[0]
        ids = list(map(int, csv.split(","))) if csv else []
        return csv, ids, self.decode(ids)


_coders: dict[int, Coder] = {}


def coder(pieces: list[tuple[str, float, int]]) -> Coder:
    """One for each model and worker."""
    key = hash(tuple(pieces))
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(pieces)
    return _coders[key]


def encode_documents(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``) of every row, by the model at ``model``.

    ``decoded`` is what decoding the ids gives. With ``with_ids`` also ``ids`` (int array)
    and ``decoded``. No begin or end ids. A
    null text counts as empty and has no ids; a null id stays null; rows that repeat are
    each encoded; other columns are not read. The pieces (some 32,000, read by the
    driver) go out with the task; there is no shuffle.
    """
    pieces = load_pieces(model)
    more = [("ids", pa.list_(pa.int32()), "array<int>"), ("decoded", pa.string(), "string")] if with_ids else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(pieces)
        for batch in batches:
            n, ids_sha, text_sha, ids, texts = [], [], [], [], []
            for t in batch.column(1):
                csv, own, decoded = c.round_trip(t.as_py() or "")
                n.append(len(own))
                ids_sha.append(hashlib.sha256(csv.encode()).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    ids.append(own)
                    texts.append(decoded)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array(ids, more[0][1]), pa.array(texts, more[1][1])]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)
        pa.default_memory_pool().release_unused()

    d = docs.select(id_col, text_col)
    schema = ", ".join([f"`{id_col}` {d.schema[0].dataType.simpleString()}", "n_tokens long, ids_sha256 string, decoded_sha256 string", *(f"{n} {t}" for n, _, t in more)])
    return small_batches(d).mapInArrow(run, schema)
