"""WARC archives: one gzip member a record, written by Spark tasks and read record by record."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir

#: Payloads of at least this many bytes are stored once.
LEAST_PAYLOAD = 1000
#: An archive ends with the record that reaches this many compressed bytes.
ARCHIVE_BYTES = 256 << 20
#: Compressed bytes read, and plain bytes inflated, at a time.
PIECE = 1 << 16
#: A header longer than this is no header.
MOST_HEADER = 1 << 20
#: Records of a batch that goes back to Spark end with the one that reaches this size.
BATCH_BYTES = 8 << 20

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date of all records: the tables have none, and reruns shall agree.
DATE = "2000-01-01T00:00:00Z"

HEAD = "path string, offset long, error string, type string, record_id string, target_uri string, page string, refers_to string, content_length long, block_sha1 string, payload_bytes long, payload_sha1 string, verified boolean"


def sha1_name(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def one_line(value: str) -> str:
    """Header values hold no line ends; in a target they are percent-encoded."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as one gzip member."""
    fields = [*fields, ("WARC-Block-Digest", sha1_name(hashlib.sha1(block).digest())), ("Content-Length", str(len(block)))]
    head = "\r\n".join([VERSION, *(f"{k}: {v}" for k, v in fields)]) + "\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def record_id(page: str | None, payload_sha1: str) -> str:
    """The same for one page with one payload, so that a revisit can name it."""
    return f"<urn:uuid:{uuid.uuid4() if page is None else uuid.uuid5(uuid.NAMESPACE_OID, f'{page} {payload_sha1}')}>"


def page_record(page: str | None, url: str | None, payload: bytes, payload_sha1: str, *, lead: str | None) -> bytes:
    """A response with its payload, or where ``lead`` names the page that has it a revisit.

    Both have the header that HTTP sent, and so the length of the whole payload, and the
    payload's digest.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "response" if lead is None else "revisit"),
        ("WARC-Record-ID", record_id(page, payload_sha1)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", one_line(url or "about:blank")),
        ("WARC-Payload-Digest", sha1_name(bytes.fromhex(payload_sha1))),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page is not None:
        fields.append(("X-Page-ID", page))
    if lead is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(lead, payload_sha1)), ("X-Refers-To-Page-ID", lead)]
    return member(fields, http + payload if lead is None else http)


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """A folder or file by its URI, or by an absolute path of a shared mount."""
    return fs.FileSystem.from_uri(uri if re.match(r"[A-Za-z][\w+.-]*:", uri) else f"file://{uri}")


class Archive:
    """Writes members to one file after another, each under a name of its own."""

    def __init__(self, folder: str, limit: int) -> None:
        self.fs, self.folder = store(folder)
        self.limit, self.out = limit, None
        self.done: list[tuple[str, int, int]] = []  # name, records, bytes

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.name, self.records, self.size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None)
            about = b"software: hostlens\r\nformat: WARC File Format 1.1\r\n"
            self._put(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(self.name[:32])}>"), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], about))
        self._put(record)
        self.records += 1
        if self.size >= self.limit:
            self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None
            self.done.append((self.name, self.records, self.size))


def with_leads(pages: DataFrame, *, least: int) -> DataFrame:
    """(page, url, payload, sha1, ``lead``) from (page, url, payload): of equal payloads of
    at least ``least`` bytes the largest page, where a row is not of it.

    Sums by digest are partial; only payloads that repeat are joined back, and there a hot
    payload's rows can be split, as nothing above the join needs them together.
    """
    rows = pages.select("page", "url", "payload", F.sha1("payload").alias("sha1"), F.when(F.octet_length("payload") >= least, F.unhex(F.md5("payload"))).alias("_second"))
    seen = rows.filter(F.col("_second").isNotNull()).groupBy("sha1", "_second").agg(F.max("page").alias("_most"), F.count("*").alias("_n")).filter("_n > 1")
    known = materialize(seen.select("sha1", "_second", "_most"), "warc-repeated")
    joined = rows.join(known, ["sha1", "_second"], "left")
    return joined.select("page", "url", "payload", "sha1", F.when(~F.col("page").eqNullSafe(F.col("_most")), F.col("_most")).alias("lead"))


def write_archives(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_PAYLOAD, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each row; (``path``, ``n_records``, ``n_bytes``) of the archives.

    Of rows with equal payloads of at least ``least`` bytes, those with the largest id are
    responses (several where rows repeat it) and the others revisit it; a null id is no
    largest one, so that rows which all have null ids are responses. Null html is an empty
    payload, a null url ``about:blank``. An empty table gives no archive.

    The folder is the session's shared one. A task that runs again writes under new names,
    and only files that a finished task told of are in the result.
    """
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    files, path = store(folder)
    files.create_dir(path, recursive=True)
    p = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = with_leads(p, least=least).select(F.col("page").cast("string"), "url", "payload", "sha1", F.col("lead").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = Archive(folder, limit)
        try:
            for batch in batches:
                for page, url, payload, sha1, lead in zip(*batch.columns, strict=True):
                    archive.add(page_record(page.as_py(), url.as_py(), payload.as_py(), sha1.as_py(), lead=lead.as_py()))
        finally:
            archive.close()
        names, records, sizes = zip(*archive.done, strict=True) if archive.done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n in names], pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], ["path", "n_records", "n_bytes"])

    return materialize(rows.mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-archives")


class Reader:
    """The records of one archive in their order, holding a piece of it at a time.

    Members are inflated piece by piece; a record is framed by its Content-Length. What
    breaks a member (no gzip, cut short, bad checksum, no header, wrong length) ends the
    archive with a row that names the place; a digest that differs leaves it readable.
    """

    def __init__(self, source: BinaryIO, *, with_payload: bool) -> None:
        self.source, self.with_payload = source, with_payload
        self.held = b""  # compressed bytes that were read and not used
        self.at = 0  # where they begin

    def _inflated(self) -> Iterator[bytes]:
        """The plain bytes of the next member; nothing at the end of the archive."""
        z = zlib.decompressobj(31)
        begun = False
        while not z.eof:
            data = z.unconsumed_tail or self.held or self.source.read(PIECE)
            if not data:
                if begun:
                    raise ValueError("the archive ends within a member")
                return
            begun = True
            if not z.unconsumed_tail:
                self.held = b""
                self.at += len(data)
            if plain := z.decompress(data, PIECE):
                yield plain
        self.held = z.unused_data
        self.at -= len(self.held)

    def records(self) -> Iterator[dict]:
        while True:
            began = self.at
            try:
                row = self._record(self._inflated())
            except (ValueError, zlib.error) as e:
                yield {"offset": began, "error": str(e), "verified": False}
                return
            if row is None:
                return
            yield row | {"offset": began}

    def _record(self, pieces: Iterator[bytes]) -> dict | None:
        head = b""
        while (end := head.find(b"\r\n\r\n")) < 0:
            if (piece := next(pieces, None)) is None:
                if not head:
                    return None
                raise ValueError("no end of the header")
            head += piece
            if len(head) > MOST_HEADER:
                raise ValueError("no end of the header")
        fields = parse_header(head[:end])
        length = int(fields.get("content-length", "no length"))
        block = Block(fields, length, with_payload=self.with_payload)
        rest = block.add(head[end + 4 :])
        for piece in pieces:
            rest += block.add(piece)
            if len(rest) > 4:
                break
        if block.missing or rest != b"\r\n\r\n":
            raise ValueError(f"Content-Length is {length}, which the member does not have")
        return block.row()


def parse_header(head: bytes) -> dict[str, str]:
    """Fields by their names in lower case; a line that begins with a space goes on."""
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC header")
    fields: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
        else:
            name, colon, value = line.partition(":")
            if not colon:
                raise ValueError("no WARC header")
            name = name.strip().lower()
            fields[name] = value.strip()
    return fields


def same_digest(said: str | None, found: str) -> bool:
    """Whether a header's digest (base 32 or hex) is ``found``; other kinds are not told."""
    kind, _, value = (said or "").partition(":")
    if kind.lower() != "sha1" or not value:
        return True
    return value.lower() == found or value.upper() == base64.b32encode(bytes.fromhex(found)).decode()


def bare_digest(said: str | None) -> str | None:
    """A header's SHA-1 in lower-case hex."""
    kind, _, value = (said or "").partition(":")
    if kind.lower() != "sha1":
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


class Block:
    """A record's block, hashed as it comes; of HTTP records also what follows its header."""

    def __init__(self, fields: dict[str, str], length: int, *, with_payload: bool) -> None:
        self.fields, self.missing, self.length = fields, length, length
        self.block, self.payload = hashlib.sha1(), hashlib.sha1()
        self.http: bytes | None = b"" if fields.get("content-type", "").startswith("application/http") else None
        self.payload_bytes = 0
        self.kept: list[bytes] | None = [] if with_payload else None

    def add(self, data: bytes) -> bytes:
        """Takes what belongs to the block and gives back the rest."""
        own, rest = data[: self.missing], data[self.missing :]
        self.missing -= len(own)
        self.block.update(own)
        if self.http is not None and b"\r\n\r\n" not in self.http:
            self.http += own
            head, gap, own = self.http.partition(b"\r\n\r\n")
            self.http = head + gap
        self.payload.update(own)
        self.payload_bytes += len(own)
        if self.kept is not None:
            self.kept.append(own)
        return rest

    def row(self) -> dict:
        f = self.fields
        found, payload = self.block.hexdigest(), self.payload.hexdigest()
        kind = f.get("warc-type")
        verified = same_digest(f.get("warc-block-digest"), found)
        n, sent = self.payload_bytes, payload
        if kind == "revisit":  # its payload is elsewhere: what the two headers say of it
            m = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", self.http or b"")
            n, sent = int(m[1]) if m else None, bare_digest(f.get("warc-payload-digest"))
        elif kind == "response":
            verified = verified and same_digest(f.get("warc-payload-digest"), payload)
        return {
            "error": None, "type": kind, "record_id": f.get("warc-record-id"), "target_uri": f.get("warc-target-uri"), "page": f.get("x-page-id"), "refers_to": f.get("x-refers-to-page-id"),
            "content_length": self.length, "block_sha1": found, "payload_bytes": n, "payload_sha1": sent, "verified": verified, "payload": b"".join(self.kept) if self.kept is not None else None,
        }


def read_archives(archives: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """A row for each record of the files in ``path``, with the payload where it is asked for.

    ``verified`` says that the digests which the record states (SHA-1; others are not
    checked) are those of its bytes. ``error`` names what ended an archive early; such a row
    has nothing else but the place. An empty file has no record.
    """
    schema = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[x.split()[1]]) for x in HEAD.split(", ")] + [("payload", pa.binary())] * with_payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, name = store(path)
                rows, size = [], 0
                with files.open_input_stream(name, compression=None, buffer_size=PIECE) as source:
                    for row in Reader(source, with_payload=with_payload).records():
                        rows.append(row | {"path": path})
                        size += 500 + len(row.get("payload") or b"")
                        if size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    spread = archives.select("path").repartition(archives.sparkSession.sparkContext.defaultParallelism * 4)
    return spread.mapInArrow(run, HEAD + ", payload binary" * with_payload)


def warc_round_trip(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_PAYLOAD) -> DataFrame:
    """(id, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``, ``error``,
    ``verified``) of each row, all as read back from the archives."""
    kind = pages.select(id_col).schema[0].dataType
    read = read_archives(write_archives(pages, id_col=id_col, url_col=url_col, html_col=html_col, least=least))
    rows = read.filter("error is not null or type in ('response', 'revisit')")
    return rows.select(
        F.col("page").cast(kind).alias(id_col), "payload_bytes", F.col("payload_sha1").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"), "error", "verified"
    )
