"""WARC derivative builder: metadata and plain-text conversion records of response records.

Each response gives a metadata record (application/warc-fields: status, the
source's HTTP headers, digests, sizes) and, if its payload is text, a
conversion record (text/plain: the page's visible text). Both name the
response in WARC-Refers-To and carry its target URI and date. Digests that the
source states (columns block_digest, payload_digest) are said as they are,
others are computed. Record ids are name-based UUIDs of the source's id and
the kind, so that a run that is repeated gives the same records.

``read_warc`` is a source of WARC files, plain or in gzip members: Spark's text
reader splits them between records and reads them from any store, so no file
is held whole. ``write_warc`` is the sink.

Results: a null block counts as empty. A block without an HTTP status line is
all payload and has no status. Chunked bodies are joined and gzip and deflate
bodies unpacked, as far as they go; other codings give no conversion record,
nor do content types that aren't text, nor a payload of no stated type with a
zero byte. Null URIs and dates are left out of headers. Text is decoded by the
byte order mark, else the charset of Content-Type, else that of the page's
meta element, else as UTF-8, with replacement of undecodable bytes. Repeated
responses give repeated records, and columns other than those named are left
out. In a WARC file, a block that itself holds starts of records (an archived
page about archives, or an archive in an archive) is put together again as far
as its record's Content-Length says, if that ends where a record ends; else the
record was cut off, what follows are records of their own, and ``whole``, which
says whether a record has its stated length, is false. Files that are split
(plain ones beyond a split's size) are put together within a split.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_main import visible_text
from .shared import bound_batches

VERSION = b"WARC/1.1"
DERIVED = "warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, source_payload_digest string, block_digest string, content_length long, record binary"
RESPONSES = ("record_id", "target_uri", "warc_date", "block")
#: Content types besides text/* that are text.
TEXT = frozenset("application/xhtml+xml application/xml application/json application/ld+json application/rss+xml application/atom+xml application/javascript".split())
META = re.compile(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([a-zA-Z0-9_.:-]+)", re.I)
#: What lies between two records, up to the version of the next.
BETWEEN = "\r\n\r\nWARC/"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(names))}>"


def write_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record's bytes; Content-Length is added. Line breaks in values become spaces."""
    lines = [VERSION, *(f"{k}: {' '.join(v.split())}".encode() for k, v in headers), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(raw: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in raw.splitlines():
        if line[:1] in (b" ", b"\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.decode('utf-8', 'replace').strip()}")
        elif b":" in line:
            k, v = line.decode("utf-8", "replace").split(":", 1)
            out.append((k.strip(), v.strip()))
    return out


def read_records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of the records in data; ends at the first place that is no record."""
    at = 0
    while data.startswith(b"WARC/", at):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        headers = _fields(data[at:end].split(b"\r\n", 1)[-1])
        size = next((int(v) for k, v in headers if k.lower() == "content-length" and v.isdigit()), 0)
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size
        while data.startswith(b"\r\n", at):
            at += 2


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, payload) of an HTTP response."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    for gap in (b"\r\n\r\n", b"\n\n"):
        end = block.find(gap)
        if end >= 0:
            head, payload = block[:end], block[end + len(gap) :]
            break
    else:
        head, payload = block, b""
    first, _, rest = head.partition(b"\n")
    return first.decode("utf-8", "replace").strip(), _fields(rest), payload


def _said(headers: list[tuple[str, str]], name: str) -> str:
    return next((v for k, v in headers if k.lower() == name), "")


def unchunked(body: bytes) -> bytes:
    """The body of a chunked transfer; what doesn't follow the form ends it."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]{1,8}", size) or not (n := int(size, 16)):
            # archives often keep the header of a body that they joined
            return b"".join(out) if at else body
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def unpacked(body: bytes, coding: str) -> bytes | None:
    """The body without its content coding, as far as it goes; None for a coding that isn't known."""
    for name in reversed([c.strip().lower() for c in coding.split(",") if c.strip()]):
        if name in ("identity", "none"):
            continue
        if name in ("gzip", "x-gzip"):
            if body.startswith(b"\x1f\x8b"):  # else it was unpacked before
                body = _inflated(body, 31)
        elif name == "deflate":
            body = _inflated(body, 15) or _inflated(body, -15) or body
        else:
            return None
    return body


def _inflated(body: bytes, bits: int) -> bytes:
    out = []
    while body:
        reader = zlib.decompressobj(bits)
        try:
            out.append(reader.decompress(body))
        except zlib.error:
            break
        body = reader.unused_data if bits == 31 and reader.unused_data.startswith(b"\x1f\x8b") else b""
    return b"".join(out)


def text_of(headers: list[tuple[str, str]], payload: bytes) -> str | None:
    """The text that a payload shows; None if it isn't text."""
    content = _said(headers, "content-type").lower()
    kind = content.split(";")[0].strip()
    body = unpacked(unchunked(payload) if "chunked" in _said(headers, "transfer-encoding").lower() else payload, _said(headers, "content-encoding"))
    if body is None or kind and not kind.startswith("text/") and kind not in TEXT or not kind and b"\0" in body:
        return None
    meta = META.search(body[:4096])
    stated = re.search(r"charset\s*=\s*[\"']?([^\s;\"']+)", content)
    mark = next((c for m, c in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")) if body.startswith(m)), None)
    charset = mark or (stated[1] if stated else meta[1].decode() if meta else "utf-8")
    try:
        text = body.decode(charset, "replace")
    except (LookupError, UnicodeError):
        text = body.decode("utf-8", "replace")
    return visible_text(text) if kind in ("", "text/html", "application/xhtml+xml") else text


def derivatives(source: str, uri: str | None, date: str | None, block: bytes, block_digest: str | None = None, payload_digest: str | None = None) -> Iterator[tuple]:
    """(type, id, content type, payload digest of the source, block digest, length, record) of the derived records."""
    status, http, payload = split_http(block)
    payload_digest = payload_digest or digest(payload)
    facts = [("source-status", status), ("source-block-digest", block_digest or digest(block)), ("source-payload-digest", payload_digest), ("source-payload-length", str(len(payload))), *((f"source-header-{k.lower()}", v) for k, v in http)]
    text = text_of(http, payload)
    parts = []
    if text is not None:
        facts.append(("conversion-record-id", record_id(source, "conversion")))
        parts = [("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"))]
    fields = b"".join(f"{k}: {' '.join(v.split())}\r\n".encode("utf-8", "replace") for k, v in facts)
    for kind, content, data in (("metadata", "application/warc-fields", fields), *parts):
        own, said = record_id(source, kind), digest(data)
        headers = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", source)]
        headers += [(k, v) for k, v in (("WARC-Target-URI", uri), ("WARC-Date", date)) if v is not None]
        if uri is not None and date is not None:
            headers += [("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date)]
        headers += [("WARC-Block-Digest", said), ("Content-Type", content)]
        yield kind, own, content, payload_digest, said, len(data), write_record(headers, data)


def derive(responses: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The derived records of each row of responses (record_id, target_uri, warc_date, block; block_digest and payload_digest where the columns exist), with the columns ``keep`` ahead, page_id if there is one."""
    bound_batches(responses.sparkSession)
    keep = [c for c in ("page_id",) if c in responses.columns] if keep is None else keep
    states = [F.col(c).cast("string") if c in responses.columns else F.lit(None).cast("string").alias(c) for c in ("block_digest", "payload_digest")]
    rows = responses.select(*[responses[c] for c in keep], *RESPONSES, *states)
    rows = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
    n = len(keep)
    kinds = [pa.string()] * 8 + [pa.int64(), pa.binary()]
    names = [*keep, *(x.split()[0] for x in DERIVED.split(", "))]

    def batch(b: pa.RecordBatch, of: list[int], found: list[tuple]) -> pa.RecordBatch:
        at = pa.array(of, pa.int64())
        return pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in range(n)), *(pa.array([r[c] for r in found], t) for c, t in enumerate(kinds))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, found, size = [], [], 0
            for r, (source, uri, date, block, *stated) in enumerate(zip(*(b.column(c).to_pylist() for c in range(n, n + 6)), strict=True)):
                for kind, own, content, payload, said, length, record in derivatives(source or "", uri, date, bytes(block or b""), *stated):
                    of.append(r)
                    found.append((kind, own, source, uri, date, content, payload, said, length, record))
                    size += length
                if size > 1 << 23:
                    yield batch(b, of, found)
                    of, found, size = [], [], 0
            yield batch(b, of, found)

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {responses.schema[c].dataType.simpleString()}" for c in keep), DERIVED]))


def responses_of(pages: DataFrame, date: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages as response records of one capture date: an HTTP head and the page's bytes."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    name = F.sha2(F.concat_ws("\0", F.lit(date), F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.coalesce(F.col(url), F.lit(""))).cast("binary"), 256)
    urn = F.format_string("<urn:uuid:%s-%s-%s-%s-%s>", *(F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return pages.select(F.col(page_id).alias("page_id"), urn.alias("record_id"), F.col(url).alias("target_uri"), F.lit(date).alias("warc_date"), F.concat(head.cast("binary"), body).alias("block"))


RECORDS = "warc_type string, record_id string, target_uri string, warc_date string, refers_to string, content_type string, block_digest string, payload_digest string, whole boolean, block binary"


def read_warc(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The records of WARC files: RECORDS, a row each, in the order of a file within its splits."""
    bound_batches(spark)
    parts = spark.read.option("lineSep", BETWEEN).text(path)
    parts = parts.select(F.col("value").cast("binary").alias("raw"), F.concat_ws(" ", "_metadata.file_path", "_metadata.file_block_start").alias("split"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joint, here = _Joint(), None
        for b in batches:
            rows = []
            for raw, split in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if split != here:
                    rows += joint.end()
                    here = split
                rows += joint.take(raw.removeprefix(b"WARC/"))  # the first record of a file has it
            yield _records(rows)
        yield _records(joint.end())

    return parts.mapInArrow(run, RECORDS)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 8 + [pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=[x.split()[0] for x in RECORDS.split(", ")])


class _Joint:
    """Puts the pieces between separators together to records of their stated lengths."""

    def __init__(self) -> None:
        self.held: list[bytes] = []  # a record that isn't whole yet, and the pieces after it
        self.head, self.size, self.have, self.skip = {}, 0, 0, 0

    def _row(self, whole: bool, block: bytes) -> tuple:
        said = self.head
        return (said.get("warc-type"), said.get("warc-record-id"), said.get("warc-target-uri"), said.get("warc-date"), said.get("warc-refers-to"), said.get("content-type"), said.get("warc-block-digest"), said.get("warc-payload-digest"), whole, block)

    def take(self, piece: bytes) -> list[tuple]:
        """The records that are known with this piece."""
        if not self.held:
            head, gap, rest = piece.partition(b"\r\n\r\n")
            if not re.match(rb"\d+\.\d+\r\n", head):
                return []
            # a block that begins with a record: the end of the headers is part of the separator
            self.skip = 0 if gap else 4
            self.head = {k.lower(): v for k, v in reversed(_fields(head.split(b"\r\n", 1)[1]))}
            self.size = int(self.head["content-length"]) if self.head.get("content-length", "").isdigit() else 0
            if len(rest) >= self.size:
                return [self._row(True, rest[: self.size])]
            self.held, self.have = [rest], len(rest) - self.skip
            return []
        self.held.append(piece)
        self.have += len(BETWEEN) + len(piece)
        if self.have < self.size:
            return []
        if self.have <= self.size + 4:  # the end of a file's last record is still there
            block, self.held = BETWEEN.encode().join(self.held)[self.skip :], []
            return [self._row(True, block[: self.size])]
        return self._cut_off()

    def _cut_off(self) -> list[tuple]:
        """The record that is held as one that was cut off, and what the pieces after it are by themselves."""
        first, *rest = self.held
        out, self.held = [self._row(False, first)], []
        for piece in rest:
            out += self.take(piece)
        return out

    def end(self) -> list[tuple]:
        """What is still held when a file or split ends."""
        out = []
        while self.held:
            out += self._cut_off()
        return out


def write_warc(records: DataFrame, path: str, record: str = "record", compression: str = "gzip") -> None:
    """Writes records, one after the other, as WARC files in the folder ``path``, one file for each partition."""
    end = "\r\n\r\n"
    body = F.expr(f"cast(substring(`{record}`, 1, octet_length(`{record}`) - {len(end)}) as string)")  # the writer adds the end again
    records.select(body.alias("value")).write.option("lineSep", end).option("compression", compression).text(path)
