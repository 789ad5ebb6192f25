"""WARC derivatives: response records to linked metadata and plain-text conversion records.

Every response gives two records that name it in WARC-Refers-To and repeat its target URI, date and
payload digest: a metadata record (application/warc-fields: title, language, outlinks, and the source's
HTTP status, HTTP and WARC headers and digest) and a conversion record (text/plain: all visible text). Record ids
are name-based, so that a task that runs again writes the same bytes.

A payload digest that the source gives is repeated as it stands, else the payload's bytes are hashed.
Transfer and content encodings and charset are decoded for the text only; an encoding that is unknown
or doesn't fit the bytes leaves them as they are.

Defined results: a null payload is empty; a null URI gives an empty WARC-Target-URI; repeated
responses give repeated records; an empty table gives none. Records of a file that are cut or have no valid
Content-Length, damaged gzip members and bytes between them are passed over, and read_damage lists them.
Only the named columns are read; warc and body may be absent, then the payload's UTF-8 bytes are the source.
"""

from __future__ import annotations

import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import arrow_schema, in_batches, sliced
from tallyforge.llm.html_extract import tokens

_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
_CHUNK = re.compile(rb"([0-9a-fA-F]+)[^\r\n]*\r?\n")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.I | re.S)

RESPONSE_DDL = "record_id string, target_uri string, date string, http string, payload string, warc string, body binary"
RECORD_DDL = "source_id string, warc_type string, record_id string, refers_to string, target_uri string, content_type string, content_length bigint, block_digest string, source_digest string, n_links int, record string"


def digest(data: bytes) -> str:
    return f"sha256:{hashlib.sha256(data).hexdigest()}"


#: The elements whose words a page doesn't show.
_HEAD = frozenset(("tag:head", "tag:title")).__contains__


def visible_text(page: str) -> str:
    """All text of a page but scripts, styles and head, one line per block."""
    lines, now = [], []
    for _, feature, text, is_block in tokens(page, _HEAD):
        if is_block:
            lines.append("".join(now))
            now = []
        elif feature != "w:marked":
            now.append(text)
    lines.append("".join(now))
    return "\n".join(x for x in (" ".join(line.split()) for line in lines) if x)


def _unchunked(data: bytes) -> bytes:
    """The body of a chunked message; data that isn't one stays as it is, and a cut one gives what is there."""
    parts, at = [], 0
    while m := _CHUNK.match(data, at):
        if not (size := int(m[1], 16)):
            return b"".join(parts)
        parts.append(data[m.end() : m.end() + size])
        at = m.end() + size
        at += 2 if data[at : at + 2] == b"\r\n" else 1 if data[at : at + 1] == b"\n" else 0
    return b"".join(parts) if parts and at >= len(data) else data


def _inflated(data: bytes, coding: str) -> bytes:
    """The body without gzip or deflate; data that isn't so packed stays as it is, and a cut one gives what is there."""
    for bits in (31,) if "gzip" in coding else (15, -15):
        parts, left = [], data
        try:
            while left:
                member = zlib.decompressobj(bits)
                parts.append(member.decompress(left))
                left = member.unused_data
        except zlib.error:
            pass
        if parts:
            return b"".join(parts)
    return data


def _header(http: str, name: str) -> str:
    found = (value.strip() for key, _, value in (line.partition(":") for line in http.split("\r\n")[1:]) if key.strip().lower() == name)
    return ", ".join(found).lower()


def payload_text(http: str, body: bytes) -> str:
    """A payload as text: transfer and content encodings taken off, and the charset of header, byte order mark or meta tag."""
    if "chunked" in _header(http, "transfer-encoding"):
        body = _unchunked(body)
    for coding in reversed(_header(http, "content-encoding").split(",")):
        if coding.strip() in ("gzip", "x-gzip", "deflate"):
            body = _inflated(body, coding)
    mark = next((name for bom, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")) if body.startswith(bom)), None)
    named = _CHARSET.search(_header(http, "content-type")) or _CHARSET.search(body[:2048].decode("latin-1"))
    charset = mark or (named[1] if named else "utf-8")
    if charset.lower() in ("latin-1", "latin1", "iso-8859-1", "ascii", "us-ascii"):
        charset = "cp1252"  # as browsers do
    try:
        text = body.decode(charset, "replace")
    except (LookupError, ValueError):
        text = body.decode("utf-8", "replace")
    return text.encode("utf-8", "replace").decode("utf-8")


def one_line(text: str) -> str:
    return " ".join(text.split())


def record_text(fields: list[tuple[str, str]], block: str) -> str:
    """A WARC record without the two line ends that close it."""
    head = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block.encode())}\r\n\r\n{block}"


def derive(record_id: str, uri: str | None, date: str | None, http: str | None, payload: str | None, warc: str | None = None, body: bytes | None = None) -> Iterator[tuple]:
    """The rows of the metadata and the conversion record of one response."""
    page, uri, date = payload or "", one_line(uri or ""), date or ""
    own_headers = [(name.strip().lower(), value.strip()) for name, _, value in (h.partition(":") for h in (warc or "").split("\r\n")) if name.strip()]
    given = next((value for name, value in own_headers if name == "warc-payload-digest" and value), None)
    source = given or digest(page.encode() if body is None else body)
    status, _, headers = (http or "").strip().partition("\r\n")
    links = []
    for found in _LINK.findall(page):
        link = one_line(html.unescape("".join(found)))
        try:
            links.append(urljoin(uri, link))
        except ValueError:
            links.append(link)
    title, lang = _TITLE.search(page), _LANG.search(page)
    facts = [("title", one_line(html.unescape(title[1])) if title else ""), ("language", lang[1] if lang else ""), ("source-status", status)]
    facts += [(f"source-{name.strip().lower()}", value.strip()) for name, _, value in (h.partition(":") for h in headers.split("\r\n")) if name]
    facts += [(f"source-{name if name.startswith('warc-') else f'record-{name}'}", value) for name, value in own_headers]
    facts += [("source-payload-digest", source), *(("outlink", f"{x} L a/@href") for x in links)]
    blocks = (("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in facts)), ("conversion", "text/plain; charset=utf-8", visible_text(page)))
    for kind, content_type, block in blocks:
        own, name = digest(block.encode()), f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record_id} {kind}')}"
        fields = [
            ("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", f"<{record_id}>"),
            ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Block-Digest", own), ("WARC-Source-Payload-Digest", source), ("Content-Type", content_type),
        ]
        yield record_id, kind, name, record_id, uri, content_type, len(block.encode()), own, source, len(links), record_text(fields, block)


def derivatives(responses: DataFrame) -> DataFrame:
    """Two rows per response, with the records as text."""

    columns = ["record_id", "target_uri", "date", "http", "payload", *(("warc", "body") if {"warc", "body"} <= set(responses.columns) else ())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = zip(*(batch.column(c).to_pylist() for c in columns), strict=True)
            yield from in_batches((x for row in rows for x in derive(*row)), arrow_schema(RECORD_DDL), 500)

    return responses.select(*columns).mapInArrow(run, RECORD_DDL)


def responses_of_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """pages as captured responses: ids from page_id and url, headers as a server would send them."""
    name = F.md5(F.concat_ws(" ", F.col("page_id").cast("string"), F.col("url")))
    grouped = F.regexp_replace(name, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("string")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    return pages.select(F.concat(F.lit("urn:uuid:"), grouped).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), head.alias("http"), F.col("html").alias("payload"))


def write_warc(records: DataFrame, path: str) -> None:
    """Write the records as plain WARC files, one a task; the line separator closes each record.

    Spark's text files compress a file as a whole, and readers expect one gzip member a record, so the
    files stay uncompressed.
    """
    records.select("record").write.option("lineSep", "\r\n\r\n").text(path)


_MAGIC = b"\x1f\x8b"


def _members(data: bytes, bad: list[tuple[int, str]]) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of a file's gzip members, inflated one at a time, or of a plain file as it is.

    A member that is cut or damaged gives what could be read; bytes that are no member are passed over.
    """
    if data[:2] != _MAGIC:
        yield 0, data
        return
    at, view = 0, memoryview(data)
    while 0 <= at < len(data):
        if data[at : at + 2] != _MAGIC:
            bad.append((at, "not a gzip member"))
            at = data.find(_MAGIC + b"\x08", at + 1)
            continue
        member, parts, to = zlib.decompressobj(31), [], at
        try:
            while to < len(data) and not member.eof:
                piece = view[to : to + (1 << 16)]
                parts.append(member.decompress(piece))
                to += len(piece) - len(member.unused_data)
        except zlib.error:
            bad.append((at, "damaged gzip member"))
            to = data.find(_MAGIC + b"\x08", at + 1)
        else:
            if not member.eof:
                bad.append((at, "cut gzip member"))
        yield at, b"".join(parts)
        at = to


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of every record of a WARC file, gzipped or not."""
    for lines, block in warc_records(data):
        yield {name.lower(): value for name, value in lines}, block


def warc_records(data: bytes, bad: list[tuple[int, str]] | None = None) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(all headers in order, block) of every whole record of a WARC file, gzipped or not.

    What is no whole record is passed over, and `bad` gets the offset (of the gzip member, where there are
    some) and the reason. A record without a valid Content-Length ends where the next record begins after an
    empty line; only there may a payload that holds such a line be cut.
    """
    bad = [] if bad is None else bad
    for offset, member in _members(data, bad):
        yield from _records(member, 0 if data[:2] != _MAGIC else offset, bad)


def _records(data: bytes, offset: int, bad: list[tuple[int, str]]) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    at, plain = 0, offset
    while True:
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\r\n\r\n", at) if data.startswith(b"WARC/", at) else -1
        lines: list[tuple[str, str]] = []
        for line in data[at : max(end, at)].decode("utf-8", "replace").split("\r\n")[1:]:
            if line[:1] in (" ", "\t") and lines:  # goes on with the header before
                lines[-1] = (lines[-1][0], f"{lines[-1][1]} {line.strip()}")
                continue
            name, _, value = line.partition(":")
            lines.append((name.strip(), value.strip()))
        size = next((value for name, value in reversed(lines) if name.lower() == "content-length"), "")
        if end < 0 or not (size.isascii() and size.isdigit()):
            bad.append((plain + at, "no record" if end < 0 else "no valid Content-Length"))
        elif end + 4 + int(size) > len(data):
            bad.append((plain + at, "cut record"))
        else:
            yield lines, data[end + 4 : end + 4 + int(size)]
            at = end + 4 + int(size)
            continue
        at = data.find(b"\r\n\r\nWARC/", at + 1)
        if at < 0:
            return


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The HTTP responses of WARC files as derivatives() takes them; other records, and damaged ones, are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for data in batch.column("content").to_pylist():
                    for lines, block in warc_records(data):
                        headers = {name.lower(): value for name, value in lines}
                        if headers.get("warc-type") == "response":
                            head, _, body = block.partition(b"\r\n\r\n")
                            http, warc = head.decode("latin-1"), "".join(f"{name}: {value}\r\n" for name, value in lines)
                            yield headers.get("warc-record-id", "").strip("<>"), headers.get("warc-target-uri"), headers.get("warc-date"), f"{http}\r\n\r\n", payload_text(http, body), warc, body

        yield from in_batches(rows(), arrow_schema(RESPONSE_DDL), 200)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RESPONSE_DDL)


def read_damage(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset, reason) of all that read_responses passes over because it is damaged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                    bad: list[tuple[int, str]] = []
                    for _ in warc_records(data, bad):
                        pass
                    yield from ((name, offset, reason) for offset, reason in bad)

        yield from in_batches(rows(), arrow_schema("path string, offset bigint, reason string"), 200)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, offset bigint, reason string")
