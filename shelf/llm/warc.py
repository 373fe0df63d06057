"""WARC archives: one gzip member a record, written per partition and read back sequentially with digests verified."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelf.llm import common

CHUNK = 1 << 16
#: Bytes after which a task begins another archive.
ARCHIVE_BYTES = 1 << 30
#: Tasks that read archives, at most.
READERS = 20_000
#: Records of one batch that a reader hands to Spark, and bytes of payload after which it does so earlier.
BATCH, BATCH_BYTES = 2000, 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
])
RECORD_SQL = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def uri_line(url: str | None) -> str:
    """The url on one header line: control characters and blanks percent-encoded."""
    return "".join(quote(c) if c <= " " or c == "\x7f" else c for c in url or "")


def record(id: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool) -> bytes:
    """One record, not compressed. A revisit keeps the HTTP headers, with the full payload's length, and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{quote(id or '', safe='')}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri_line(url)}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{quote(refers_to or '', safe='')}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(folder: str, level: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        out = path = None
        done: list[tuple[str, int]] = []
        count = size = 0

        def close() -> None:
            if out is not None:
                out.close()
                done.append((f"{folder}/{path}", count))

        for batch in batches:
            for id, url, payload, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or size > ARCHIVE_BYTES:
                    close()
                    path, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{path}", compression=None)
                member = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = member.compress(record(id, url, payload, refers_to, revisit)) + member.flush()
                out.write(data)
                count, size = count + 1, size + len(data)
        close()
        yield pa.RecordBatch.from_pydict({"path": [p for p, _ in done], "records": [n for _, n in done]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return write


class Member:
    """The plain bytes of one gzip member, inflated piece by piece; what follows the member is handed on."""

    def __init__(self, stream, rest: bytes):
        self.stream, self.rest, self.data = stream, rest, b""
        self.inflate = zlib.decompressobj(31)

    def more(self) -> bool:
        while not self.inflate.eof:
            raw = self.inflate.unconsumed_tail or self.rest or self.stream.read(CHUNK)
            if not raw:
                raise ValueError("the archive ends within a record")
            self.rest = b""
            piece = self.inflate.decompress(raw, CHUNK)
            if self.inflate.eof:
                self.rest = self.inflate.unused_data
            if piece:
                self.data += piece
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        while (at := self.data.find(mark)) < 0:
            if not self.more():
                raise ValueError("a record's headers don't end")
        head, self.data = self.data[:at], self.data[at + len(mark) :]
        return head

    def pieces(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.data and not self.more():
                raise ValueError("a record is shorter than its Content-Length")
            piece, self.data = self.data[:size], self.data[size:]
            size -= len(piece)
            yield piece

    def end(self) -> bytes:
        while self.more():
            pass
        if self.data != b"\r\n\r\n":
            raise ValueError("a record doesn't end after its Content-Length")
        return self.rest


def headers(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode().split("\r\n")
    return first, {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _urn(value: str | None) -> str | None:
    return unquote(value.removeprefix("<urn:page:").removesuffix(">")) or None if value else None


def records(stream, payloads: bool = True) -> Iterator[dict]:
    """The records of an archive in order. Payloads are digested piece by piece and kept only if asked for; a wrong digest raises."""
    rest = b""
    while rest or (rest := stream.read(CHUNK)):
        member = Member(stream, rest)
        version, warc = headers(member.until(b"\r\n\r\n"))
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record: {version[:40]!r}")
        left = int(warc["content-length"])
        whole, body, http, held, size = hashlib.sha1(), hashlib.sha1(), b"", [], -1
        for piece in member.pieces(left):
            whole.update(piece)
            if size < 0:
                http += piece
                at = http.find(b"\r\n\r\n")
                if at < 0:
                    continue
                http, piece, size = http[:at], http[at + 4 :], 0
            body.update(piece)
            size += len(piece)
            if payloads:
                held.append(piece)
        rest = member.end()
        want = warc["warc-payload-digest"].removeprefix("sha1:")
        full = warc["warc-type"] == "response"
        if base64.b32encode(whole.digest()).decode() != warc["warc-block-digest"].removeprefix("sha1:") or full and base64.b32encode(body.digest()).decode() != want:
            raise ValueError(f"digest of {warc['warc-record-id']} differs")
        yield {
            "record_id": _urn(warc["warc-record-id"]), "record_type": warc["warc-type"], "target_uri": warc["warc-target-uri"],
            "refers_to": _urn(warc.get("warc-refers-to")), "payload_digest": want,
            "payload_bytes": max(size, 0) if full else int(headers(http)[1]["content-length"]), "payload": b"".join(held) if full and payloads else None,
        }


def _read(payloads: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = filesystem(uri)
                held, size = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for r in records(stream, payloads):
                        held.append(r)
                        size += len(r["payload"] or b"")
                        if len(held) >= BATCH or size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(held, schema=RECORD)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=RECORD)

    return read


def write(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, level: int = 4) -> DataFrame:
    """Write a record of every row to archives in the shared folder; returns the archives (path, records).

    Of the rows with an equal payload of at least ``min_bytes``, that with the smallest id is a response and the others revisit it;
    shorter payloads are all responses. Rows that repeat the smallest id are all responses, as are rows of a payload that has no
    id but null. A null payload is an empty one, a null url an empty one. A task that fails leaves a file that no row names.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(id).alias("id"), F.col(url).cast("string").alias("url"), payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    first = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.min("id").alias("first")).withColumnRenamed("sha", "s")
    revisit = F.coalesce(~F.col("id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False)) & (F.octet_length("payload") >= min_bytes)
    out = rows.join(first, F.col("sha") == F.col("s"), "left").select(
        F.col("id").cast("string").alias("id"), "url", "payload", F.col("first").cast("string").alias("first"), revisit.alias("revisit")
    )
    folder = common.scratch(pages.sparkSession, "warc")
    return common.saved(out.mapInArrow(_write(folder, level), "path string, records long"), "warc-archives")


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of all archives: each archive is read by one task from its start to its end, and each task reads few archives.

    The number of tasks is that of the archives, at most READERS: a path is a few bytes, and tasks left to be sized by bytes would all be one.
    """
    spread = archives.select("path").repartition(max(1, min(archives.count(), READERS)))
    return spread.mapInArrow(_read(payloads), RECORD_SQL)
