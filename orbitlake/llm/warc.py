"""WARC files (operator 5): a sequential reader, and the writer that feeds it.

The reader streams a file once in small pieces: every gzip member is one record and is
decompressed incrementally; headers end at the first blank line, and from there the block
is framed by ``Content-Length`` and its SHA-1, SHA-256 or MD5 digest (base 32 or
hexadecimal) is computed piece by piece. Memory is bounded by one record. Files are the
unit of parallelism.

``status`` is ``ok``, ``no digest``, ``digest mismatch``, ``bad length`` (the member ends
before or beyond the framed block), ``bad header`` or ``truncated`` (the member is corrupt
or the file ends inside it). After such a member reading goes on at the next gzip member
that decompresses to a record, so one damaged place costs one record, reported once. A
block is returned for every status that has one.

The writer puts each partition into one file, one member a record, under a name that
depends on the partition alone and through a rename, so a task that runs again leaves the
same file. Header values are read as they stand. A URL that can't stand in a header as it
is (line breaks, white space at its ends) is percent-encoded by the writer under the mark
``X-Escaped: 1``, and only under that mark decoded.

Cases: a null ``page_id`` or ``url`` leaves its header out and reads back null; a null
``html`` is an empty block marked ``X-Null: 1`` and reads back null; an empty ``html`` is an
empty block; a very long one is a record like any other; repeated rows are records each (no
ties arise); an empty table gives no record; columns other than the three aren't read,
whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import cut, pick, scratch_path, thrifty

READ_BYTES = 1 << 16
BATCH_BYTES = 4 << 20
SCHEMA = "page_id bigint, url string, content_length bigint, digest string, status string, html string"


def _fs(uri: str):
    """(file system, path) of a URI: the local one for file:, otherwise what pyarrow resolves."""
    u = urlparse(uri)
    if u.scheme in ("", "file"):
        return None, u.path
    return pyarrow.fs.FileSystem.from_uri(uri)


def _open(uri: str) -> BinaryIO:
    fs, path = _fs(uri)
    return open(path, "rb") if fs is None else fs.open_input_stream(path)


class Digest:
    """A stated digest, verified as the block comes in."""

    def __init__(self, stated: str):
        algorithm, _, value = stated.partition(":")
        algorithm = algorithm.strip().lower().replace("-", "")
        self.value, self.hash = value.strip(), hashlib.new(algorithm) if algorithm in ("sha1", "sha256", "md5") else None

    def ok(self) -> bool:
        if self.hash is None:
            return False
        known = self.hash.digest()
        return self.value.lower() == known.hex() or self.value.upper().rstrip("=") == base64.b32encode(known).decode().rstrip("=")


class Record:
    """One record, fed with the decompressed pieces of its member."""

    def __init__(self):
        self.head, self.body, self.framed, self.length, self.headers = b"", [], 0, None, {}
        self.open, self.excess, self.digest = True, False, None

    def feed(self, piece: bytes) -> None:
        if self.open:
            seen = max(len(self.head) - 3, 0)
            self.head += piece
            end = self.head.find(b"\r\n\r\n", seen)
            if end < 0:
                return
            self.head, piece = self.head[:end], self.head[end + 4 :]
            self.open = False
            self._read_head()
        if self.length is not None:
            block, rest = piece[: self.length - self.framed], piece[self.length - self.framed :]
            if block:
                self.body.append(block)
                self.framed += len(block)
                if self.digest is not None and self.digest.hash is not None:
                    self.digest.hash.update(block)
            self.excess |= bool(rest.strip(b"\r\n"))

    def _read_head(self) -> None:
        first, *lines = self.head.split(b"\r\n")
        name = ""
        for line in lines:
            if line[:1] in (b" ", b"\t") and name:  # a folded value
                self.headers[name] += " " + line.strip().decode("utf-8", "replace")
                continue
            left, _, right = line.partition(b":")
            name = left.strip().lower().decode("latin-1")
            self.headers[name] = right.strip().decode("utf-8", "replace")
        length = self.headers.get("content-length", "")
        if first.startswith(b"WARC/") and length.isascii() and length.isdigit():
            self.length = int(length)
            if "warc-block-digest" in self.headers:
                self.digest = Digest(self.headers["warc-block-digest"])

    def status(self, complete: bool) -> str:
        if not complete:
            return "truncated"
        if self.length is None:
            return "bad header"
        if self.framed < self.length or self.excess:
            return "bad length"
        if self.digest is None:
            return "no digest"
        return "ok" if self.digest.ok() else "digest mismatch"

    def row(self, complete: bool) -> tuple:
        h = self.headers
        page, url = h.get("x-page-id", ""), h.get("warc-target-uri")
        if url is not None and h.get("x-escaped") == "1":
            url = unquote(url)
        html = None if self.length is None or h.get("x-null") == "1" else b"".join(self.body).decode("utf-8", "replace")
        number = int(page) if page.removeprefix("-").isascii() and page.removeprefix("-").isdigit() else None
        return number, url, self.length, h.get("warc-block-digest"), self.status(complete), html


MAGIC = b"\x1f\x8b\x08"
#: Compressed bytes that are sure to yield the first bytes of a member.
_LOOK = 1 << 12


def _begins_record(raw: bytes) -> bool:
    """Does the gzip member at the start of ``raw`` (enough of it) decompress to a record?"""
    try:
        return zlib.decompressobj(wbits=31).decompress(raw, 5) == b"WARC/"
    except zlib.error:
        return False


def records(stream: BinaryIO, size: int = READ_BYTES) -> Iterator[tuple[Record, bool]]:
    """(record, complete) of each gzip member, read sequentially.

    ``raw`` holds the compressed bytes since the member's start, for a damaged one to be searched for the next.
    """
    raw, ended = b"", False

    def more() -> bytes:
        nonlocal ended
        piece = b"" if ended else stream.read(size)
        ended = not piece
        return piece

    while True:
        raw = raw or more()
        if not raw:
            return
        decoder, record, pieces, piece, complete = zlib.decompressobj(wbits=31), Record(), [raw], raw, True
        try:
            while True:
                record.feed(decoder.decompress(piece))
                if decoder.eof:
                    break
                piece = more()
                if not piece:
                    complete = False
                    break
                pieces.append(piece)
        except zlib.error:
            complete = False
        yield record, complete
        if complete:
            raw = decoder.unused_data
            continue
        raw, at = b"".join(pieces), 1
        while True:  # the next member that is a record, from behind the damaged one's start
            at = raw.find(MAGIC, at)
            if at < 0 or len(raw) - at < _LOOK:
                piece = more()
                if piece:
                    if at < 0:
                        raw, at = raw[-2:] + piece, 0
                    else:
                        raw, at = raw[at:] + piece, 0
                    continue
                if at < 0:
                    return
            if _begins_record(raw[at : at + _LOOK]):
                raw = raw[at:]
                break
            at += 1


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["page_id", "url", "content_length", "digest", "status", "html"])


def read_warc(files: DataFrame) -> DataFrame:
    """Records of the files named in the ``path`` column, files side by side, each sequentially."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                if path is None:
                    continue
                rows, held = [], 0
                with _open(path) as stream:
                    for record_, complete in records(stream):
                        rows.append(record_.row(complete))
                        held += record_.framed + len(record_.head)
                        if held >= BATCH_BYTES:
                            yield _batch(rows)
                            rows, held = [], 0
                yield _batch(rows)

    return pick(files, "path").mapInArrow(thrifty(run), SCHEMA)


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """One WARC resource record as a gzip member."""
    block = (html or "").encode("utf-8", "surrogatepass")
    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}')}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        escaped = url != url.strip() or not url.isprintable()
        head += [f"WARC-Target-URI: {quote(url, safe='/:?&=#') if escaped else url}", *["X-Escaped: 1"] * escaped]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if html is None:
        head.append("X-Null: 1")
    head += ["Content-Type: text/html; charset=utf-8", f"WARC-Block-Digest: sha1:{digest}", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages(page_id, url, html)`` under ``folder``; one ``(path, records)`` row a file, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        target = f"{folder}/part-{part:06d}.warc.gz"
        draft = f"{target}.{uuid.uuid4().hex}.tmp"
        fs, path = _fs(draft)
        if fs is None:
            os.makedirs(os.path.dirname(path), exist_ok=True)
        else:
            fs.create_dir(os.path.dirname(path))
        n = 0
        with open(path, "wb") if fs is None else fs.open_output_stream(path) as out:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    out.write(record(*row))
                    n += 1
        goal = _fs(target)[1]
        os.replace(path, goal) if fs is None else fs.move(path, goal)
        yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([n])], ["path", "records"])

    flat = pick(pages, "page_id", "url", "html")
    flat = flat.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html")
    return cut(flat.mapInArrow(thrifty(run), "path string, records bigint"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as WARC to the shared folder and read every record back (a task for each file, in at most 100,000 partitions)."""
    files = write_warc(pages, f"{scratch_path(pages.sparkSession)}")
    return read_warc(files.repartition(max(1, min(files.count(), 100_000))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("digest")


SQL = """
SELECT page_id, url, octet_length(encode(html))::BIGINT AS content_length, 'ok' AS status, html FROM pages"""
