"""WARC archives through a chunked record table.

A page becomes rows (record, chunk number, at most ``chunk_bytes`` bytes), so that neither the
writer nor the reader ever holds a whole payload.  Writers stream the chunks of a record into a
gzip member of their archive and carry the SHA-1 digest along; readers stream the members back
the same way.  Each task writes archives with names of their own and reports them in a manifest;
only archives of the manifest count, so a task that runs again leaves no double records.

Of records with equal payloads (SHA-1 and size) of at least ``min_bytes`` the one with the
smallest page_id is a response, the others are revisits of it without a body; smaller payloads
are always responses.  A null html is an empty payload.  Repeated rows of the first page are
responses again; a page without id is a response if no page with an id has its payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path

READ = 1 << 20
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def uri(url: str | None) -> str | None:
    """A URL fit for a header line."""
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


class ArchiveWriter:
    """Writes records chunk by chunk; starts a new archive once one has ``max_bytes``."""

    def __init__(self, folder: str, max_bytes: int, date: str):
        self.fs, self.folder = pyarrow.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.root, self.max_bytes, self.date = folder.rstrip("/"), max_bytes, date
        self.out, self.done = None, []

    def _put(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.bytes += len(data)

    def begin(self, page_id: int | None, size: int, digest: str, first: int | None, url: str | None) -> None:
        if self.out is None:
            self.name = f"part-{uuid.uuid4().hex}.warc.gz"
            self.out, self.bytes, self.records = self.fs.open_output_stream(f"{self.folder}/{self.name}"), 0, 0
        self.kind = "response" if first is None or first == page_id else "revisit"
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
        length = len(http) + (size if self.kind == "response" else 0)
        lines = ["WARC/1.1", f"WARC-Type: {self.kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {self.date}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]
        if url is not None:
            lines.append(f"WARC-Target-URI: {url}")
        if page_id is not None:
            lines.append(f"X-Page-Id: {page_id}")
        if self.kind == "revisit":
            lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(first, digest)}", f"X-Refers-To-Page-Id: {first}"]
        self.gzip, self.sha, self.digest = zlib.compressobj(1, wbits=31), hashlib.sha1(), digest
        self._put(self.gzip.compress(("\r\n".join(lines) + "\r\n\r\n").encode() + http))

    def chunk(self, data: bytes) -> None:
        self.sha.update(data)
        if self.kind == "response":
            self._put(self.gzip.compress(data))

    def end(self) -> None:
        if base64.b32encode(self.sha.digest()).decode() != self.digest:
            raise ValueError("the chunks of a record don't have its digest")
        self._put(self.gzip.compress(b"\r\n\r\n") + self.gzip.flush())
        self.records += 1
        if self.bytes >= self.max_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((f"{self.root}/{self.name}", self.records, self.bytes))
            self.out = None


NO_ID = -(1 << 63)  # stands for a null page_id in joins; a page with this id counts as one without


def known_id(column: str):
    return F.when(F.col(column) != NO_ID, F.col(column))


def chunk_table(pages: DataFrame, min_bytes: int = 0, chunk_bytes: int = 1 << 20, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The chunked record table: page_id, url, digest (hex), size, first, chunk_no, chunks, chunk.

    ``first`` is null for payloads that no other page has.  Pages with equal payloads meet only as
    narrow rows; the bodies are joined to the decisions by page, unsorted, so that many copies of
    a large payload don't go to one task.
    """
    body = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("page_id"), F.col(url_col).alias("url"), body.alias("body")).withColumn("digest", F.sha1("body")).withColumn("size", F.octet_length("body").cast("long"))
    # decided on narrow rows alone; equal payloads meet again only page by page
    narrow = materialize(rows.select("page_id", "digest", "size").where(F.col("size") >= min_bytes).distinct(), "warc-pages")
    firsts = narrow.groupBy("digest", "size").agg(F.min(known_id("page_id")).alias("first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    decided = materialize(narrow.join(firsts, ["digest", "size"]), "warc-firsts")
    rows = rows.join(decided.hint("shuffle_hash"), ["page_id", "digest", "size"], "left").withColumn("page_id", known_id("page_id"))
    n = F.greatest(F.ceil(F.col("size") / chunk_bytes), F.lit(1)).cast("int")
    starts = F.sequence(F.lit(0), n - 1)
    return rows.select("page_id", "url", "digest", "size", "first", n.alias("chunks"), "body", F.explode(starts).alias("chunk_no")).withColumn("chunk", F.substring(F.col("body"), F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))).drop("body")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, chunk_bytes: int = 1 << 20, max_bytes: int = 1 << 30, **columns) -> DataFrame:
    """Write all pages below ``folder`` (a path or URI that executors share); returns the manifest: path, records, bytes."""
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = ArchiveWriter(folder, max_bytes, date)
        for batch in batches:
            for r in batch.to_pylist():
                if r["chunk_no"] == 0:
                    out.begin(r["page_id"], r["size"], base64.b32encode(bytes.fromhex(r["digest"])).decode(), r["first"], uri(r["url"]))
                out.chunk(r["chunk"])
                if r["chunk_no"] == r["chunks"] - 1:
                    out.end()
        out.close()
        paths, records, sizes = zip(*out.done, strict=True) if out.done else ((), (), ())
        yield pa.record_batch([pa.array(paths, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "records", "bytes"])

    table = chunk_table(pages, min_bytes, chunk_bytes, **columns)
    return materialize(table.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


class _Stream:
    """Decompressed bytes of an archive of gzip members, a bounded part at a time."""

    def __init__(self, raw):
        self.raw, self.buffer, self.gzip, self.over, self.rest = raw, bytearray(), zlib.decompressobj(wbits=31), False, b""

    def fill(self) -> bool:
        while not self.over:
            data = self.rest or self.raw.read(READ)
            self.rest = b""
            if not data:
                self.over = True
                break
            got = self.gzip.decompress(data, READ)
            self.rest = self.gzip.unconsumed_tail
            if self.gzip.eof:
                self.rest, self.gzip = self.gzip.unused_data, zlib.decompressobj(wbits=31)
            if got:
                self.buffer += got
                return True
        return False

    def head(self) -> dict[str, str] | None:
        """A block of header lines; None at the archive's end."""
        while (at := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self.fill():
                return None
        lines = bytes(self.buffer[:at]).decode().split("\r\n")
        del self.buffer[: at + 4]
        self.head_bytes = at + 4
        return {"": lines[0]} | {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self.fill():
                raise EOFError("an archive ends within a record")
            part = bytes(self.buffer[:n])
            del self.buffer[:n]
            n -= len(part)
            yield part


def records(path: str) -> Iterator[tuple]:
    """Records of an archive in the order of RECORDS."""
    fs, name = pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_input_stream(name) as raw:
        s = _Stream(raw)
        while (h := s.head()) is not None:
            if not h[""].startswith("WARC/"):
                raise ValueError(f"{path}: no record where one should start")
            left, digest = int(h["content-length"]), h["warc-payload-digest"].removeprefix("sha1:")
            http = s.head()
            left -= s.head_bytes
            size = int(http["content-length"])
            if h["warc-type"] == "response":
                sha, size = hashlib.sha1(), 0
                for part in s.take(left):
                    sha.update(part)
                    size += len(part)
                if base64.b32encode(sha.digest()).decode() != digest:
                    raise ValueError(f"{path}: a payload doesn't have its digest")
            for _ in s.take(4):
                pass
            own, first = h.get("x-page-id"), h.get("x-refers-to-page-id")
            yield own and int(own), size, digest, h["warc-type"], first and int(first), h.get("warc-target-uri")


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """All records of the manifest's archives, without payloads; payloads are checked against their digests."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        names = [x.split()[0] for x in RECORDS.split(", ")]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                for row in records(path):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path").repartition(n).mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame, min_bytes: int = 0, **params) -> DataFrame:
    """Write all pages to archives in the shared folder and read their records back."""
    spark = pages.sparkSession
    return read_archives(spark, write_archives(pages, new_path(spark, "warc"), min_bytes, **params))
