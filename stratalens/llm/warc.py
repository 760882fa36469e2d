"""WARC archives written from and read into a table of record chunks.

A payload is handled as rows ``(record, chunk_no, data)`` of at most ``CHUNK`` bytes. The writer streams
them, in order, into gzip members; the reader streams members back into such rows, each with the SHA-1 of
the payload up to its end, so neither holds a whole record. Archives lie in the shared folder, one for
each task, named by partition and attempt; the stored manifest lists those of finished tasks only.

Of records with equal payloads of at least ``REVISIT_BYTES`` the one with the largest page id holds the
payload (``response``); the others refer to it (``revisit``), with length and digest of the full payload
in their headers. The largest id of a digest is found by a partial aggregate, so a payload that a
third of all pages share is no hot group, and payloads are shuffled by page, not by digest.

Null html is an empty payload. Rows that share page id and payload are one response and revisits
of it. A row without page id is a revisit if any equal payload has an id, else a response. Null urls give
records without target. An empty table gives no archives. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stored

CHUNK = 1 << 16
REVISIT_BYTES = 1000
DATE = "2020-01-01T00:00:00Z"
MANIFEST = "part int, path string, n_records long, n_bytes long"


def record_chunks(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Pages ``(page_id, url, html)`` as chunk rows with their record's type. A record's chunks lie in
    one partition: payloads are shuffled once, for the join with the leaders and for the copies' numbers
    alike."""
    rows = pages.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(0)).alias("page"),
        F.col("page_id").isNull().alias("nameless"),
        "url",
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    ).withColumns({"digest": F.sha1("payload"), "n_bytes": F.octet_length("payload").cast("long")})
    key = ["page", "nameless", "digest"]
    long = rows.where(F.col("n_bytes") >= revisit_bytes).select(*key)
    own_id = F.when(~F.col("nameless"), F.col("page"))
    leaders = long.groupBy("digest").agg(F.max(own_id).alias("leader"), F.count("*").alias("n"))
    leaders = leaders.where("n > 1 AND leader IS NOT NULL").drop("n")
    rows = rows.join(long.distinct().join(leaders, "digest"), key, "left")
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy(*key).orderBy("url")))
    first = ~F.col("nameless") & (F.col("page") == F.col("leader")) & (F.col("copy") == 1)
    own = F.col("leader").isNull() | first
    number = F.when(own, F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / CHUNK))).otherwise(1)
    rows = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), number.cast("int") - 1)))
    data = F.col("payload").substr(F.col("chunk_no") * CHUNK + 1, F.lit(CHUNK))
    return rows.select(
        own_id.alias("page_id"),
        "digest",
        "copy",
        "chunk_no",
        "url",
        "n_bytes",
        F.when(~own, F.col("leader")).alias("refers_to"),
        own.alias("response"),
        F.when(own, data).alias("data"),
    )


def record_id(page_id: int | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {digest} {copy}')}>"


def _head(row: dict) -> bytes:
    """The record's headers up to its payload, the HTTP headers included."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {row['n_bytes']}\r\n\r\n"
    ).encode()
    digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
    fields = {
        "WARC-Type": "response" if row["response"] else "revisit",
        "WARC-Record-ID": record_id(row["page_id"], row["digest"], row["copy"]),
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(http) + (row["n_bytes"] if row["response"] else 0),
    }
    if row["url"] is not None:
        fields["WARC-Target-URI"] = re.sub(
            r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"]
        )
    if row["page_id"] is not None:
        fields["Page-ID"] = row["page_id"]
    if not row["response"]:
        fields["WARC-Profile"] = (
            "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        )
        fields["WARC-Refers-To"] = record_id(row["refers_to"], row["digest"], 1)
        fields["Refers-To-Page-ID"] = row["refers_to"]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + http


class _Archive:
    """A file of gzip members, one for each record."""

    def __init__(self, path: str):
        system, name = fs.FileSystem.from_uri(path)
        self.sink = system.open_output_stream(name, compression=None)
        self.member = None
        self.n_records = self.n_bytes = 0

    def _write(self, data: bytes) -> None:
        self.n_bytes += len(data)
        self.sink.write(data)

    def begin(self, head: bytes) -> None:
        self.end()
        self.member = zlib.compressobj(1, wbits=31)
        self.n_records += 1
        self._write(self.member.compress(head))

    def add(self, data: bytes) -> None:
        self._write(self.member.compress(data))

    def end(self) -> None:
        if self.member:
            self._write(self.member.compress(b"\r\n\r\n") + self.member.flush())
            self.member = None

    def close(self) -> None:
        self.end()
        self.sink.close()


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Write :func:`record_chunks`, a record's chunks in one partition, as WARC files; the stored
    manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId()
        path = f"{folder}/part-{part:06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        archive = None
        for batch in batches:
            for row in batch.to_pylist():
                archive = archive or _Archive(path)
                if row["chunk_no"] == 0:
                    archive.begin(_head(row))
                if row["data"]:
                    archive.add(row["data"])
        if archive:
            archive.close()
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "path": [path],
                    "n_records": [archive.n_records],
                    "n_bytes": [archive.n_bytes],
                }
            )

    system, name = fs.FileSystem.from_uri(folder)
    system.create_dir(name, recursive=True)
    ordered = chunks.sortWithinPartitions("page_id", "digest", "copy", "chunk_no")
    return stored(ordered.mapInArrow(write, MANIFEST), "warc-manifest")


class _Members:
    """The bytes of all gzip members of a file, read piece by piece."""

    def __init__(self, source):
        self.source, self.raw, self.ready = source, b"", bytearray()
        self.member = zlib.decompressobj(wbits=31)

    def _more(self) -> bool:
        if not self.raw:
            self.raw = self.source.read(1 << 18)
            if not self.raw:
                return False
        if self.member.eof:
            self.member = zlib.decompressobj(wbits=31)
        self.ready += self.member.decompress(self.raw, 1 << 18)
        self.raw = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
        return True

    def line(self) -> bytes:
        while (end := self.ready.find(b"\r\n")) < 0:
            if not self._more():
                return b""
        out = bytes(self.ready[: end + 2])
        del self.ready[: end + 2]
        return out

    def take(self, size: int) -> bytes:
        while len(self.ready) < size:
            if not self._more():
                raise ValueError("the archive ends within a record")
        out = bytes(self.ready[:size])
        del self.ready[:size]
        return out


def _fields(stream: _Members) -> tuple[dict[str, str], int]:
    """Header lines up to an empty one, and how many bytes they took."""
    out, size = {}, 0
    while (line := stream.line()) != b"\r\n":
        size += len(line)
        key, _, value = line.decode().partition(":")
        out[key.lower()] = value.strip()
    return out, size + 2


CHUNKS = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "chunk_no int, last boolean, digest string, data binary"
)


def _records(stream: _Members, with_data: bool) -> Iterator[tuple]:
    while stream.line().startswith(b"WARC/"):
        fields, _ = _fields(stream)
        status = stream.line()
        http, size = _fields(stream)
        left = int(fields["content-length"]) - len(status) - size
        number = lambda k: int(fields[k]) if k in fields else None
        head = number("page-id"), fields.get("warc-target-uri"), fields["warc-type"]
        head += number("refers-to-page-id"), int(http["content-length"])
        said = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
        if fields["warc-type"] == "revisit":
            yield *head, 0, True, said, None
        else:
            sha, chunk_no, last = hashlib.sha1(), 0, False
            while not last:
                data = stream.take(min(CHUNK, left))
                left -= len(data)
                sha.update(data)
                last = not left
                yield *head, chunk_no, last, sha.hexdigest(), data if with_data else None
                chunk_no += 1
            if sha.hexdigest() != said:
                raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
        stream.take(4)


def read_chunks(manifest: DataFrame, with_data: bool = True) -> DataFrame:
    """The archives as chunk rows. ``digest`` is the SHA-1 of the payload up to the chunk's end, so
    the row that is ``last`` has the whole payload's; a revisit is one row, without data."""
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
    schema = pa.schema(list(zip(names, [*kinds, pa.bool_(), pa.string(), pa.binary()])))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with system.open_input_stream(name, compression=None) as source:
                    for row in _records(_Members(source), with_data):
                        rows.append(dict(zip(names, row)))
                        size += len(row[-1] or b"") + 256
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    parts = 4 * manifest.sparkSession.sparkContext.defaultParallelism
    files = manifest.select("path", "part").repartitionByRange(parts, "part").select("path")
    return files.mapInArrow(read, CHUNKS)


def read_payloads(manifest: DataFrame) -> DataFrame:
    """Whole payloads of the response records."""
    rows = read_chunks(manifest).where("record_type = 'response'")
    parts = F.array_sort(F.collect_list(F.struct("chunk_no", "data")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, c: F.concat(a, c["data"]))
    return rows.groupBy("page_id", "url").agg(joined.alias("payload"))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back: a row a record."""
    folder = scratch(pages.sparkSession, "warc")
    rows = read_chunks(write_archives(record_chunks(pages), folder), with_data=False)
    return rows.where("last").select(
        "page_id",
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )
