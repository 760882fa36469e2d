"""Token ids in files of directly addressable codes.

An id is cut into chunks of 8 bits. Level 0 holds the lowest chunk of every id and a bitmap that says
which ids go on; level 1 holds the next chunk of only those, and so on. A directory with the number
of set bits before every 512th position turns a position on one level into the place on the next, so
any id is read from a few bytes of each level without decoding what stands before it. Files are read by
blocks: one id costs the reading of its block, and the decoding of one id.

A file is a run of blocks of ``BLOCK`` ids (the last may be shorter), then the blocks' places, the
documents' ids and lengths, and a trailer. Files are written by the tasks of a range sort on
``doc_id`` into the shared folder; each is named by its partition and attempt, and the returned
manifest lists only those of finished tasks, so a repeated task leaves nothing wrong behind.

Null texts are empty; null ids come first. Rows that share an id follow one another in the order of the
scan, over any number of tasks, each with a start of its own. An empty table gives no files and no rows. Other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, scratch, stored, texts_of
from .vocabulary import chunk_table, encode_texts, with_end

BLOCK = 1 << 18
STEP = 512
MAGIC = b"SLDAC001"
MANIFEST = "part int, path string, n_docs long, n_tokens long, n_bytes long"


def encode_block(ids: np.ndarray) -> bytes:
    """One block: the number of levels, then per level its length, chunks, bitmap and directory."""
    levels, left = [], ids.astype(np.uint32)
    while len(left):
        rest = left >> 8
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        before = np.concatenate(([0], np.cumsum(more, dtype=np.int64)))[0 : len(left) : STEP]
        levels.append(
            struct.pack("<I", len(left))
            + (left & 0xFF).astype(np.uint8).tobytes()
            + bits.tobytes()
            + before.astype("<u4").tobytes()
        )
        left = rest[more]
    return struct.pack("<B", len(levels)) + b"".join(levels)


class Block:
    """A block's levels as views on its bytes."""

    def __init__(self, data: bytes):
        self.levels, at = [], 1
        for _ in range(data[0]):
            (n,) = struct.unpack_from("<I", data, at)
            sizes = n, -(-n // 8), 4 * -(-n // STEP)
            parts, at = [], at + 4
            for size in sizes:
                parts.append(np.frombuffer(data, np.uint8, size, at))
                at += size
            self.levels.append((n, parts[0], parts[1], parts[2].view("<u4")))

    def __len__(self) -> int:
        return self.levels[0][0] if self.levels else 0

    def __getitem__(self, at: int) -> int:
        """The id at a place, from one chunk and one directory entry a level."""
        if not 0 <= at < len(self):
            raise IndexError(at)
        value = shift = 0
        for _, chunks, bits, before in self.levels:
            value |= int(chunks[at]) << shift
            if not bits[at >> 3] >> (at & 7) & 1:
                break
            first = at // STEP * STEP
            own = np.unpackbits(bits[first >> 3 : (at >> 3) + 1], bitorder="little")
            at = int(before[at // STEP]) + int(own[: at - first].sum())
            shift += 8
        return value

    def all(self) -> np.ndarray:
        out = np.zeros(0, np.uint32)
        for n, chunks, bits, _ in reversed(self.levels):
            whole = chunks.astype(np.uint32)
            whole[np.unpackbits(bits, count=n, bitorder="little").astype(bool)] |= out << 8
            out = whole
        return out


class TokenFile:
    """A file opened for reading; only the asked blocks are read."""

    def __init__(self, path: str):
        system, name = fs.FileSystem.from_uri(path)
        self.source = system.open_input_file(name)
        size = self.source.size()
        tail = self.source.read_at(24, size - 24)
        n_docs, n_blocks = struct.unpack("<QQ", tail[:16])
        if tail[16:] != MAGIC:
            raise ValueError(f"{path} is no token file")
        long = 8 * (n_blocks + 1) + 17 * n_docs
        data = self.source.read_at(long, size - 24 - long)
        self.places = np.frombuffer(data, "<i8", n_blocks + 1)
        at = 8 * (n_blocks + 1)
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        self.counts = np.frombuffer(data, "<i8", n_docs, at + 8 * n_docs)
        self.missing = np.frombuffer(data, np.uint8, n_docs, at + 16 * n_docs).astype(bool)

    def block(self, k: int) -> Block:
        first, end = int(self.places[k]), int(self.places[k + 1])
        return Block(self.source.read_at(end - first, first))

    def __getitem__(self, at: int) -> int:
        return self.block(at // BLOCK)[at % BLOCK]

    def blocks(self) -> Iterator[np.ndarray]:
        for k in range(len(self.places) - 1):
            yield self.block(k).all()

    def close(self) -> None:
        self.source.close()


class _Writer:
    def __init__(self, path: str):
        system, name = fs.FileSystem.from_uri(path)
        self.sink = system.open_output_stream(name, compression=None)
        self.places, self.held, self.size, self.n_tokens = [0], [], 0, 0
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, ids: np.ndarray) -> None:
        self.n_tokens += len(ids)
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= BLOCK:
            whole = np.concatenate(self.held)
            full = len(whole) // BLOCK * BLOCK
            for first in range(0, full, BLOCK):
                self._block(whole[first : first + BLOCK])
            self.held, self.size = [whole[full:].copy()], len(whole) - full

    def _block(self, ids: np.ndarray) -> None:
        data = encode_block(ids)
        self.sink.write(data)
        self.places.append(self.places[-1] + len(data))

    def close(self) -> tuple[int, int]:
        if self.size:
            self._block(np.concatenate(self.held))
        columns = [np.concatenate(c) for c in zip(*self.docs)]
        data = np.array(self.places, "<i8").tobytes()
        data += columns[0].astype("<i8").tobytes() + columns[1].astype("<i8").tobytes()
        data += columns[2].astype(np.uint8).tobytes()
        data += struct.pack("<QQ", len(columns[0]), len(self.places) - 1) + MAGIC
        self.sink.write(data)
        self.sink.close()
        return len(columns[0]), self.places[-1] + len(data)


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, parts: int) -> DataFrame:
    """Write ``(doc_id, text)`` as token files in ``folder``, in ascending order of ``doc_id`` over
    and within the files; the manifest of the files, stored."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId()
        path = f"{folder}/part-{part:06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.dac"
        table, writer = chunk_table(vocabulary), None
        for batch in batches:
            if not batch.num_rows:
                continue
            writer = writer or _Writer(path)
            ids, counts = with_end(*encode_texts(table, texts_of(batch.column(1))))
            writer.add(ids)
            key = batch.column(0)
            known = np.asarray(key.fill_null(0))
            writer.docs.append((known, counts, np.asarray(key.is_null())))
        if writer:
            n_docs, size = writer.close()
            row = [part], [path], [n_docs], [writer.n_tokens], [size]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(v, t)
                    for v, t in zip(row, (pa.int32(), pa.string(), *[pa.int64()] * 3))
                ],
                ["part", "path", "n_docs", "n_tokens", "n_bytes"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    # rows of one id may be many: their places in the scan split them over tasks
    order = ["doc_id", "_row"]
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    fs_, name = fs.FileSystem.from_uri(folder)
    fs_.create_dir(name, recursive=True)
    return stored(ordered.mapInArrow(write, MANIFEST), "token-manifest")


DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_token_documents(manifest: DataFrame) -> DataFrame:
    """Per document of the files: its place among all ids, its length and the crc32 of its ids.

    The running total over the files is one window over the manifest, a row a file.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    schema = pa.schema(
        [(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = TokenFile(path)
                crcs = _document_crcs(file)
                ends = np.cumsum(file.counts)
                yield batch_of(
                    schema,
                    pa.array(file.doc_ids, pa.int64(), mask=file.missing),
                    start + ends - file.counts,
                    file.counts,
                    crcs,
                )
                file.close()

    parts = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    files = starts.select("path", "start", "part").repartitionByRange(4 * parts, "part")
    return files.select("path", "start").mapInArrow(read, DOCUMENTS)


def _document_crcs(file: TokenFile) -> list[int]:
    """Block after block, so that no more than one block is in memory."""
    out: list[int] = []
    counts = file.counts.tolist()
    left, crc = (counts[0] if counts else 0), 0
    for block in file.blocks():
        data, at = memoryview(block.astype("<u4").tobytes()), 0
        while at < len(data) and len(out) < len(counts):
            size = min(4 * left, len(data) - at)
            crc = zlib.crc32(data[at : at + size], crc)
            at += size
            left -= size // 4
            while left == 0 and len(out) < len(counts):
                out.append(crc)
                crc = 0
                left = counts[len(out)] if len(out) < len(counts) else -1
    return out


def token_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode, write and read back; see :data:`DOCUMENTS`."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = scratch(spark, "tokens")
    return read_token_documents(write_token_files(docs, vocabulary, folder, parts))
