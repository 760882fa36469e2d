"""Best-fit-decreasing packing of token sequences.

Pieces of one length can take each other's place, so the packing depends on the number of pieces per
length alone. That histogram, at most ``capacity`` rows whatever the corpus, is packed on the driver:
lengths in descending order, each put into the open sequence with the least room that holds it. A
segment tree over the capacities finds that room in logarithmic time; all pieces of one length that
go to sequences of equal room are placed in one step. The result is what best-fit decreasing gives
piece by piece over the whole corpus, not over shards of it.

The plan comes back as runs ``(length, first rank) -> sequences``. Ranks within a length are dealt
in Spark: row numbers inside hashed buckets plus the counts of the buckets before, so a length that
a third of all pieces share is spread over all buckets.

Null texts are empty and give one piece, the end id. Documents that share an id are packed each for
itself. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, spread, stored, texts_of
from .vocabulary import chunk_table, encode_texts, with_end

CAPACITY = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces ranked in one bucket, about.
BUCKET_ROWS = 100_000


def pieces(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, keep_ids: bool = False
) -> DataFrame:
    """Token ids of every text with the end id, cut after every ``capacity`` ids.

    ``keep_ids`` adds the ids themselves.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32())]
    fields += [(n, pa.int64()) for n in ("start", "length", "ids_crc32")]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * keep_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(vocabulary)
        for batch in batches:
            ids, counts = with_end(*encode_texts(table, texts_of(batch.column(1))))
            number = -(-counts // capacity)
            owner = np.repeat(np.arange(len(counts)), number)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
            start = piece * capacity
            length = np.minimum(capacity, counts[owner] - start)
            at = np.concatenate(([0], np.cumsum(length)))
            data = memoryview(ids.astype("<u4").tobytes())
            ends = (4 * at).tolist()
            crcs = [zlib.crc32(data[a:b]) for a, b in zip(ends, ends[1:])]
            columns = [batch.column(0).take(pa.array(owner)), piece.astype(np.int32), start]
            columns += [length, crcs]
            if keep_ids:
                flat = pa.array(ids.astype(np.int32))
                columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), flat))
            yield batch_of(schema, *columns)

    rows = spread(docs.select(F.col("doc_id").cast("long"), "text"))
    return rows.mapInArrow(cut, PIECES + (", ids array<int>" if keep_ids else ""))


class CapacityTree:
    """Which amounts of room some open sequence has; the least one that is large enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)

    def set(self, room: int, there: bool) -> None:
        node = self.leaves + room
        self.any[node] = there
        while node > 1:
            node >>= 1
            self.any[node] = self.any[2 * node] | self.any[2 * node + 1]

    def least(self, room: int) -> int | None:
        """The least amount from ``room`` up, found by going up and then down the tree."""
        node = self.leaves + room
        if self.any[node]:
            return room
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node + (not self.any[2 * node])
                return node - self.leaves
            node >>= 1
        return None


@dataclass
class Plan:
    """Pieces of ``length`` with ranks from ``rank`` on go to sequences from ``sequence`` on,
    ``each`` to a sequence, the first at ``offset``; sorted by length and rank."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    n_sequences: int


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best-fit decreasing for ``counts[length]`` pieces of each length from 1 to ``capacity``."""
    tree = CapacityTree(capacity)
    # room -> runs of sequences with that room: (first sequence, number)
    open_runs: dict[int, list[tuple[int, int]]] = {}
    runs: list[tuple[int, int, int, int, int]] = []
    made = 0

    def give_back(room: int, first: int, number: int) -> None:
        if room and number:
            open_runs.setdefault(room, []).append((first, number))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.least(length)
            if room is None:
                room = capacity
                first, number = made, -(-left // (capacity // length))
                made += number
            else:
                first, number = open_runs[room].pop()
                if not open_runs[room]:
                    tree.set(room, False)
            each = room // length
            full = min(number, left // each)
            rest = left - full * each if full < number else 0
            if full:
                runs.append((length, rank, first, each, capacity - room))
                give_back(room - each * length, first, full)
                rank += full * each
            if rest:
                runs.append((length, rank, first + full, each, capacity - room))
                give_back(room - rest * length, first + full, 1)
                rank += rest
            untouched = full + bool(rest)
            give_back(room, first + untouched, number - untouched)
            left -= full * each + rest
    ordered = sorted(runs)
    columns = [np.array(c, np.int64) for c in zip(*ordered)] or [np.zeros(0, np.int64)] * 5
    return Plan(*columns, n_sequences=made)


PACKED = PIECES + ", sequence_id long, offset long"


def packed(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Stored :func:`pieces` with ``sequence_id`` and ``offset``: as few sequences as best-fit
    decreasing makes, gapless from offset 0."""
    n_rows = rows.count()
    buckets = max(1, min(1 << 20, n_rows // BUCKET_ROWS + 1))
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets))
    dealt = rows.withColumn("bucket", bucket)
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(before), F.lit(0))
    sizes = stored(sizes.withColumn("before", first), "piece-counts")
    total = sizes.groupBy("length").agg(F.sum("n").alias("n"))
    plan = best_fit_plan({r["length"]: r["n"] for r in total.collect()}, capacity)

    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(own) - 1)
    ranked = ranked.join(sizes.drop("n"), ["length", "bucket"])
    names = [n for n in rows.columns]
    ranked = ranked.select(*names, (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = plan.length << 40 | plan.rank
        for batch in batches:
            rank = np.asarray(batch.column("rank")).astype(np.int64)
            length = np.asarray(batch.column("length"))
            run = np.searchsorted(key, length << 40 | rank, side="right") - 1
            nth = rank - plan.rank[run]
            sequence = plan.sequence[run] + nth // plan.each[run]
            offset = plan.offset[run] + nth % plan.each[run] * length
            columns = [batch.column(n) for n in names]
            columns += [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents with their places; see :data:`PACKED`."""
    return packed(stored(pieces(docs, vocabulary, capacity), "pieces"), capacity)


def sequences(packed_ids: DataFrame) -> DataFrame:
    """The packed ids, one row per sequence, of pieces with ids: at most ``capacity`` ids a group."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed_ids.groupBy("sequence_id").agg(
        F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids")
    )
