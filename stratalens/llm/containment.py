"""Search for benchmark items inside documents by size-partitioned MinHash containment.

A short item inside a long document has a small Jaccard similarity to it, so plain MinHash misses it.
Documents are partitioned by size instead (powers of two of their shingle count) and a partition's
sketch grows with its upper size: a one-permutation MinHash, the least shingle hash in each of
``factor * size`` bins. A shared shingle stays in the sketch with the same probability in each
partition, so the chance to miss an item depends on the number of its shingles alone, and ``factor`` is
set from the smallest item so that at most ``1 - RECALL`` of those at the threshold are missed.

A document whose sketch holds a shingle of an item is a candidate, verified at once by exact
containment: the share of the item's shingles among all shingles of the document.

Items are the query set. They go to the tasks in blocks of at most ``BLOCK_SHINGLES`` shingles, one
pass over the documents for each block; documents are not shuffled and no pairs but results are made.

Shingles are five lower-cased words; an item of fewer words is one shingle of all its words, and
documents then have shingles of that length as well. Items without words match nothing. Null texts
have no words. Equal items (id and text) count once; equal documents give a row each. Null ids are
kept. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, spread, texts_of
from .repeats import BASES, Rolling, _hashed, mix

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
BLOCK_SHINGLES = 2_000_000
FOUND = "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double"


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words of one text, from its words' digests."""
    at = np.arange(max(0, len(hashes) - size + 1))
    return mix(Rolling(hashes[:, 0], BASES[0])(at, at + size) ^ np.uint64(size))


def kept_share(factor: float) -> float:
    """The expected share of shingles that are the least of their bin, with ``factor`` bins a shingle."""
    return factor * -math.expm1(-1 / factor)


def bins_factor(least_shared: int, recall: float = RECALL) -> float:
    """Bins a shingle so that ``least_shared`` shared shingles are all lost with probability of at
    most ``1 - recall``."""
    share = 1 - (1 - recall) ** (1 / max(1, least_shared))
    low, high = 1e-3, 1e6
    for _ in range(60):
        middle = math.sqrt(low * high)
        low, high = (middle, high) if kept_share(middle) < share else (low, middle)
    return high


def sketch(distinct: np.ndarray, factor: float) -> np.ndarray:
    """The least hash of each bin, of sorted distinct hashes; bins by the size's upper bound."""
    upper = 1 << max(0, len(distinct) - 1).bit_length()
    bins = max(1, math.ceil(upper * factor))
    at = (distinct >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    return distinct[first]


def lowered(texts: list[str]) -> pa.Array:
    return pa.array([t.lower() for t in texts], pa.string())


class Items:
    """A block of items: their shingles, and for each shingle the items that hold it."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids, self.sets, sizes = [], [], set()
        for first, end, hashes, counts in _hashed(lowered(texts)):
            parts = np.split(hashes, np.cumsum(counts)[:-1])
            for i, own in zip(range(first, end), parts):
                if len(own):
                    size = min(SHINGLE, len(own))
                    self.ids.append(ids[i])
                    self.sets.append(np.unique(shingles(own, size)))
                    sizes.add(size)
        self.sizes = sorted(sizes)
        owner = np.repeat(np.arange(len(self.sets)), [len(s) for s in self.sets])
        every = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.every, self.owner = every[order], owner[order]
        # a bit for each value of the hash's upper 20 bits: most lookups end here
        self.high = np.zeros(1 << 20, bool)
        self.high[(every >> np.uint64(44)).astype(np.int64)] = True

    def holding(self, found: np.ndarray) -> np.ndarray:
        """Numbers of the items that hold any of the given hashes."""
        found = found[self.high[(found >> np.uint64(44)).astype(np.int64)]]
        if not len(found):
            return np.zeros(0, np.int64)
        low = np.searchsorted(self.every, found, side="left")
        high = np.searchsorted(self.every, found, side="right")
        return np.unique(np.concatenate([self.owner[a:b] for a, b in zip(low, high)]))


def _matches(index: Items, factor: float, threshold: float, texts: list[str]) -> Iterator[tuple]:
    """``(text, item, shingles of the item, shared ones)`` by their numbers."""
    for first, _, hashes, counts in _hashed(lowered(texts)):
        ends = np.cumsum(counts).tolist()
        for i, n in enumerate(counts.tolist()):
            for size in index.sizes if n else ():
                own = np.unique(shingles(hashes[ends[i] - n : ends[i]], size))
                for item in index.holding(sketch(own, factor)).tolist():
                    asked = index.sets[item]
                    at = np.minimum(np.searchsorted(own, asked), len(own) - 1)
                    shared = int((own[at] == asked).sum())
                    if shared >= threshold * len(asked):
                        yield first + i, item, len(asked), shared


def _blocks(items: DataFrame, threshold: float, block: int) -> Iterator[tuple[Items, float]]:
    """The items in blocks, each with the sketches' factor."""
    asked = items.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    asked = asked.distinct()
    # an item has no more shingles than half its characters
    size = asked.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    n_blocks = max(1, math.ceil(size / block))
    for number in range(n_blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == number)
        got = sorted(own.collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        index = Items([r[0] for r in got], [r[1] for r in got])
        least = min((math.ceil(threshold * len(s)) for s in index.sets), default=1)
        yield index, bins_factor(least)


def _opened(sent) -> Items:
    """A block as the driver sent it; classes travel by value, so only its fields are sent."""
    index = Items([], [])
    index.__dict__ = sent.value
    return index


def containment_search(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK_SHINGLES
) -> DataFrame:
    """All ``(doc_id, item_id)`` where ``threshold`` or more of the item's shingles are in the
    document; see :data:`FOUND`."""
    rows = spread(docs.select(F.col("doc_id").cast("long"), "text"))
    names = [c.split()[0] for c in FOUND.split(", ")]
    schema = pa.schema(list(zip(names, [*[pa.int64()] * 4, pa.float64()])))
    out = None
    for index, factor in _blocks(items, threshold, block):
        sent = docs.sparkSession.sparkContext.broadcast(index.__dict__)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, factor=factor):
            index = _opened(sent)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found = [
                    (ids[i], index.ids[item], asked, shared, shared / asked)
                    for i, item, asked, shared in _matches(
                        index, factor, threshold, texts_of(batch.column(1))
                    )
                ]
                yield batch_of(schema, *(list(c) for c in zip(*found)) if found else [[]] * 5)

        part = rows.mapInArrow(run, FOUND)
        out = part if out is None else out.unionByName(part)
    return out


def without_items(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK_SHINGLES
) -> DataFrame:
    """``docs`` without the documents that hold an item, with all columns."""
    text_at, schema = docs.columns.index("text"), docs.schema
    rows = spread(docs)
    for index, factor in _blocks(items, threshold, block):
        sent = docs.sparkSession.sparkContext.broadcast(index.__dict__)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, factor=factor):
            index = _opened(sent)
            for batch in batches:
                texts = texts_of(batch.column(text_at))
                keep = np.ones(len(texts), bool)
                keep[[m[0] for m in _matches(index, factor, threshold, texts)]] = False
                yield batch.filter(pa.array(keep))

        rows = rows.mapInArrow(run, schema)
    return rows
