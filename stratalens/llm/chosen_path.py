"""Jaccard similarity join on word shingles by chosen paths.

Documents with equal shingle sets are one class from the start; all further work is on the distinct
sets, so exact copies, however many, cost one row. Each set has a MinHash sketch. A path starts at the root
of a run; at each level the path's own hash picks a coordinate of the sketch (and now and then a second
one, ``1 / THRESHOLD`` on average) and the set goes on to the child named by its value there, so that sets
meet as long as they agree on the sampled tokens. Buckets of at most ``SMALL`` sets are compared by
brute force on sketches; larger ones are split on, until ``DEPTH`` levels, where members agree on so many
samples that each is tied to the bucket's first without a look. Runs are repeated until a pair at the
threshold is met with probability ``RECALL`` or more even on the deepest level.

Sets tied by any bucket form a candidate component, and inside it links are decided exactly on whole
shingle sets. A component of more than ``BLOCK`` sets is laid out in blocks by set size, and block pairs
whose sizes allow the threshold are compared each in its own task: a hot group of near copies is neither
gathered nor written as pairs. A document's number of links counts all other documents, copies included,
whose similarity is at least ``THRESHOLD``; a class is what links connect.

Shingles are five words, as they stand; a text of one to four words has one shingle of all. Null and
empty texts have none, are similar to nothing and are each a class of its own. A class's id is its least
document id. Rows that share an id are rows of their own. A row without id is linked like others; a
class of such rows only has no id. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, by_group, spread, stored
from .repeats import BASES, LAST, Rolling, _hashed, _rows, mix

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
COORDINATES = 64
SMALL = 256
START = 2
DEPTH = 6
BLOCK = 256
#: Sketches this similar tie their sets: three standard deviations below the threshold.
TIED = THRESHOLD - 3 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / COORDINATES)
U = np.uint64


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of one text, from its words' digests."""
    size = min(SHINGLE, len(hashes))
    if not size:
        return np.zeros(0, np.uint64)
    at = np.arange(len(hashes) - size + 1)
    found = Rolling(hashes[:, 0], BASES[0])(at, at + size) + Rolling(hashes[:, 1], BASES[1])(at, at + size)
    return np.unique(mix(found + U(size)))


def sketches(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """MinHash values of sets that follow one another, none of them empty."""
    starts = np.cumsum(counts) - counts
    out = np.zeros((len(counts), COORDINATES), np.uint32)
    seeds = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * BASES[0])
    for k in range(COORDINATES):
        order = (values ^ seeds[k]) * (seeds[COORDINATES + k] | U(1))
        out[:, k] = np.minimum.reduceat(order, starts) >> U(32)
    return out


def met(similarity: float, depth: int) -> float:
    """The probability that a pair shares a path of ``depth`` levels in one run."""
    second, lost = 1 / THRESHOLD - 1, 0.0
    for _ in range(depth):
        child = 1 - similarity + similarity * lost
        lost = (1 - second) * child + second * child**2
    return 1 - lost


def runs_needed(recall: float = RECALL, depth: int = DEPTH) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - met(THRESHOLD, depth)))


def children(keys: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next keys on the paths ``keys`` of the sets in ``sketch``, and each one's row."""
    rows = np.arange(len(keys))
    chosen = mix(keys + U(1)) % U(COORDINATES)
    second = np.flatnonzero(mix(keys + U(2)) < U(int((1 / THRESHOLD - 1) * 2.0**64)))
    rows = np.concatenate((rows, second))
    chosen = np.concatenate((chosen, mix(keys[second] + U(3)) % U(COORDINATES)))
    token = chosen << U(32) | sketch[rows, chosen.astype(np.int64)].astype(np.uint64)
    return mix(keys[rows] * BASES[1] ^ mix(token + BASES[0])), rows


SETS = "doc long, salt binary, hi long, lo long, n long, sketch binary"


def _sets(docs: DataFrame) -> DataFrame:
    """Each document's set as 128 bits, its size and sketch."""
    kinds = [("doc", pa.int64()), ("salt", pa.binary()), *[(n, pa.int64()) for n in ("hi", "lo", "n")]]
    schema = pa.schema([*kinds, ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, hashes, counts in _hashed(batch.column(2)):
                cuts = np.cumsum(counts)[:-1]
                own = [shingle_set(h) for h in np.split(hashes, cuts)]
                sizes = np.array([len(s) for s in own], np.int64)
                some = np.flatnonzero(sizes)
                made: list = [None] * len(own)
                if len(some):
                    found = sketches(np.concatenate(own), sizes[some])
                    for i, row in zip(some.tolist(), found):
                        made[i] = row.tobytes()
                digest = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in own)
                named = np.frombuffer(digest, np.int64).reshape(-1, 2)
                part = slice(first, end)
                yield batch_of(
                    schema,
                    np.asarray(batch.column(0))[part],
                    batch.column(1).slice(first, end - first),
                    named[:, 0],
                    named[:, 1],
                    sizes,
                    made,
                )

    return _rows(docs).mapInArrow(run, SETS)


def _sketch_matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    data = b"".join(flat.to_pylist())
    return np.frombuffer(data, np.uint32).reshape(-1, COORDINATES)


PATHS = "key long, v long"
_PATHS = pa.schema([("key", pa.int64()), ("v", pa.int64())])


def _paths(sets: DataFrame, runs: int) -> DataFrame:
    """All sets' paths of ``START`` levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v, sketch = np.asarray(batch.column(0)), _sketch_matrix(batch.column(1))
            for r in range(runs):
                keys = np.full(len(v), mix(np.array([r + 1], np.uint64))[0])
                rows = np.arange(len(v))
                for _ in range(START):
                    keys, on = children(keys, sketch[rows])
                    rows = rows[on]
                yield batch_of(_PATHS, keys.view(np.int64), v[rows])

    return sets.select("hi", "sketch").mapInArrow(run, PATHS)


def _split(paths: DataFrame) -> DataFrame:
    """The paths one level on, of rows ``key, v, sketch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = np.asarray(batch.column(0)).view(np.uint64)
                keys, rows = children(keys, _sketch_matrix(batch.column(2)))
                yield batch_of(_PATHS, keys.view(np.int64), np.asarray(batch.column(1))[rows])

    return paths.select("key", "v", "sketch").mapInArrow(run, PATHS)


def connected(linked: np.ndarray) -> np.ndarray:
    """The first row that each row of a symmetric relation is connected to."""
    labels = np.arange(len(linked))
    linked = linked | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(linked, labels, len(labels)).min(1)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def _tied(chunk: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Ties ``a, b`` of sets with similar sketches inside each bucket, a star for each group."""
    v, sketch = np.asarray(chunk.column("v")), _sketch_matrix(chunk.column("sketch"))
    a, b = [], []
    sizes = np.diff(starts)
    pair = starts[:-1][sizes == 2]
    near = pair[(sketch[pair] == sketch[pair + 1]).mean(1) >= TIED]
    a.append(v[near])
    b.append(v[near + 1])
    for at, size in zip(starts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        own = sketch[at : at + size]
        root = connected((own[:, None] == own[None]).mean(2) >= TIED)
        member = np.flatnonzero(root != np.arange(size))
        a.append(v[at + root[member]])
        b.append(v[at + member])
    yield batch_of(pa.schema([("a", pa.int64()), ("b", pa.int64())]), np.concatenate(a), np.concatenate(b))


def _ties(sets: DataFrame, runs: int) -> DataFrame:
    """``a, b``: sets that some bucket ties."""
    sketch = sets.select(F.col("hi").alias("v"), "sketch")
    paths, out = stored(_paths(sets, runs), "paths"), None
    for depth in range(START, DEPTH + 1):
        sizes = paths.groupBy("key").count().where("count > 1")
        shared = stored(paths.join(sizes, "key"), "shared-paths")
        small = shared.where(F.col("count") <= SMALL).join(sketch, "v").select("key", "v", "sketch")
        found = by_group(small, "key", _tied, "a long, b long")
        large = shared.where(F.col("count") > SMALL)
        if depth == DEPTH:
            least = large.groupBy("key").agg(F.min("v").alias("a"))
            found = found.unionByName(
                large.join(least, "key").where("v <> a").select("a", F.col("v").alias("b"))
            )
        out = found if out is None else out.unionByName(found)
        if depth == DEPTH or large.isEmpty():
            break
        paths = stored(_split(large.join(sketch, "v")), "paths")
    ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return stored(out.where("a <> b").select(*ends).distinct(), "ties")


def components(ties: DataFrame) -> DataFrame:
    """``v, root`` for stored ties ``a, b``: the least member of each connected group.

    Every round takes the least root among neighbours and then the root's own root, in joins and partial
    aggregates; each round's table is written to the shared folder.
    """
    both = ties.select("a", "b").union(ties.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.select(F.col("a").alias("v"), F.col("b").alias("w")), "both-ways")
    roots = both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("root"))
    roots = stored(roots, "roots")
    while True:
        near = both.join(roots.select(F.col("v").alias("w"), "root"), "w")
        near = near.groupBy("v").agg(F.min("root").alias("near"))
        up = roots.select(F.col("v").alias("root"), F.col("root").alias("up"))
        new = roots.join(near, "v").join(up, "root").select(
            "v", F.least("near", "up").alias("new"), F.col("root").alias("old")
        )
        new = stored(new.select("v", F.least("new", "old").alias("root"), "old"), "roots")
        if new.where("root <> old").isEmpty():
            return new.select("v", "root")
        roots = new.select("v", "root")


def _blocks(members: DataFrame) -> DataFrame:
    """``members`` with ``groups``: the block pairs each set takes part in, and ``alone``: whether its
    component is a single group.

    Sets are banded by size so that links join only equal or neighbouring bands; a band has blocks of about
    ``BLOCK`` sets, dealt by hash. Small components are one block.
    """
    total = members.groupBy("root").agg(F.count("*").alias("members"))
    rows = members.join(total, "root").withColumn("alone", F.col("members") <= BLOCK)
    band = F.floor(F.log("n") / math.log(1 / THRESHOLD) + 1e-9).cast("long")
    rows = rows.withColumn("band", F.when(F.col("alone"), 0).otherwise(band))
    bands = rows.where("NOT alone").groupBy("root", "band")
    bands = stored(bands.agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "bands")
    for name, step in (("own", 0), ("lower", -1), ("upper", 1)):
        other = bands.select("root", (F.col("band") - step).alias("band"), F.col("blocks").alias(name))
        rows = rows.join(other, ["root", "band"], "left")
    block = F.pmod(F.xxhash64("hi", "lo"), F.coalesce("own", F.lit(1)))
    rows = rows.withColumn("block", block.cast("long"))

    def pair(low_band, low, high_band, high):
        parts = [F.col("root"), low_band, low, high_band, high]
        return F.concat_ws(":", *[p.cast("string") for p in parts])

    band, block = F.col("band"), F.col("block")
    some = lambda n: F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
    none = F.array().cast("array<string>")
    same = F.transform(
        some(F.coalesce("own", F.lit(1))),
        lambda k: pair(band, F.least(block, k), band, F.greatest(block, k)),
    )
    lower = F.when(
        F.col("lower").isNotNull(),
        F.transform(some(F.col("lower")), lambda k: pair(band - 1, k, band, block)),
    ).otherwise(none)
    upper = F.when(
        F.col("upper").isNotNull(),
        F.transform(some(F.col("upper")), lambda k: pair(band, block, band + 1, k)),
    ).otherwise(none)
    return rows.select(
        "doc", "salt", "hi", "lo", "n_docs", "alone",
        F.concat_ws(":", "band", "block").alias("place"),
        F.concat(same, lower, upper).alias("groups"),
    )


LINKS = "hi long, lo long, links long, alone boolean, root_hi long, root_lo long"


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two sets share: products of 0/1 matrices, some thousand columns at a time."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    number = np.cumsum(new) - 1
    often = np.bincount(number) > 1
    column = np.cumsum(often) - 1
    keep = often[number]
    owner, column = owner[keep], column[number[keep]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = max(64, min(8192, (4 << 20) // len(sets)))
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + width, width))
    for a, b in zip(edges, edges[1:]):
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], column[a:b] % width] = 1
        out += part @ part.T
    return out


def _verified(chunk: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Exact links inside each block pair; a set's first row there stands for the connected group."""
    hi, lo = np.asarray(chunk.column("hi")), np.asarray(chunk.column("lo"))
    n_docs, alone = np.asarray(chunk.column("n_docs")), chunk.column("alone").to_pylist()
    place, sets = chunk.column("place").to_pylist(), chunk.column("set").to_pylist()
    out: list[tuple] = []
    for at, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
        own = [np.frombuffer(s, np.uint64) for s in sets[at:end]]
        size = np.array([len(s) for s in own], np.float64)
        both = shared_counts(own).astype(np.float64)
        np.fill_diagonal(both, 0)
        # shared / union >= threshold, in whole numbers but for the threshold
        linked = both * (1 + THRESHOLD) >= THRESHOLD * (size[:, None] + size[None]) - 1e-9
        if not alone[at]:
            side = np.array([p == place[at] for p in place[at:end]])
            if not side.all():  # pairs inside one block are counted where it meets itself
                linked &= side[:, None] != side[None]
        root = at + connected(linked)
        links = linked @ n_docs[at:end]
        for i in range(end - at):
            out.append((hi[at + i], lo[at + i], links[i], alone[at], hi[root[i]], lo[root[i]]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip([c.split()[0] for c in LINKS.split(", ")], kinds)))
    yield batch_of(schema, *(list(c) for c in zip(*out)))


def _links(docs: DataFrame, members: DataFrame, repeated: bool) -> DataFrame:
    """:data:`LINKS` rows: a row for each set and block pair. ``repeated``: some rows share id and
    text, so a representative can be found more than once."""
    # members grow with the table, so both sides are shuffled at every size
    rows = _rows(docs).join(members.hint("merge"), ["doc", "salt"])
    names = ["hi", "lo", "n_docs", "alone", "place", "groups"]
    kinds = "hi long, lo long, n_docs long, alone boolean, place string, groups array<string>"
    rows = rows.select("text", *names)
    if repeated:
        rows = rows.dropDuplicates(["hi", "lo"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, hashes, counts in _hashed(batch.column(0)):
                parts = np.split(hashes, np.cumsum(counts)[:-1])
                own = [batch.column(n).slice(first, end - first) for n in names]
                sets = pa.array([shingle_set(h).tobytes() for h in parts], pa.binary())
                yield pa.RecordBatch.from_arrays([*own, sets], [*names, "set"])

    made = rows.mapInArrow(run, f"{kinds}, set binary")
    dealt = made.select("hi", "lo", "n_docs", "alone", "place", "set", F.explode("groups").alias("group"))
    return by_group(dealt, "group", _verified, LINKS, rows=2000)


def similar_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, n_links``, a row for each document, with the class's key and sizes."""
    docs = spread(docs.select("doc_id", "text"))
    every = stored(_sets(docs), "sets")
    sets = every.where("n > 0").groupBy("hi", "lo").agg(
        F.min(F.struct("doc", "salt")).alias("rep"),
        F.count("*").alias("n_docs"),
        F.first("n").alias("n"),
        F.first("sketch").alias("sketch"),
    )
    sets = stored(sets.select("hi", "lo", "rep.doc", "rep.salt", "n_docs", "n", "sketch"), "distinct-sets")
    ties = _ties(sets, runs_needed())
    tied = components(ties).withColumnRenamed("v", "hi")
    members = stored(_blocks(sets.drop("sketch").join(tied, "hi")), "members")
    repeated = not every.groupBy("doc", "salt").count().where("count > 1").isEmpty()
    links = stored(_links(docs, members, repeated), "links")
    # components in one group are finished; the others are connected over their block pairs
    edges = links.where("NOT alone AND hi <> root_hi").select(
        F.least("hi", "root_hi").alias("a"), F.greatest("hi", "root_hi").alias("b")
    )
    joined = components(stored(edges.distinct(), "link-ties")).withColumnRenamed("v", "hi")
    own = links.groupBy("hi", "lo", "alone").agg(
        F.sum("links").alias("links"), F.min("root_hi").alias("first")
    )
    own = own.join(joined, "hi", "left").select(
        "hi", "lo", "links",
        F.when(F.col("alone"), F.col("first")).otherwise(F.coalesce("root", "hi")).alias("class"),
    )
    judged = sets.select("hi", "lo", "doc", "n_docs").join(own, ["hi", "lo"], "left")
    judged = judged.withColumn("class", F.coalesce("class", "hi"))
    named = judged.groupBy("class").agg(F.min("doc").alias("least"), F.sum("n_docs").alias("class_docs"))
    judged = judged.join(named, "class").select(
        "hi", "lo", "class", "least", "class_docs",
        (F.col("n_docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    judged = stored(judged, "classes")
    rows = every.select("doc", "salt", "hi", "lo", "n").join(judged, ["hi", "lo"], "left")
    known = lambda c: F.when(F.col(c) != LAST, F.col(c))
    empty = F.col("n") == 0
    return rows.select(
        known("doc").alias("doc_id"),
        F.when(empty, known("doc")).otherwise(known("least")).alias("class_id"),
        F.when(empty, 0).otherwise(F.col("n_links")).alias("n_links"),
        F.when(empty, 1).otherwise(F.col("class_docs")).alias("class_docs"),
        "salt",
        F.when(empty, F.lit(None)).otherwise(F.col("class")).alias("class_key"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class, that of the least id, with all columns. Documents
    without words are each a class and stay."""
    found = similar_documents(docs)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc")
    some = found.where("class_key IS NOT NULL").select(key, "salt", "class_key")
    keep = some.groupBy("class_key").agg(F.min(F.struct("doc", "salt")).alias("k"))
    none = found.where("class_key IS NULL").select(key, "salt").distinct()
    keep = stored(keep.select("k.doc", "k.salt").unionByName(none), "kept")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = _rows(docs.select("doc_id", "text", whole), "row")
    rows = rows.join(keep, ["doc", "salt"])
    # rows that share id and text are one group too
    nth = F.row_number().over(Window.partitionBy("doc", "salt").orderBy(F.xxhash64("row")))
    rows = rows.withColumn("nth", nth).where((F.col("nth") == 1) | (F.length("text") == 0))
    return rows.select("row.*")
