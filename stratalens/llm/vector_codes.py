"""Product codes of vectors, with distances from dictionaries of the values of each dimension.

Vectors become integers and are cut into consecutive parts; each part has a codebook that a fixed number
of Lloyd steps improves, in whole numbers throughout. Rows are written once as blocks: for every
dimension the sorted distinct integers of the block and a 16-bit code for each row. A step tabulates,
for a dimension, the squared differences of every distinct integer to all entries; the distance of a
row's part to the entries is then the sum of the rows of the tables that its codes name, gathers and
adds. The new entries come from a count of codes by entry, times the dictionary. So the arithmetic on
values is done once a distinct value, whatever the number of rows, and a vector that fills a third of
the table costs what any other does. A dictionary holds a block's values, not the table's, so that its
size is bounded by the block for any data.

A step sends the tasks the codebooks and gets sums and counts by (entry, dimension), added up by Spark.

Rows count whose vector is not null, has an entry, and holds no null, NaN or infinite entry; of vectors
of different lengths those of the commonest length (the longer one if two are as common). A length
that 8 does not divide gives the first parts one entry more; a part without entries has code 0. Fewer
rows than entries give fewer entries; equal ids among the smallest are ordered by their vectors, null
ids are the largest. Products beyond what exact 64-bit errors allow (``2^30 / sqrt(length)``) count as that
limit. A ``label_error`` beyond 64 bits is null. Repeated rows are rows, an empty table gives no rows,
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .common import stored
from .vectors import finite, floored, matrix

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Entries of a block's matrix.
BLOCK = 1 << 21
#: Shares that the rows of a label are dealt to where its total meets them by shuffle.
SALTS = 16


def _bounds(width: int) -> list[int]:
    sizes = [width // PARTS + (p < width % PARTS) for p in range(PARTS)]
    return np.concatenate(([0], np.cumsum(sizes))).tolist()


def blocks(rows: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """A row a block: ``width`` and ``n``, the dictionaries' ``sizes`` and ``entries``, the ``codes``, and the
    columns ``keep`` of the block's rows as lists."""
    kinds = [rows.schema[c].dataType.simpleString() for c in keep]
    schema = "width int, n int, sizes array<int>, entries binary, codes binary"
    schema += "".join(f", k{i} array<{kind}>" for i, kind in enumerate(kinds))

    def block(values: np.ndarray, kept: list[pa.Array]) -> pa.RecordBatch:
        n, width = values.shape
        tables, codes = [], np.empty((width, n), np.uint16)
        for j in range(width):
            distinct, at = np.unique(values[:, j], return_inverse=True)
            tables.append(distinct)
            codes[j] = at
        sizes = pa.array([[len(t) for t in tables]], pa.list_(pa.int32()))
        lists = [pa.ListArray.from_arrays([0, n], c) for c in kept]
        entries = pa.array([np.concatenate(tables).astype(np.int64).tobytes()])
        first = [pa.array([width], pa.int32()), pa.array([n], pa.int32()), sizes, entries]
        names = ["width", "n", "sizes", "entries", "codes", *[f"k{i}" for i in range(len(kept))]]
        return pa.RecordBatch.from_arrays([*first, pa.array([codes.tobytes()]), *lists], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}

        def cut(width: int, least: int) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held.pop(width)).combine_chunks()
            most = min(1 << 16, max(1, BLOCK // width))
            while whole.num_rows >= least and whole.num_rows:
                part = whole.slice(0, most).combine_chunks().to_batches()[0]
                yield block(matrix(part.column(0), width), part.columns[1:])
                whole = whole.slice(most)
            if whole.num_rows:
                held[width] = whole.to_batches()

        for batch in batches:
            lengths = np.asarray(pa.compute.list_value_length(batch.column(0)))
            for width in np.unique(lengths).tolist():
                held.setdefault(width, []).append(batch.filter(pa.array(lengths == width)))
                most = min(1 << 16, max(1, BLOCK // width))
                if sum(b.num_rows for b in held[width]) >= most:
                    yield from cut(width, most)
        for width in list(held):
            yield from cut(width, 0)

    return rows.select(column, *keep).mapInArrow(run, schema)


def _unpacked(row: dict) -> tuple[list[np.ndarray], np.ndarray]:
    """A block's dictionaries, and its codes as (dimension, row)."""
    sizes = row["sizes"]
    flat = np.frombuffer(row["entries"], np.int64)
    codes = np.frombuffer(row["codes"], np.uint16).reshape(row["width"], row["n"])
    return np.split(flat, np.cumsum(sizes)[:-1]), codes


def _nearest(tables, codes, book: np.ndarray, first: int, end: int):
    """For a part of dimensions ``first`` to ``end``: each row's nearest entry and its distance."""
    total = np.zeros((codes.shape[1], len(book)), np.int64)
    for j in range(first, end):
        squares = (tables[j][:, None] - book[:, j]) ** 2
        total += squares[codes[j]]
    nearest = total.argmin(axis=1)  # ties: the lower index
    return nearest, total[np.arange(len(nearest)), nearest]


def _rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    names = ["width", "n", "sizes", "entries", "codes"]
    for i in range(batch.num_rows):
        yield {c: batch.column(batch.schema.get_field_index(c))[i].as_py() for c in names}


def improved(coded: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebooks after one Lloyd step: floored means of the parts nearest to an entry. ``book``
    has a row an entry and a column a dimension; an entry's part is its columns of that part."""
    entries, width = book.shape
    bounds = _bounds(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((entries, width), np.int64), np.zeros((entries, width), np.int64)
        for batch in batches:
            for row in _rows_of(batch):
                tables, codes = _unpacked(row)
                for first, end in zip(bounds, bounds[1:]):
                    nearest, _ = _nearest(tables, codes, book, first, end)
                    for j in range(first, end):
                        size = len(tables[j])
                        met = np.bincount(nearest * size + codes[j], minlength=entries * size)
                        met = met.reshape(entries, size)
                        sums[:, j] += met @ tables[j]
                        counts[:, j] += met.sum(axis=1)
        entry, dim = np.divmod(np.flatnonzero(counts), width)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(entry.astype(np.int32)),
                pa.array(dim.astype(np.int32)),
                pa.array(sums[entry, dim]),
                pa.array(counts[entry, dim]),
            ],
            ["entry", "dim", "total", "n"],
        )

    parts = coded.mapInArrow(run, "entry int, dim int, total long, n long")
    total = F.sum(F.col("total").cast("decimal(38,0)"))
    new = book.copy()
    # at most entries x dimensions rows
    for r in parts.groupBy("entry", "dim").agg(total, F.sum("n")).collect():
        new[r[0], r[1]] = int(r[2]) // r[3]
    return new


def codebooks(rows: DataFrame, coded: DataFrame, column: str, key: str, width: int) -> np.ndarray:
    """The final codebooks, from the vectors of the smallest ids."""
    first = rows.where(F.size(column) == width).orderBy(F.asc_nulls_last(key), column)
    book = np.array([r[0] for r in first.select(column).limit(ENTRIES).collect()], np.int64)
    for _ in range(ROUNDS):
        book = improved(coded, book)
    return book


def encoded(coded: DataFrame, book: np.ndarray, keep: list, names: list[str]) -> DataFrame:
    """The kept columns of every row with ``code``, two hex digits a part, and ``error``."""
    bounds = _bounds(book.shape[1])
    digits = np.array([f"{e:02x}" for e in range(len(book))], dtype="S2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(_rows_of(batch)):
                tables, codes = _unpacked(row)
                found = [_nearest(tables, codes, book, a, b) for a, b in zip(bounds, bounds[1:])]
                text = np.stack([digits[nearest] for nearest, _ in found], axis=1)
                text = text.view(f"S{2 * PARTS}").ravel().astype("U")
                error = sum(off for _, off in found)
                kept = [
                    batch.column(batch.schema.get_field_index(f"k{c}"))[i].values
                    for c in range(len(keep))
                ]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(text), pa.array(error)], [*names, "code", "error"]
                )

    kinds = ", ".join(f"`{n}` {kind}" for n, kind in zip(names, keep))
    return coded.mapInArrow(run, f"{kinds}, code string, error long")


def with_total(rows: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over rows of equal ``by``, nulls together; null beyond a
    long. Rows of a frequent key are dealt to several shares, as are the totals."""
    totals = rows.groupBy(F.col(by).alias("_by")).agg(F.try_sum(value).alias(name))
    shares = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    totals = broadcast_if_small(totals.withColumn("_share", shares))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    same = F.col(by).eqNullSafe(F.col("_by")) & (F.col("_salt") == F.col("_share"))
    return dealt.join(totals, same, "left").select(*rows.columns, name)


def product_codes(embeddings: DataFrame) -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error`` and the hash of the codebooks, a row a vector."""
    vector = F.col("embedding")
    limit = F.floor(F.lit(2.0**30) / F.sqrt(F.size(vector)))
    whole = F.transform(
        floored(vector, SCALE), lambda x: F.least(F.greatest(x, -limit), limit).cast("long")
    )
    rows = embeddings.where(finite(vector)).select("vec_id", "label", whole.alias("x"))
    keep = ["vec_id", "label"]
    kinds = [rows.schema[c].dataType.simpleString() for c in keep]
    coded = stored(blocks(rows, "x", keep), "vector-blocks")
    widest = coded.groupBy("width").agg(F.sum("n").alias("n"))
    widest = widest.orderBy(F.desc("n"), F.desc("width")).first()
    width = 1 if widest is None else widest.width
    coded = coded.where(F.col("width") == width)
    book = codebooks(rows, coded, "x", "vec_id", width) if widest else np.zeros((1, 1), np.int64)
    parts = zip(_bounds(width), _bounds(width)[1:])
    listed = ",".join(str(v) for a, b in parts for entry in book for v in entry[a:b])
    digest = hashlib.sha256(listed.encode()).hexdigest()
    found = stored(encoded(coded, book, kinds, keep), "vector-codes")
    found = with_total(found, "label", "error", "label_error")
    return found.withColumn("codebooks_sha256", F.lit(digest))
