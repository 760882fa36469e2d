"""Means and scatter matrices of embeddings, per arm, in one pass.

Each task folds its rows into ``(n, mean, scatter)`` per arm, and the sum of their unit vectors, and
emits that, cut into blocks of matrix rows. Partials merge without loss of precision (Chan, Golub
and LeVeque), those of neighbouring tasks first, so that a hot arm's partials are spread over many
tasks too. Vectors themselves are not shuffled unless arms lie interleaved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import EPS
from ..session import broadcast_if_small, durable

BLOCK_ROWS = 64  # scatter rows per emitted block
HELD_BYTES = 128 << 20  # scatter matrices a task folds at a time before it emits the oldest
HELD_SUMS = 1024  # groups a task adds up at a time
MERGED_TASKS = 32  # neighbouring tasks whose partials are merged first
GATHERED_ROWS = 100_000  # rows of an arm per task where they have to be moved

Partial = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def to_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as an n x d float64 matrix, without going through Python objects."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def to_lists(matrix: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    n, width = matrix.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel()))


def groups(batch: pa.RecordBatch, keys: Sequence[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """Row numbers of each distinct key tuple of a batch."""
    if not keys:
        yield (), np.arange(batch.num_rows)
        return
    table = pa.Table.from_batches([batch.select(list(keys))])
    table = table.append_column("_row", pa.array(np.arange(batch.num_rows)))
    grouped = table.group_by(list(keys)).aggregate([("_row", "list")])
    for row in grouped.to_pylist():
        yield tuple(row[k] for k in keys), np.asarray(row["_row_list"])


def matrices(
    batch: pa.RecordBatch, keys: Sequence[str], vector: str
) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """Row numbers and matrix of each key of a batch; arms may differ in width."""
    column = batch.column(vector)
    if batch.num_rows == 0:
        return
    widths = pc.min_max(pc.list_value_length(column)).as_py()
    whole = to_matrix(column) if widths["min"] == widths["max"] else None
    for key, rows in groups(batch, keys):
        yield key, rows, to_matrix(column.take(pa.array(rows))) if whole is None else whole[rows]


def unit_sums(x: np.ndarray) -> np.ndarray:
    """Sum of the rows scaled to length one, and as a last element that of their squares."""
    unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + EPS)
    return np.append(unit.sum(axis=0), (unit**2).sum())


def unit_only(x: np.ndarray) -> np.ndarray:
    """Sum of the rows scaled to length one."""
    return (x / (np.linalg.norm(x, axis=1, keepdims=True) + EPS)).sum(axis=0)


def plain_sums(x: np.ndarray) -> np.ndarray:
    return x.sum(axis=0)


def _fold(x: np.ndarray) -> Partial:
    mean = x.mean(axis=0)
    centred = x - mean
    return len(x), mean, centred.T @ centred, unit_sums(x)


def merge(left: Partial, right: Partial, rows: slice = slice(None)) -> Partial:
    """Moments of two sets together; ``rows`` are the scatter rows held."""
    n = left[0] + right[0]
    delta = right[1] - left[1]
    scatter = left[2] + right[2]
    scatter = scatter + np.outer(delta[rows], delta) * (left[0] * right[0] / n)
    return n, left[1] + delta * (right[0] / n), scatter, left[3] + right[3]


def key_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def arrow_keys(fields: Sequence[T.StructField], rows: Sequence[tuple]) -> list[pa.Array]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [
        pa.array([row[i] for row in rows], type=to_arrow_type(field.dataType))
        for i, field in enumerate(fields)
    ]


def _emit(fields, keys: tuple, partial: Partial) -> Iterator[pa.RecordBatch]:
    n, mean, scatter, unit = partial
    names = [f.name for f in fields] + ["n", "block", "mean", "scatter", "unit"]
    for block, start in enumerate(range(0, len(mean), BLOCK_ROWS)):
        rows = scatter[start : start + BLOCK_ROWS].reshape(1, -1)
        columns = arrow_keys(fields, [keys]) + [
            pa.array([n]),
            pa.array([block], pa.int32()),
            to_lists(mean.reshape(1, -1)),
            to_lists(rows),
            to_lists(unit.reshape(1, -1)),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _folder(fields, vector: str) -> Callable:
    keys = [f.name for f in fields]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Partial] = {}
        for batch in batches:
            for key, _, x in matrices(batch, keys, vector):
                partial = _fold(x)
                known = held.pop(key, None)
                held[key] = partial if known is None else merge(known, partial)
            while len(held) > 1 and sum(p[2].nbytes for p in held.values()) > HELD_BYTES:
                oldest = next(iter(held))
                yield from _emit(fields, oldest, held.pop(oldest))
        for key, partial in held.items():
            yield from _emit(fields, key, partial)

    return fold


def _merge_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the partials of one arm and block, a batch at a time."""
    merged, last = None, None
    for batch in batches:
        counts = batch.column("n").to_pylist()
        means = to_matrix(batch.column("mean"))
        blocks = to_matrix(batch.column("scatter"))
        units = to_matrix(batch.column("unit"))
        start = batch.column("block")[0].as_py() * BLOCK_ROWS
        rows = slice(start, start + BLOCK_ROWS)
        for n, mean, block, unit in zip(counts, means, blocks, units):
            partial = (n, mean, block.reshape(-1, len(mean)), unit)
            merged = partial if merged is None else merge(merged, partial, rows)
        last = batch
    if last is not None:
        row = last.slice(0, 1)
        for name, value in (
            ("n", pa.array([merged[0]])),
            ("mean", to_lists(merged[1].reshape(1, -1))),
            ("scatter", to_lists(merged[2].reshape(1, -1))),
            ("unit", to_lists(merged[3].reshape(1, -1))),
        ):
            row = row.set_column(row.schema.get_field_index(name), name, value)
        yield row


def gathered(df: DataFrame, keys: Sequence[str], vector: str = "embedding") -> DataFrame:
    """``df`` laid out so that a task sees many rows of few arms.

    Embeddings cached by arm are so already and stay where they are; this is found out from the key
    columns alone, for each arm. Where tasks see fewer rows of an arm than half the vector's width, a
    partial scatter matrix would be larger than the rows it stands for: that arm's rows then move
    once, large arms to several tasks, dealt by a hash of the vector and of the task that read it: no
    task holds many rows of such an arm, so copies of one vector are spread too.
    """
    part = F.spark_partition_id().alias("_part")
    own = df.where(F.col(vector).isNotNull())
    seen = own.groupBy(part, *keys).agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("d"))
    sizes = seen.groupBy(*keys).agg(
        (F.avg("n") < F.max("d") / 2).alias("_thin"),
        F.ceil(F.sum("n") / GATHERED_ROWS).cast("int").alias("_m"),
        F.count(F.lit(1)).alias("_tasks"),
    )
    thin = durable(sizes.where("_thin AND _tasks > _m").drop("_thin", "_tasks"))
    if thin.isEmpty():
        return df
    marked = own.join(broadcast_if_small(thin), list(keys), "left")
    salt = F.pmod(F.xxhash64(vector, F.spark_partition_id()), F.col("_m"))
    moved = marked.where("_m IS NOT NULL").withColumn("_s", salt).repartition(*keys, "_s")
    stay = marked.where("_m IS NULL")
    return stay.drop("_m").unionByName(moved.drop("_m", "_s"))


def moments(df: DataFrame, keys: Sequence[str], vector: str = "embedding") -> DataFrame:
    """``(keys…, n, block, mean, scatter, unit)``: ``scatter`` holds rows ``block * 64`` onwards of
    the arm's centred scatter matrix, ``unit`` the sum of its unit vectors and of their squares."""
    fields = key_fields(df, keys)
    tail = "n long, block int, mean array<double>, scatter array<double>, unit array<double>"
    schema = T.StructType(fields + T.StructType.fromDDL(tail).fields)
    partials = (
        gathered(df, keys, vector)
        .where(F.col(vector).isNotNull())
        .select(*keys, F.col(vector))
        .mapInArrow(_folder(fields, vector), schema)
        .withColumn("salt", F.floor(F.spark_partition_id() / MERGED_TASKS).cast("int"))
    )
    salted = T.StructType(schema.fields + [T.StructField("salt", T.IntegerType())])
    first = partials.groupBy(*keys, "block", "salt").applyInArrow(_merge_blocks, salted)
    return first.drop("salt").groupBy(*keys, "block").applyInArrow(_merge_blocks, schema)


def vector_sums(
    df: DataFrame,
    keys: Sequence[str],
    vector: str = "embedding",
    sums: Callable[[np.ndarray], np.ndarray] = plain_sums,
) -> DataFrame:
    """``(keys…, n, total)``: element-wise sum of the vectors of each group, folded in each task
    before the shuffle and merged by position after it. The row count travels as a last element.
    ``sums`` takes a matrix to what is added up."""
    fields = key_fields(df, keys)
    schema = T.StructType(fields + [T.StructField("total", T.ArrayType(T.DoubleType()))])
    names = [*keys, "total"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for key, total in held.items():
                columns = [*arrow_keys(fields, [key]), to_lists(total.reshape(1, -1))]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            held.clear()

        for batch in batches:
            for key, rows, x in matrices(batch, keys, vector):
                held[key] = held.get(key, 0.0) + np.append(sums(x), len(rows))
            if len(held) > HELD_SUMS:
                yield from out()
        yield from out()

    partial = df.where(F.col(vector).isNotNull()).select(*keys, vector).mapInArrow(fold, schema)
    entries = partial.select(*keys, F.posexplode("total").alias("i", "x"))
    summed = entries.groupBy(*keys, "i").agg(F.sum("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    whole = summed.groupBy(*keys).agg(ordered.alias("_e"))
    values = whole.select(*keys, F.transform("_e", lambda e: e["x"]).alias("_e"))
    return values.select(
        *keys,
        F.element_at("_e", -1).cast("long").alias("n"),
        F.slice("_e", 1, F.size("_e") - 1).alias("total"),
    )
