"""Embedding whitening by Chebyshev-filtered subspace iteration.

The covariance of all vectors is never formed. A block of a few more columns than components are asked
for is multiplied by it in passes over the rows: a task adds up ``A'(AQ)`` over its centred rows ``A``,
Spark adds the tasks' sums entry by entry, and the driver holds matrices of dimension x block. Between
two Rayleigh-Ritz steps the block goes through a Chebyshev polynomial in the covariance, by its
three-term recurrence: small on the part of the spectrum below the block, growing fast above it. Then
QR, Rayleigh-Ritz, and the residuals ``|Vq - eq|`` certify the components: they stop the iteration
once they are at rounding, and every eigenvector is within ``residual / gap`` of the true one.
A block that does not converge gets twice the columns, at last one for each dimension, where one
Rayleigh-Ritz step is exact.

Rows count whose vector is not null, has an entry, and holds no null, NaN or infinite entry; of
vectors of different lengths those of the commonest length (the longer one if two are as common).
Repeated rows count as often as they occur, null ids are kept. Components of no variance do not exist:
one row, or equal rows only, give no component, as does an empty table. Components of equal eigenvalue
are some basis of their space. Other columns are not read. Nothing is gathered by value, so a vector in
a third of all rows is as good as any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import finite, floored, matrix

#: Columns of the block beyond the components asked for.
GUARD = 24
#: Degree of the polynomial: passes over the rows between two Rayleigh-Ritz steps.
DEGREE = 8
#: Residuals below this part of the largest eigenvalue are rounding.
ROUNDING = 5e-15
#: Steps with a block before it gets twice the columns.
STEPS = 6
#: Eigenvalues below this part of the largest one are none.
NONE = 1e-13
#: Rows of a product at once.
ROWS = 4096


@dataclass(frozen=True)
class Components:
    """The largest ``values`` of the covariance of ``n`` vectors and, as columns, their ``vectors``;
    ``residuals`` certify them. ``sums`` are the vectors' sums by dimension, exact for integers."""

    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    passes: int

    @property
    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        return _centre(self.sums, self.n)


def _centre(sums: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean as a whole number and the rest, so that a centred integer loses no digits."""
    if sums.dtype.kind == "f":
        return np.zeros(len(sums)), sums / n
    whole = sums // n
    return whole, (sums - whole * n) / n


def _centred(rows: np.ndarray, centre: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    whole, rest = centre
    return (rows - whole).astype(np.float64) - rest


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        rows = matrix(batch.column(0), width)
        for at in range(0, len(rows), ROWS):
            yield rows[at : at + ROWS]


def _sums(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """Count and sums by dimension of the vectors of the commonest length."""
    kind = vectors.schema[0].dataType.elementType
    number = kind.simpleString() if kind.simpleString() == "bigint" else "double"
    own = np.int64 if number == "bigint" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            column = batch.column(0)
            lengths = np.asarray(pa.compute.list_value_length(column))
            for width in np.unique(lengths).tolist():
                rows = matrix(column.filter(pa.array(lengths == width)), width)
                held = found.setdefault(width, [0, np.zeros(width, own)])
                held[0] += len(rows)
                held[1] += rows.astype(own).sum(axis=0)
        for width, (n, sums) in found.items():
            yield pa.RecordBatch.from_pydict(
                {
                    "width": pa.array(np.full(width, width, np.int32)),
                    "dim": pa.array(np.arange(width, dtype=np.int32)),
                    "n": pa.array(np.full(width, n, np.int64)),
                    "total": pa.array(sums),
                }
            )

    parts = vectors.mapInArrow(run, f"width int, dim int, n long, total {number}")
    both = parts.groupBy("width", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    both = stored(both, "vector-sums")
    widest = both.where("dim = 0").orderBy(F.desc("n"), F.desc("width")).first()
    if widest is None:
        return 0, np.zeros(0)
    rows = both.where(F.col("width") == widest.width).collect()  # as many as dimensions
    return widest.n, np.array([r.total for r in sorted(rows, key=lambda r: r.dim)], own)


def _product(vectors: DataFrame, centre, n: int, block: np.ndarray) -> tuple[np.ndarray, float]:
    """Covariance times ``block``, and the covariance's trace, in one pass over the rows."""
    width, k = block.shape
    names = [f"c{j}" for j in range(k + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares, seen = np.zeros((width, k)), np.zeros(width), False
        for rows in _blocks(batches, width):
            a = _centred(rows, centre)
            total += a.T @ (a @ block)
            squares += np.einsum("ij,ij->j", a, a)
            seen = True
        if seen:
            columns = [pa.array(np.arange(width, dtype=np.int32))]
            columns += [pa.array(np.ascontiguousarray(c)) for c in (*total.T, squares)]
            yield pa.RecordBatch.from_arrays(columns, ["dim", *names])

    kinds = "dim int, " + ", ".join(f"{c} double" for c in names)
    added = vectors.mapInArrow(run, kinds).groupBy("dim").agg(*[F.sum(c).alias(c) for c in names])
    out = np.zeros((width, k + 1))
    for row in added.collect():  # as many as dimensions
        out[row[0]] = row[1:]
    return out[:, :k] / n, float(out[:, k].sum()) / n


def counting(df: DataFrame, column: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """``keys`` and ``vector`` of the rows that count, written once: the passes read nothing else and
    test no entry again."""
    vectors = df.where(finite(F.col(column))).select(*keys, F.col(column).alias("vector"))
    return stored(vectors, "vectors")


def principal_components(df: DataFrame, column: str, components: int = 8) -> Components:
    """The ``components`` largest principal components of a column of vectors."""
    return components_of(counting(df, column), components)


def components_of(vectors: DataFrame, components: int = 8) -> Components:
    """The same for the column ``vector`` of rows that all count but for their length."""
    vectors = vectors.select("vector")
    n, sums = _sums(vectors)
    width, passes = len(sums), 1
    none = Components(n, sums, 0.0, np.zeros(0), np.zeros((width, 0)), np.zeros(0), passes)
    if n < 2:
        return none
    vectors, centre = vectors.where(F.size("vector") == width), _centre(sums, n)
    wanted = min(components, width)
    k = min(width, wanted + GUARD)
    pick = np.random.default_rng(0)
    block, last, step = np.linalg.qr(pick.standard_normal((width, k)))[0], np.inf, 0
    while True:
        image, trace = _product(vectors, centre, n, block)
        passes += 1
        small = block.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        off = np.linalg.norm(image - block * values, axis=0)[:wanted]
        if trace <= 0 or values[0] <= 0:
            return none
        worst = float(off.max()) / values[0]
        stuck = worst < 1e-12 and worst > last / 2  # rounding is reached: no step makes it less
        if k == width or worst <= ROUNDING or stuck:
            break
        last, step = worst, step + 1
        if step % STEPS == 0:
            k = min(width, 2 * k)
            more = pick.standard_normal((width, k - block.shape[1]))
            block = np.linalg.qr(np.hstack([block, more]))[0]
            last = np.inf
            continue
        # the damped interval: from 0 to the least value of the block
        half = max(values[-1], NONE * values[0]) / 2
        scale = half / (values[0] - half)
        now, before, grown = (image - half * block) * (scale / half), block, scale
        for _ in range(DEGREE - 1):
            image, _ = _product(vectors, centre, n, now)
            passes += 1
            following = 1 / (2 / scale - grown)
            now, before = (
                2 * following / half * (image - half * now) - grown * following * before,
                now,
            )
            grown = following
        block = np.linalg.qr(now / np.linalg.norm(now, axis=0))[0]
    held = values[:wanted] > NONE * values[0]
    return Components(
        n, sums, trace, values[:wanted][held], block[:, :wanted][:, held], off[held], passes
    )


def _projected(rows: np.ndarray, found: Components) -> np.ndarray:
    return _centred(rows, found.centre) @ found.vectors / np.sqrt(found.values)


def identity_error(vectors: DataFrame, found: Components) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, measured over
    the column ``vector``."""
    k, width = len(found.values), len(found.sums)
    names = [f"c{j}" for j in range(k + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros((k, k)), np.zeros(k)
        for rows in _blocks(batches, width):
            w = _projected(rows, found)
            total += w.T @ w
            sums += w.sum(axis=0)
        columns = [pa.array(np.arange(k, dtype=np.int32))]
        columns += [pa.array(np.ascontiguousarray(c)) for c in (*total, sums)]
        yield pa.RecordBatch.from_arrays(columns, ["i", *names])

    kinds = "i int, " + ", ".join(f"{c} double" for c in names)
    vectors = vectors.where(F.size("vector") == width).select("vector")
    added = vectors.mapInArrow(run, kinds).groupBy("i").agg(*[F.sum(c).alias(c) for c in names])
    out = np.zeros((k, k + 1))
    for row in added.collect():  # as many as components
        out[row[0]] = row[1:]
    mean = out[:, k] / found.n
    return float(np.abs(out[:, :k] / found.n - np.outer(mean, mean) - np.eye(k)).max())


def whitened(df: DataFrame, column: str, found: Components, keys: list[str]) -> DataFrame:
    """``keys`` of each counting row with its whitened vector, as the list ``whitened``."""
    width = len(found.sums)
    rows = df.where(finite(F.col(column)) & (F.size(column) == width)).select(*keys, column)
    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = _projected(matrix(batch.column(len(keys)), width), found)
            ends = np.arange(0, w.size + 1, max(w.shape[1], 1), dtype=np.int32)
            ends = ends if w.shape[1] else np.zeros(len(w) + 1, np.int32)
            lists = pa.ListArray.from_arrays(ends[: len(w) + 1], pa.array(w.ravel()))
            own = [batch.column(i) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*own, lists], [*keys, "whitened"])

    return rows.mapInArrow(run, f"{kinds}whitened array<double>")


def whitening_digest(embeddings: DataFrame, components: int = 8) -> DataFrame:
    """A row for each counting vector and component, numbered from 1 by falling eigenvalue.

    ``deviation`` is the exact sum over dimensions of ``(n*x - S)^2``; null where a long cannot
    hold it. ``explained`` is the eigenvalue's part of the trace, ``residual`` its certificate.
    """
    x = floored(F.col("embedding"), 1024, 100_000)
    rows = embeddings.where(finite(F.col("embedding"))).select("vec_id", x.alias("x"))
    rows = counting(rows, "x", ["vec_id"])
    found = components_of(rows, components)
    error = identity_error(rows, found) if len(found.values) else None
    width, n, sums = len(found.sums), found.n, found.sums
    values = [
        (i + 1, float(e / found.trace), float(r))
        for i, (e, r) in enumerate(zip(found.values, found.residuals))
    ]
    kinds = "vec_id long, component int, n long, deviation long, whitened double, explained double, "
    kinds += "identity_error double, residual double"

    def exact(block: np.ndarray) -> list[int | None]:
        """Products and squares may leave 64 bits: those rows are added up as Python's integers."""
        off = block.astype(np.float64) * n - sums
        size = np.einsum("ij,ij->i", off, off)
        with np.errstate(over="ignore"):
            off = block * np.int64(n) - sums
            plain = np.einsum("ij,ij->i", off, off).tolist()
        for i in np.flatnonzero(size > 2.0**62).tolist():
            whole = sum((n * int(v) - int(s)) ** 2 for v, s in zip(block[i], sums))
            plain[i] = whole if whole < 1 << 63 else None
        return plain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for batch in batches:
            block = matrix(batch.column(1), width)
            w, count = _projected(block, found), len(block)
            each = np.repeat(np.arange(count), k)
            part = [pa.array(np.tile([v[j] for v in values], count)) for j in range(3)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)),
                    part[0].cast(pa.int32()),
                    pa.array(np.full(count * k, n, np.int64)),
                    pa.array(exact(block), pa.int64()).take(pa.array(each)),
                    pa.array(w.ravel()),
                    part[1],
                    pa.array(np.full(count * k, error)),
                    part[2],
                ],
                [c.split(" ")[0] for c in kinds.split(", ")],
            )

    kept = rows.where(F.size("vector") == width) if values else rows.limit(0)
    return kept.mapInArrow(run, kinds)
