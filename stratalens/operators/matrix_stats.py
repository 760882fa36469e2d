"""Label-free statistics of embedding matrices, one row per arm."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CONTEXT_METRICS, EPS, HISTOGRAM_BINS, METRICS
from ..functions import vectors as V
from ..session import broadcast_if_small, durable
from .moments import (
    BLOCK_ROWS,
    key_fields,
    moments,
    to_lists,
    to_matrix,
    unit_only,
    unit_sums,
    vector_sums,
)
from .neighbors import curvature
from .sampling import sample_rows

PAIR_ROWS = 1000  # rows of a block whose pairs are looked at together
PAIR_PARTS = 5  # parts of a lone arm of more rows, any two of which meet in one group; of many arms each has fewer
PART_BYTES = 64 << 20  # of such a part; arms that outgrow them have more parts
NOT_FINITE = "a vector is not finite"
_SPECTRAL = ["effective_rank", "logdet_covariance", "anisotropy", "spectral_norm", "condition_number"]


def _spectrum(n: int, scatter: np.ndarray) -> tuple[dict[str, float | None], np.ndarray]:
    """Statistics of a scatter matrix and the axis of greatest variance."""
    d = len(scatter)
    values, axes = np.linalg.eigh((scatter + scatter.T) / 2)
    values = np.clip(values[::-1], 0.0, None)
    singular = np.sqrt(values[: max(min(n - 1, d), 0)])
    share = singular / (singular.sum() + EPS)
    share = share[share > EPS]
    stats: dict[str, float | None] = dict.fromkeys(_SPECTRAL)
    stats["effective_rank"] = (
        float(np.exp(-np.sum(share * np.log(share + EPS)))) if n > 1 and len(share) else 1.0
    )
    if n > 1:
        cov = values / (n - 1)
        # beyond the rank of n centred rows there is rounding noise only
        kept = cov[: min(n - 1, d)]
        kept = kept[kept > EPS]
        stats["logdet_covariance"] = float(np.log(cov + EPS).sum())
        stats["anisotropy"] = float(cov.std() / (cov.mean() + EPS))
        stats["spectral_norm"] = float(cov[0])
        stats["condition_number"] = (
            float(kept.max() / (kept.min() + EPS)) if n > 2 and len(kept) > 1 else 0.0
        )
    return stats, axes[:, -1]


def _solver(fields: Sequence[T.StructField]):
    names = [f.name for f in fields]

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        mean = to_matrix(table.column("mean").slice(0, 1))
        d = mean.shape[1]
        flat = table.column("scatter").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        n = table.column("n")[0].as_py()
        unit = to_matrix(table.column("unit").slice(0, 1))[0]
        finite = bool(np.isfinite(flat).all() and np.isfinite(mean).all())
        stats, axis = _spectrum(n, flat.reshape(d, d)) if finite else (dict.fromkeys(_SPECTRAL), None)
        keys = [table.column(name).slice(0, 1) for name in names]
        columns = [*keys, pa.array([n]), *[pa.array([stats[s]], pa.float64()) for s in _SPECTRAL]]
        pairs = n * (n - 1)
        cosine = (unit[:-1] @ unit[:-1] - unit[-1]) / pairs if finite and pairs else None
        columns.append(pa.array([cosine], pa.float64()))
        if finite:
            columns += [to_lists(mean), to_lists(axis.reshape(1, -1))]
        else:
            columns += [pa.nulls(1, pa.list_(pa.float64()))] * 2
        columns.append(pa.array([None if finite else NOT_FINITE], pa.string()))
        out = [*names, "n", *_SPECTRAL, "mean_pairwise_cosine", "mean", "axis", "reason"]
        return pa.Table.from_arrays(columns, names=out)

    return solve


def spectra(df: DataFrame, keys: Sequence[str], vector: str = "embedding") -> DataFrame:
    """Per arm its row count, spectral statistics, mean pairwise cosine, mean and first principal
    axis, from one pass over the rows. An arm with a vector that is not finite has a ``reason``
    instead.

    Only the d x d scatter matrix of an arm meets in one task; d is the embedding width.
    """
    fields = key_fields(df, keys)
    tail = ", ".join(f"{name} double" for name in _SPECTRAL)
    ddl = f"n long, {tail}, mean_pairwise_cosine double, mean array<double>, axis array<double>, reason string"
    schema = T.StructType(fields + T.StructType.fromDDL(ddl).fields)
    return moments(df, keys, vector).groupBy(*keys).applyInArrow(_solver(fields), schema)


def spectral_statistic(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return spectra(df, keys).select(*keys, name)


def covariance_summary(df: DataFrame, keys: Sequence[str], vector: str = "embedding") -> DataFrame:
    """Width, trace and squared Frobenius norm of the covariance, without an eigensolve."""
    d = F.size("mean")
    rows = F.sequence(F.lit(0), (F.size("scatter") / d - 1).cast("int"))
    diagonal = F.transform(
        rows,
        lambda i: F.get("scatter", (i * d + F.col("block") * BLOCK_ROWS + i).cast("int")),
    )
    squares = F.aggregate("scatter", F.lit(0.0), lambda acc, x: acc + x * x)
    parts = moments(df, keys, vector).select(
        *keys, "n", d.alias("d"), V.total(diagonal).alias("t"), squares.alias("s")
    )
    dof = F.col("n") - 1
    return parts.groupBy(*keys, "n", "d").agg(F.sum("t").alias("t"), F.sum("s").alias("s")).select(
        *keys,
        "n",
        "d",
        F.try_divide("t", dof).alias("trace"),
        F.try_divide("s", dof * dof).alias("fro2"),
    )


def effective_rank_fro(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``trace^2 / |C|_F^2``; 1 for a vanishing trace."""
    trace = F.col("trace")
    value = F.when(F.coalesce(trace, F.lit(0.0)) < EPS, 1.0).otherwise(
        trace * trace / (F.col("fro2") + EPS)
    )
    return covariance_summary(df, keys).select(*keys, value.alias("effective_rank_fro"))


def anisotropy(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Standard deviation over mean of the covariance eigenvalues, from trace and norm alone."""
    mean = F.col("trace") / F.col("d")
    variance = F.greatest(F.col("fro2") / F.col("d") - mean * mean, F.lit(0.0))
    value = F.sqrt(variance) / (mean + EPS)
    return covariance_summary(df, keys).select(*keys, value.alias("anisotropy"))


def _entropy(counts: Column, n: Column, bins: int) -> Column:
    """Entropy of a histogram of which only the filled bins' counts are given, smoothed."""
    total = n + bins * EPS

    def term(share: Column) -> Column:
        return -share * F.log(share)

    filled = F.sum(term((counts + EPS) / total))
    return filled + (bins - F.count(F.lit(1))) * term(F.lit(EPS) / F.first(total))


def histogram_entropy(
    df: DataFrame, keys: Sequence[str], value: str, name: str, bins: int = HISTOGRAM_BINS
) -> DataFrame:
    """Entropy of the equal-width histogram of ``value`` over its range, per arm; 0 below two rows.
    NULLs are no rows; an arm with a value that is not finite has no entropy.

    Rows are counted per bin before the shuffle, so an arm of any size costs one row per bin and
    task.
    """
    values = durable(df.where(F.col(value).isNotNull()).select(*keys, value))
    odd = F.isnan(value) | (F.abs(value) == float("inf"))
    ranges = values.groupBy(*keys).agg(
        F.min(value).alias("_lo"),
        F.max(value).alias("_hi"),
        F.count(value).alias("_n"),
        F.some(odd).alias("_odd"),
    )
    placed = values.join(broadcast_if_small(ranges), list(keys))
    flat = F.col("_hi") == F.col("_lo")
    low = F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo"))
    width = F.when(flat, 1.0).otherwise(F.col("_hi") - F.col("_lo"))
    cell = F.least(F.floor((F.col(value) - low) / width * bins), F.lit(bins - 1))
    counts = placed.groupBy(*keys, "_n", "_odd", cell.alias("_bin"))
    counts = counts.agg(F.count(F.lit(1)).alias("_c"))
    entropy = _entropy(F.col("_c"), F.col("_n"), bins)
    found = counts.groupBy(*keys, "_n", "_odd").agg(entropy.alias("_e"))
    known = F.when(F.col("_n") < 2, 0.0).otherwise(F.col("_e"))
    return found.select(*keys, F.when(~F.col("_odd"), known).alias(name))


def _project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last three columns are vector, mean and axis; rows of one batch may differ in width."""
    for batch in batches:
        *keys, x, _, _ = batch.columns
        score = np.empty(batch.num_rows)
        widths = np.asarray(pa.compute.list_value_length(x))
        for width in np.unique(widths):
            rows = np.flatnonzero(widths == width)
            own = [to_matrix(c.take(pa.array(rows))) for c in batch.columns[-3:]]
            score[rows] = ((own[0] - own[1]) * own[2]).sum(axis=1)
        names = [*batch.schema.names[: len(keys)], "axis_score"]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(score)], names=names)


def axis_scores(
    df: DataFrame, arms: DataFrame, keys: Sequence[str], vector: str = "embedding"
) -> DataFrame:
    """Coordinate of every row on its arm's first principal axis. ``arms`` are written spectra; arms
    without an axis have no scores."""
    rows = df.where(F.col(vector).isNotNull()).select(*keys, vector)
    axes = arms.where("axis IS NOT NULL").select(*keys, "mean", "axis")
    joined = rows.join(broadcast_if_small(axes), list(keys)).select(*keys, vector, "mean", "axis")
    schema = key_fields(df, keys) + [T.StructField("axis_score", T.DoubleType())]
    return joined.mapInArrow(_project, T.StructType(schema))


def prompt_entropy(
    df: DataFrame, keys: Sequence[str], vector: str = "embedding", arms: DataFrame | None = None
) -> DataFrame:
    """Histogram entropy of the scores on the first principal axis."""
    arms = durable(spectra(df, keys, vector)) if arms is None else arms
    scores = axis_scores(df, arms, keys, vector)
    return histogram_entropy(scores, keys, "axis_score", "prompt_entropy")


def norm_entropy(df: DataFrame, keys: Sequence[str], vector: str = "embedding") -> DataFrame:
    """Histogram entropy of the row norms."""
    norms = df.select(*keys, V.norm(V.as_double(F.col(vector))).alias("norm"))
    return histogram_entropy(norms, keys, "norm", "norm_entropy")


def _centre_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last two columns are a vector and the mean unit vector of its arm. Of the vector's unit
    vector ``u``, the difference to the mean and ``1 - |u|^2`` are kept, both without cancellation."""
    for batch in batches:
        *keys, x, mean = batch.columns
        off, short = [None] * batch.num_rows, np.empty(batch.num_rows)
        widths = np.asarray(pa.compute.list_value_length(x))
        for width in np.unique(widths):
            rows = np.flatnonzero(widths == width)
            vectors, centre = (to_matrix(c.take(pa.array(rows))) for c in (x, mean))
            size = np.linalg.norm(vectors, axis=1, keepdims=True)
            lacking = EPS / (size + EPS)
            for i, own in zip(rows, vectors / (size + EPS) - centre):
                off[i] = own
            short[rows] = (lacking * (2 - lacking))[:, 0]
        names = [*batch.schema.names[: len(keys)], "_u", "_short"]
        yield pa.RecordBatch.from_arrays(
            [*keys, pa.array(off, pa.list_(pa.float64())), pa.array(short)], names=names
        )


def _centred_units(df: DataFrame, keys: Sequence[str], vector: str, row: str) -> DataFrame:
    """``(keys…, row, _u, _short)``: each row's unit vector without the mean of its arm's."""
    sums = vector_sums(df, keys, vector, unit_only)
    mean = F.transform("total", lambda x: x / F.col("n"))
    rows = df.join(broadcast_if_small(sums.select(*keys, mean.alias("_mean"))), list(keys))
    fields = key_fields(df, [*keys, row])
    schema = T.StructType(fields + T.StructType.fromDDL("_u array<double>, _short double").fields)
    return rows.select(*keys, row, vector, "_mean").mapInArrow(_centre_units, schema)


def _pair_distances(table: pa.Table) -> Iterator[np.ndarray]:
    """Cosine distances of a group: within its part, or between its two parts, a pair of blocks at a time.

    ``1 - u.v`` is half of ``|u - v|^2`` and of what ``|u|^2`` and ``|v|^2`` lack to 1. Taken from
    vectors without their mean, it keeps its digits where all vectors point the same way.
    """
    table = table.sort_by([("_own", "ascending"), ("_row", "ascending")])
    unit = to_matrix(table.column("_u"))
    half = (np.einsum("ij,ij->i", unit, unit) + table.column("_short").to_numpy()) / 2
    own = table.column("_own").to_numpy()
    second = int((own == own[0]).sum())
    within = table.column("_a")[0] == table.column("_b")[0]
    for i in range(0, second, PAIR_ROWS):
        left = slice(i, min(i + PAIR_ROWS, second))
        if within:
            distance = half[left][:, None] + half[left] - unit[left] @ unit[left].T
            yield distance[np.triu_indices(len(distance), k=1)]
        for j in range(left.stop if within else second, len(unit), PAIR_ROWS):
            right = slice(j, j + PAIR_ROWS)
            yield (half[left][:, None] + half[right] - unit[left] @ unit[right].T).ravel()


def _pair_blocks(df: DataFrame, keys: Sequence[str], row: str) -> DataFrame:
    """Each row once for every pair of parts of its arm that its own part is in. Arms of more than
    ``PAIR_ROWS`` rows have ``PAIR_PARTS`` parts, fewer where other such arms keep the tasks busy too, so that
    the copies of a row do not grow with its arm until a part outgrows ``PART_BYTES``."""
    n, large = F.col("_n"), F.col("_n") > PAIR_ROWS
    sizes = durable(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(F.size("_u")).alias("_d")))
    every = sizes.agg(F.sum(F.when(large, n)).alias("_all"))
    least = F.when(large, F.ceil(PAIR_PARTS * F.sqrt(n / F.col("_all")))).otherwise(1)
    parts = F.greatest(F.ceil(n * (8 * F.col("_d") + 40) / PART_BYTES), least).cast("int").alias("_m")
    parts = sizes.crossJoin(F.broadcast(every)).select(*keys, parts)
    rows = df.join(broadcast_if_small(parts), list(keys))
    own = F.pmod(F.xxhash64(row), F.col("_m")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("_m") - 1))
    rows = rows.withColumn("_own", own).withColumn("_other", others)
    return rows.select(
        *keys,
        F.col(row).alias("_row"),
        "_u",
        "_short",
        "_own",
        F.least("_own", "_other").alias("_a"),
        F.greatest("_own", "_other").alias("_b"),
    )


def dataset_entropy(
    df: DataFrame,
    keys: Sequence[str],
    n: int | None,
    vector: str = "embedding",
    seed: int = 0,
    row: str = "row_id",
) -> DataFrame:
    """Histogram entropy of the cosine distances of all pairs of an arm's rows, or with ``n`` of
    the pairs of that many sampled rows; with the rows there are and those used.

    Rows are laid out in a few parts and every pair of parts is one group, which yields 50 counts; pairs
    themselves are not written, nor held but for a pair of blocks. Groups are gone through twice, for their
    arm's range and to be counted, but both times read from one shuffle. Rows without a vector are no rows.
    An arm with a vector that is not finite has no entropy.
    """
    fields = key_fields(df, keys)
    own = df.where(F.col(vector).isNotNull()).select(*keys, row, vector)
    counts = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    if n is not None:
        counts = counts.withColumn("n_used", F.least("n_rows", F.lit(n)).cast("long"))
        own = durable(sample_rows(own, keys, n, seed, row))
    else:
        counts = counts.withColumn("n_used", F.col("n_rows"))
    pairs = _pair_blocks(_centred_units(own, keys, vector, row), keys, row)
    names = [f.name for f in fields]

    def extent(table: pa.Table) -> pa.Table:
        spans = [(x.min(), x.max()) for x in _pair_distances(table) if len(x)]
        lows, highs = zip(*spans) if spans else ((), ())
        values = [np.min(lows), np.max(highs)] if spans else [None, None]
        columns = [table.column(k).slice(0, 1) for k in [*names, "_a", "_b"]]
        columns += [pa.array([v], pa.float64()) for v in values]
        # one that is not finite is, or makes, the least or the greatest
        columns += [pa.array([not spans or bool(np.isfinite(values).all())])]
        return pa.Table.from_arrays(columns, names=[*names, "_a", "_b", "_lo", "_hi", "_finite"])

    by, arm = [*keys, "_a", "_b"], Window.partitionBy(*keys)
    extents = T.StructType(
        [*fields, *T.StructType.fromDDL("_a int, _b int, _lo double, _hi double, _finite boolean").fields]
    )
    # one row per group
    ranges = pairs.groupBy(*by).applyInArrow(extent, extents).select(
        *by,
        F.min("_lo").over(arm).alias("_lo"),
        F.max("_hi").over(arm).alias("_hi"),
        F.every("_finite").over(arm).alias("_finite"),
    )

    def fill(table: pa.Table, span: pa.Table) -> pa.Table:
        filled = np.zeros(HISTOGRAM_BINS, np.int64)
        low, high, finite = (span.column(c)[0].as_py() for c in ("_lo", "_hi", "_finite"))
        if finite and low is not None:
            for distance in _pair_distances(table):
                filled += np.histogram(distance, HISTOGRAM_BINS, (low, high))[0]
        bins = np.flatnonzero(filled)
        columns = [pa.chunked_array([span.column(k).slice(0, 1).combine_chunks()] * len(bins)) if len(bins)
                   else span.column(k).slice(0, 0) for k in names]
        columns += [pa.array(bins.astype(np.int32)), pa.array(filled[bins].astype(np.int64))]
        return pa.Table.from_arrays(columns, names=[*names, "_bin", "_c"])

    counted = T.StructType(fields + T.StructType.fromDDL("_bin int, _c long").fields)
    bins = pairs.groupBy(*by).cogroup(ranges.groupBy(*by)).applyInArrow(fill, counted)
    bins = bins.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_c"))
    total = F.sum("_c").over(arm)
    entropy = bins.withColumn("_n", total).groupBy(*keys).agg(
        _entropy(F.col("_c"), F.col("_n"), HISTOGRAM_BINS).alias("_e")
    )
    found = counts.join(entropy, list(keys), "left")
    value = F.when(F.col("n_used") < 2, 0.0).otherwise(F.col("_e"))
    return found.select(*keys, "n_rows", "n_used", value.alias("dataset_entropy"))


def mean_pairwise_cosine(
    df: DataFrame,
    keys: Sequence[str],
    vector: str = "embedding",
    sample: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """Mean cosine over all pairs of an arm, in one pass: ``(|sum u|^2 - sum |u|^2) / n(n-1)``.

    With ``sample`` the pairs of that many sampled rows only. Rows without a vector are no rows.
    """
    own = df.where(F.col(vector).isNotNull())
    rows = own if sample is None else sample_rows(own, keys, sample, seed)
    sums = vector_sums(rows, keys, vector, unit_sums)
    whole = F.slice("total", 1, F.size("total") - 1)
    pairs = F.col("n") * (F.col("n") - 1)
    value = (V.dot(whole, whole) - F.element_at("total", -1)) / F.nullif(pairs, F.lit(0))
    found = sums.select(*keys, F.col("n").alias("n_used"), value.alias("mean_pairwise_cosine"))
    if sample is None:
        return found.drop("n_used")
    counts = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return found.join(counts, list(keys)).select(
        *keys, "n_rows", "n_used", "mean_pairwise_cosine"
    )


def representation_metrics(
    df: DataFrame,
    keys: Sequence[str],
    pairs: int | None = None,
    probes: int | None = None,
    row: str = "row_id",
    vector: str = "embedding",
    seed: int = 0,
) -> DataFrame:
    """All eight statistics of every arm. One pass yields the spectral ones, the mean cosine and the
    axis; the others each need their own look at the rows.

    ``pairs`` and ``probes`` bound the rows of the pairwise entropy and of the curvature; without them
    all rows are used. An arm that cannot be measured has NULL statistics and a ``reason``.
    """
    arms = durable(spectra(df, keys, vector))
    parts = [
        prompt_entropy(df, keys, vector, arms),
        dataset_entropy(df, keys, pairs, vector, seed, row).drop("n_rows", "n_used"),
        curvature(df, keys, probes, row, vector, seed=seed).drop("n_rows", "n_probes"),
    ]
    shared = [name for name in METRICS if name in arms.columns]
    joined = arms.select(*keys, "n", "reason", *shared)
    for part in parts:
        joined = joined.join(part, list(keys), "left")
    columns = []
    for name in METRICS:
        value = F.coalesce(name, F.lit(0.0)) if name in CONTEXT_METRICS else F.col(name)
        columns.append(F.when(F.col("reason").isNull(), value).alias(name))
    return joined.select(*keys, "n", *columns, "reason")

