"""Nearest neighbours of a set of probe rows, and the local curvature built on them.

An exact search by pivots. Some rows of an arm, chosen by hash, are its pivots, and every row belongs to
the cell of the pivot nearest to it. An arm of few parts is one cell, which each group splits into cells of
its own, so that its rows need not be dealt out by cell first. In larger arms a probe is first held against
its own cell, which bounds the distance of its k-th neighbour; of the other cells it goes to those only that
the triangle inequality does not rule out. A probe left with many cells, as all are where the vectors have no
structure, is not copied for each of them: an arm is cut into a few parts of rows and of probes, every part of
one meets every part of the other in one group, and within it cells are ruled out again. So a row is copied a
fixed number of times, while the work may be that of all pairs. Distances and ids are ranked; vectors are
joined last. The curvature does not join them at all: lists of neighbours meet their arm's rows, and distances
among the neighbours leave.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import EPS
from ..functions import vectors as V
from ..session import broadcast_if_small, durable
from .moments import arrow_keys, key_fields, to_lists, to_matrix
from .ranking import top_rows
from .sampling import sample_rows

NEIGHBORS = 10
CHUNK_ROWS = 100_000  # rows of an arm that meet probes in one group, fewer where vectors are wide
PART_BYTES = 64 << 20  # of such rows
SWEEPS = 6  # parts of a lone arm's probes, each of which meets the rows; of many arms' each fewer
PROBE_ROWS = 1_000
PLACED_ROWS = 20_000
CELL_ROWS = 400_000  # an arm of fewer rows is one cell
CELL_PARTS = 4  # if these make no more parts
GROUP_ROWS = 2_000  # a group of more rows is split into cells of its own
FEW_CELLS = 4  # a probe with more cells to meet is swept over the whole arm
PIVOT_BYTES = 64 << 20  # pivots that a group holds
SLACK = 1e-9  # of a distance, for rounding: a cell this near the bound is still met
BLOCK_PROBES, BLOCK_ROWS = 256, 2048  # of a matrix of distances
SLAB_BYTES = 32 << 20  # differences of pairs looked at exactly at a time

FOUND = "probe_id long, neighbor_id long, squared double, _at long"
AMONG = "probe_id long, _whole boolean, _condition double, _n int, _d int, _pairs array<int>, _squared array<double>"

# places of probes, places of rows and squared distances, a row per pair
Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _sides(p: np.ndarray, x: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Matrices whose product is the squared distances, less ``share`` of the squared norms."""
    one = (1 - share) * (p**2).sum(axis=1), (1 - share) * (x**2).sum(axis=1)
    left = np.column_stack([-2 * p, one[0], np.ones(len(p))])
    return left, np.column_stack([x, np.ones(len(x)), one[1]])


def _exact(p: np.ndarray, x: np.ndarray, probe: np.ndarray, place: np.ndarray) -> np.ndarray:
    squared = np.empty(len(probe))
    step = max(1, SLAB_BYTES // (8 * max(x.shape[1], 1)))
    for i in range(0, len(probe), step):
        own = slice(i, i + step)
        squared[own] = ((x[place[own]] - p[probe[own]]) ** 2).sum(axis=1)
    return squared


def _first(pairs: Pairs, ids: np.ndarray, k: int, probes: int, limit: np.ndarray) -> Pairs:
    """The first ``k`` pairs per probe; equal distances go by row id. ``limit`` falls to the last of them."""
    probe, place, squared = pairs
    order = np.lexsort((ids[place], squared, probe))
    probe, place, squared = probe[order], place[order], squared[order]
    start = np.searchsorted(probe, np.arange(probes))
    rank = np.arange(len(probe)) - start[probe]
    last = rank == k - 1
    limit[probe[last]] = np.minimum(limit[probe[last]], squared[last])
    kept = rank < k
    return probe[kept], place[kept], squared[kept]


def _search(
    probe_ids: np.ndarray,
    p: np.ndarray,
    ids: np.ndarray,
    x: np.ndarray,
    k: int,
    bound: np.ndarray | None = None,
    homes: np.ndarray | None = None,
    cells: np.ndarray | None = None,
) -> Pairs:
    """The ``k`` rows closest to each probe, itself left out, with exact distances.

    Blocks of probes meet blocks of rows in a matrix of lower bounds, from vectors without the rows'
    mean; pairs that are not ruled out are looked at exactly. With ``bound`` only rows within that distance
    of a probe are found, and with ``homes`` and ``cells`` none of the probe's own cell; cells are then
    ruled out as a whole where they are too far for a block.
    """
    if cells is not None:
        by_cell, by_home = np.argsort(cells, kind="stable"), np.argsort(homes, kind="stable")
    else:
        by_cell, by_home = np.arange(len(x)), np.arange(len(p))
    middle = x.mean(axis=0)
    rows, asked = x[by_cell] - middle, p[by_home] - middle
    share = 4 * (x.shape[1] + 8) * np.finfo(float).eps  # above the rounding of such a product
    left, right = _sides(asked, rows, share)
    norms = (asked**2).sum(axis=1), (rows**2).sum(axis=1)
    limits = np.full(len(p), np.inf) if bound is None else (bound**2 * (1 + 1e-12))[by_home]
    if cells is not None:
        known, start, sizes = np.unique(cells[by_cell], return_index=True, return_counts=True)
        centres = np.add.reduceat(rows, start, axis=0) / sizes[:, None]
        number = np.repeat(np.arange(len(known)), sizes)
        radius = np.sqrt(np.maximum.reduceat(((rows - centres[number]) ** 2).sum(axis=1), start))
        radius = radius + SLACK * (1 + np.sqrt(norms[1].max()))
        to_centres, middles = _sides(asked, centres, share)
        home = homes[by_home]
    found = []
    for i in range(0, len(p), BLOCK_PROBES):
        block = slice(i, min(i + BLOCK_PROBES, len(p)))
        limit, own, count = limits[block], probe_ids[by_home[block]], block.stop - i
        taken = None
        if cells is not None:
            off = np.sqrt(np.maximum(to_centres[block] @ middles.T, 0.0))
            need = ~(off - radius > np.sqrt(limit)[:, None]) & (known != home[block][:, None])
            taken = np.flatnonzero(need.any(axis=0)[number])
        best: Pairs = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for j in range(0, len(x) if taken is None else len(taken), BLOCK_ROWS):
            at = np.arange(j, min(j + BLOCK_ROWS, len(x))) if taken is None else taken[j : j + BLOCK_ROWS]
            whole = at[-1] - at[0] + 1 == len(at)
            span = slice(at[0], at[-1] + 1) if whole else at
            least = left[block] @ right[span].T
            within = ~(least > limit[:, None])
            if within.sum() > 4 * k * count:  # bounds too wide to be of use: take those of this block
                least[ids[by_cell[at]][None, :] == own[:, None]] = np.inf
                if cells is not None:
                    least[cells[by_cell[at]][None, :] == home[block][:, None]] = np.inf
                if len(at) >= k:
                    near = np.partition(least, k - 1, axis=1)[:, k - 1]
                    near = near + 2 * share * (norms[0][block] + norms[1][span].max())
                    np.fmin(limit, near, out=limit)
                within = ~(least > limit[:, None])
            probe, place = np.nonzero(within)
            place = by_cell[at[place]]
            other = ids[place] != own[probe]
            if cells is not None:
                other &= cells[place] != home[block][probe]
            probe, place = probe[other], place[other]
            squared = _exact(p[by_home[block]], x, probe, place)
            close = squared <= limit[probe]
            new = probe[close], place[close], squared[close]
            if len(new[0]):
                pairs = tuple(np.concatenate(both) for both in zip(best, new))
                best = _first(pairs, ids, k, count, limit)
        found.append((by_home[block][best[0]], *best[1:]))
    return tuple(np.concatenate(columns) for columns in zip(*found))


def _own_cells(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, near enough for a search."""
    middle = centres.mean(axis=0)
    centres = centres - middle
    half = (centres**2).sum(axis=1) / 2
    cells = np.empty(len(x), np.int64)
    for i in range(0, len(x), BLOCK_ROWS):
        own = slice(i, i + BLOCK_ROWS)
        cells[own] = np.argmin(half - (x[own] - middle) @ centres.T, axis=1)
    return cells


def _split_search(probe_ids: np.ndarray, p: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Pairs:
    """As ``_search`` without bounds. Where rows are many, some of them make cells: probes are held against
    their own first, which bounds what the others have to be searched for. For few probes that costs more
    than it spares."""
    if len(x) <= GROUP_ROWS or len(p) ** 2 <= len(x):
        return _search(probe_ids, p, ids, x, k)
    centres = x[np.linspace(0, len(x) - 1, int(np.sqrt(len(x)))).astype(np.int64)]
    cells, homes = _own_cells(x, centres), _own_cells(p, centres)
    by_cell, by_home = np.argsort(cells, kind="stable"), np.argsort(homes, kind="stable")
    numbers = np.arange(len(centres) + 1)
    rows, probes = np.searchsorted(cells[by_cell], numbers), np.searchsorted(homes[by_home], numbers)
    found, bound = [], np.full(len(p), np.inf)
    for i in numbers[:-1]:
        own, asked = by_cell[rows[i] : rows[i + 1]], by_home[probes[i] : probes[i + 1]]
        if len(own) and len(asked):
            probe, place, squared = _search(probe_ids[asked], p[asked], ids[own], x[own], k)
            found.append((asked[probe], own[place], squared))
    inside = tuple(np.concatenate(columns) for columns in zip(*found)) if found else None
    if inside is not None:
        last = np.zeros(len(p))
        np.maximum.at(last, inside[0], inside[2])
        full = np.bincount(inside[0], minlength=len(p)) == k
        bound[full] = np.sqrt(last[full])
    outside = _search(probe_ids, p, ids, x, k, bound, homes, cells)
    if inside is None:
        return outside
    both = tuple(np.concatenate(columns) for columns in zip(inside, outside))
    return _first(both, ids, k, len(p), np.full(len(p), np.inf))


def _rows(fields, key: tuple, probe_ids: np.ndarray, base: pa.Table, row: str, pairs: Pairs) -> pa.Table:
    probe, place, squared = pairs
    finite = np.isfinite(squared)
    probe, place, squared = probe[finite], pa.array(place[finite]), squared[finite]
    columns = arrow_keys(fields, [key] * len(probe)) + [
        pa.array(np.asarray(probe_ids, dtype=np.int64)[probe]),
        base.column(row).combine_chunks().take(place).cast(pa.int64()),
        pa.array(squared),
        base.column("_at").combine_chunks().take(place),
    ]
    names = [f.name for f in fields] + ["probe_id", "neighbor_id", "squared", "_at"]
    return pa.Table.from_arrays(columns, names=names)


def _parts(df: DataFrame, keys: Sequence[str], rows: int, name: str) -> DataFrame:
    """How many parts of about ``rows`` rows each arm makes, sent to the tasks if few enough."""
    count = F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name)
    return broadcast_if_small(df.groupBy(*keys).agg(count))


def _chunks(vector: str) -> Column:
    """How many parts of bounded size the rows of a group of them make."""
    fit = F.greatest(PART_BYTES / (8 * F.max(F.size(vector)) + 40), F.lit(1.0))
    return F.ceil(F.count(F.lit(1)) / F.least(F.lit(float(CHUNK_ROWS)), fit)).cast("int")


def _meet(df, probes, keys, row, vector, k, fields, bounded: bool = False) -> DataFrame:
    """Rows and probes of an arm cut into parts by hash; every part of one meets every part of the
    other in a group of bounded size. Up to ``CHUNK_ROWS`` rows make one part, and more than ``PROBE_ROWS``
    probes ``SWEEPS``, or fewer where other arms keep the tasks busy too, so that the copies of a row do not
    grow with its arm up to that size.

    ``bounded`` probes have a ``_bound`` and a ``_cell`` of their own, which they do not meet."""
    schema = T.StructType([*fields, *T.StructType.fromDDL(FOUND).fields])
    n, large = F.col("_n"), F.col("_n") > PROBE_ROWS
    chunks = df.groupBy(*keys).agg(_chunks(vector).alias("_m"))
    asked = durable(probes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), _chunks(vector).alias("_c")))
    every = asked.agg(F.sum(F.when(large, n)).alias("_all"))
    few = F.when(large, F.ceil(SWEEPS * F.sqrt(n / F.col("_all")))).otherwise(1)
    blocks = asked.crossJoin(F.broadcast(every))
    blocks = blocks.select(*keys, F.greatest("_c", few).cast("int").alias("_b"))
    parts = broadcast_if_small(chunks.join(blocks, list(keys)))

    def cut(rows: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        part = F.pmod(F.xxhash64(row), F.col(own)).cast("int")
        return rows.join(parts, list(keys)).withColumn(mine, part).withColumn(
            theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        )

    spread = cut(df, "_m", "_b", "_chunk", "_block")
    copies = cut(probes, "_b", "_m", "_block", "_chunk")

    def find(key, base: pa.Table, near: pa.Table) -> pa.Table:
        if base.num_rows == 0 or near.num_rows == 0:
            return pa.Table.from_batches([], schema=pa_schema)
        probe_ids = near.column(f"_p_{row}").to_numpy()
        search, limits = _split_search, {}
        if bounded:
            search = _search
            limits = {
                "bound": near.column("_p__bound").to_numpy(),
                "homes": near.column("_p__cell").to_numpy(),
                "cells": base.column("_cell").to_numpy(),
            }
        pairs = search(
            probe_ids, to_matrix(near.column(f"_p_{vector}")),
            base.column(row).to_numpy(), to_matrix(base.column(vector)), k, **limits,
        )
        arm = tuple(value.as_py() for value in key[: len(keys)])
        return _rows(fields, arm, probe_ids, base, row, pairs)

    from pyspark.sql.pandas.types import to_arrow_schema

    pa_schema = to_arrow_schema(schema)
    groups_by, more = [*keys, "_chunk", "_block"], ["_cell"] if bounded else []
    left = spread.select(*groups_by, row, "_at", vector, *more).groupBy(*groups_by)
    # aliased, since probes usually come from the same rows
    columns = [*groups_by, row, vector, *more, *(["_bound"] if bounded else [])]
    right = copies.select(*[F.col(c).alias(f"_p_{c}") for c in columns])
    right = right.groupBy(*[f"_p_{c}" for c in groups_by])
    return left.cogroup(right).applyInArrow(find, schema)


def _cogrouped(df, probes, keys, row, vector, k, fields) -> DataFrame:
    """The first ``k`` rows of its cell for each probe."""
    return _meet(df, probes, keys, row, vector, k, fields)


def _swept(df, probes, keys, row, vector, k) -> DataFrame:
    """The first ``k`` rows of other cells within ``_bound`` of each probe, by holding it against the
    whole arm."""
    return _meet(df, probes, keys, row, vector, k, key_fields(df, keys), bounded=True)


def _pivots(df: DataFrame, keys: Sequence[str], row: str, vector: str) -> DataFrame:
    """``(keys…, _cell, _centre)``: about the root of an arm's rows as pivots, one for a small arm."""
    sizes = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(row).alias("_first"),
        F.max(F.size(vector)).alias("_d"),
        _chunks(vector).alias("_c"),
    )
    most = F.least(F.sqrt("_n"), PIVOT_BYTES / (8 * F.col("_d")))
    wide = (F.col("_c") > CELL_PARTS) & (F.col("_n") > GROUP_ROWS)
    wanted = F.when((F.col("_n") > CELL_ROWS) | wide, F.ceil(most)).otherwise(0)
    sizes = broadcast_if_small(sizes.withColumn("_p", wanted))
    chosen = (F.pmod(F.xxhash64(row), F.col("_n")) < F.col("_p")) | (F.col(row) == F.col("_first"))
    found = df.join(sizes, list(keys)).where(chosen)
    found = found.groupBy(*keys, F.col(row).alias("_cell")).agg(F.first(vector).alias("_centre"))
    return durable(found)


def _away(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - centre) ** 2).sum(axis=1))


def _with_table(df, small, keys, rows: int, run, ddl: str, row: str) -> DataFrame:
    """``run(rows, table)`` for bounded parts of an arm's rows, each with all of the arm's ``small``."""
    cut = df.join(_parts(df, keys, rows, "_m"), list(keys))
    cut = cut.withColumn("_part", F.pmod(F.xxhash64(row), F.col("_m")).cast("int")).drop("_m")
    copies = small.join(_parts(df, keys, rows, "_m"), list(keys))
    copies = copies.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_m") - 1))).drop("_m")
    copies = copies.select(*[F.col(c).alias(f"_s_{c}") for c in copies.columns])
    schema = T.StructType(key_fields(df, keys) + T.StructType.fromDDL(ddl).fields)

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        names = list(keys)
        if left.num_rows == 0 or right.num_rows == 0:
            return pa.Table.from_batches([], schema=pa_schema)
        picked, columns = run(left, right.sort_by("_s__cell"))
        own = [left.column(c).take(picked) for c in names]
        return pa.Table.from_arrays([*own, *columns], schema=pa_schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    pa_schema = to_arrow_schema(schema)
    grouped = cut.groupBy(*keys, "_part").cogroup(copies.groupBy(*[f"_s_{c}" for c in [*keys, "_part"]]))
    return grouped.applyInArrow(both, schema)


def _celled(
    df: DataFrame, pivots: DataFrame, several: DataFrame | None, keys: Sequence[str], row: str, vector: str
) -> DataFrame:
    """Rows with the ``_cell`` of their nearest pivot, the lower one of equals, how far ``_off`` it is, and a
    number ``_at`` of their own, as ids may repeat. Only rows of arms of ``several`` cells are dealt out to
    their pivots; those of others have no use for ``_off``."""

    def nearest(left: pa.Table, table: pa.Table):
        x, centres = to_matrix(left.column(vector)), to_matrix(table.column("_s__centre"))
        best, place = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
        for i, centre in enumerate(centres):
            off = _away(x, centre)
            closer = off < best
            best[closer], place[closer] = off[closer], i
        cells = table.column("_s__cell").to_numpy()[place]
        columns = [left.column(row), to_lists(x), pa.array(cells), pa.array(best)]
        return pa.array(np.arange(len(x))), columns

    ddl = f"`{row}` long, `{vector}` array<double>, _cell long, _off double"
    rows = df.select(*keys, F.col(row).cast("long").alias(row), vector)
    only = pivots if several is None else pivots.join(several, list(keys), "left_anti")
    only = broadcast_if_small(only.select(*keys, "_cell"))
    placed = rows.join(only, list(keys)).select(*keys, row, vector, "_cell", F.lit(0.0).alias("_off"))
    if several is not None:
        dealt = rows.join(several, list(keys), "left_semi")
        placed = placed.unionByName(_with_table(dealt, pivots, keys, PLACED_ROWS, nearest, ddl, row))
    return durable(placed.withColumn("_at", F.monotonically_increasing_id()))


def _routed(probes: DataFrame, cells: DataFrame, keys: Sequence[str], row: str, vector: str) -> DataFrame:
    """Each probe once for every other cell that may hold a row within ``_bound`` of it, ``_to`` its pivot;
    if these are more than ``FEW_CELLS`` the probe once, without ``_to``.

    No row of a cell is nearer than the probe's distance to its pivot less the cell's radius, nor than
    the plane between the pivots of that cell and of the probe's own.
    """

    def route(left: pa.Table, table: pa.Table):
        x, bound = to_matrix(left.column(vector)), left.column("_bound").to_numpy()
        home, own = left.column("_cell").to_numpy(), left.column("_off").to_numpy()
        centres, ids = to_matrix(table.column("_s__centre")), table.column("_s__cell").to_numpy()
        at, radius = np.searchsorted(ids, home), table.column("_s__radius").to_numpy()
        slack = SLACK * (1 + np.sqrt((x**2).sum(axis=1)))
        goes = np.empty((len(x), len(centres)), dtype=bool)
        for i, centre in enumerate(centres):
            off = _away(x, centre)
            apart = _away(centres, centre)[at]
            plane = (off**2 - own**2) / np.maximum(2 * apart, 1e-300)
            least = np.maximum(off - radius[i], np.where(apart > 0, plane, 0.0))
            goes[:, i] = (least <= bound + slack) & (at != i)
        many = goes.sum(axis=1) > FEW_CELLS
        picked, to = np.nonzero(goes & ~many[:, None])
        rows = pa.array(np.concatenate([picked, np.flatnonzero(many)]))
        targets = pa.concat_arrays([pa.array(ids[to]), pa.nulls(int(many.sum()), pa.int64())])
        columns = [left.column(row).take(rows), to_lists(x[rows.to_numpy()])]
        return rows, [*columns, pa.array(home).take(rows), pa.array(bound).take(rows), targets]

    ddl = f"`{row}` long, `{vector}` array<double>, _cell long, _bound double, _to long"
    return _with_table(probes, cells, keys, PROBE_ROWS, route, ddl, row)


def knn(
    df: DataFrame,
    probes: DataFrame | None,
    keys: Sequence[str],
    k: int = NEIGHBORS,
    row: str = "row_id",
    vector: str = "embedding",
    vectors: bool = True,
) -> DataFrame:
    """``(keys…, probe_id, neighbor_id, distance, neighbor, rank)``: the ``k`` nearest rows of the
    same arm by Euclidean distance, never the probe itself; without ``probes`` those of every row. Rows
    whose distance is not a number are no neighbours. Without ``vectors`` there is no ``neighbor``."""
    found, placed = _nearest(df, probes, keys, k, row, vector)
    distance = F.sqrt("squared").alias("distance")
    columns = [*keys, "probe_id", "neighbor_id", distance]
    if not vectors:
        return found.select(*columns, "rank")
    found = found.join(placed.select("_at", F.col(vector).alias("neighbor")), "_at")
    return found.select(*columns, "neighbor", "rank")


def _nearest(
    df: DataFrame, probes: DataFrame | None, keys: Sequence[str], k: int, row: str, vector: str
) -> tuple[DataFrame, DataFrame]:
    """``(keys…, probe_id, neighbor_id, squared, _at, rank)``, and the rows that ``_at`` numbers."""
    by = [*keys, "_cell"]
    finite = F.forall(vector, lambda x: F.abs(x) < float("inf"))
    rows = df.where(F.coalesce(finite, F.lit(False))).select(*keys, row, V.as_double(F.col(vector)).alias(vector))
    pivots = _pivots(rows, keys, row, vector)
    several = pivots.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c")
    several = broadcast_if_small(several)
    if several.isEmpty():
        several = None
    placed = _celled(rows, pivots, several, keys, row, vector)
    asked = placed
    if probes is not None:
        chosen = probes.where(F.coalesce(finite, F.lit(False)))
        chosen = chosen.select(*keys, row, V.as_double(F.col(vector)).alias(vector))
        asked = _celled(chosen, pivots, several, keys, row, vector)
    fields = key_fields(placed, by)
    order = [F.col("squared"), F.col("neighbor_id")]

    def best(partial: DataFrame, rank: str) -> DataFrame:
        return top_rows(partial.drop("_cell"), [*keys, "probe_id"], order, k, rank)

    inside = _cogrouped(placed, asked.select(*by, row, vector), by, row, vector, k, fields)
    inside = best(inside, "rank")
    if several is None:  # arms of one cell have been searched as a whole
        return inside, placed
    inside = durable(inside)
    bounds = inside.groupBy(*keys, F.col("probe_id").alias(row)).agg(
        F.when(F.count(F.lit(1)) == k, F.sqrt(F.max("squared"))).alias("_bound")
    )
    far = F.coalesce("_bound", F.lit(float("inf"))).alias("_bound")
    bounded = asked.join(bounds, [*keys, row], "left").select(*by, row, vector, "_off", far)
    radii = placed.groupBy(*by).agg(F.max("_off").alias("_radius"))
    cells = pivots.join(radii, by)
    routed = durable(_routed(bounded.join(several, list(keys)), cells, keys, row, vector))
    near = routed.where("_to IS NOT NULL").drop("_cell").withColumnRenamed("_to", "_cell")
    outside = _cogrouped(placed, near.select(*by, row, vector), by, row, vector, k, fields).drop("_cell")
    swept = _swept(placed, routed.where("_to IS NULL"), keys, row, vector, k)
    both = inside.drop("rank").unionByName(outside).unionByName(swept)
    return best(both, "rank"), placed


def _conditions(squared: np.ndarray, width: int) -> np.ndarray:
    """Condition numbers of the covariances of sets of rows, from matrices of squared distances within
    each set; NaN where fewer than two eigenvalues count."""
    n = squared.shape[1]
    if n < 2:
        return np.full(len(squared), np.nan)
    mean = squared.mean(axis=2)
    gram = mean[:, :, None] + mean[:, None, :] - squared - mean.mean(axis=1)[:, None, None]
    # same nonzero spectrum as the d x d covariance; beyond the rank of the centred rows there is rounding noise only
    values = np.linalg.eigvalsh(gram / (2 * (n - 1)))[:, ::-1][:, : min(n - 1, width)]
    kept = values > EPS
    least = np.where(kept, values, np.inf).min(axis=1)
    return np.where(kept.sum(axis=1) > 1, values[:, 0] / (least + EPS), np.nan)


def _filled(sets: int, n: int, at: np.ndarray, left: np.ndarray, right: np.ndarray, value: np.ndarray) -> np.ndarray:
    """``sets`` symmetric n x n matrices, with values at places ``left``, ``right`` of the ``at``-th."""
    whole = np.zeros((sets, n, n))
    whole[at, left, right] = whole[at, right, left] = value
    return whole


def _by_length(lists: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column by length, with the matrix of their elements."""
    sizes = np.asarray(pc.list_value_length(lists))
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        own = lists.take(pa.array(rows)).combine_chunks()
        yield rows, own.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), n)


def _among(fields, vector: str):
    """Of lists of neighbours the squared distances of the pairs that meet in a group; where a list is there
    as a whole, its condition number instead."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T.StructType([*fields, *T.StructType.fromDDL(AMONG).fields]))

    def among(key, base: pa.Table, asked: pa.Table) -> pa.Table:
        tables = [pa.Table.from_batches([], schema=schema)]
        if base.num_rows == 0 or asked.num_rows == 0:
            return tables[0]
        x, at = to_matrix(base.column(vector)), base.column("_at").to_numpy()
        part, order = base.column("_own").to_numpy(), np.argsort(at)
        one = key[-2].as_py() == key[-1].as_py()
        for rows, near in _by_length(asked.column("_near")):
            n, own = near.shape[1], asked.take(pa.array(rows))
            left, right = np.triu_indices(n, k=1)
            place = order[np.minimum(np.searchsorted(at, near, sorter=order), len(at) - 1)]
            here, of = at[place] == near, part[place]
            met = here[:, left] & here[:, right]
            if not one:
                met &= of[:, left] != of[:, right]
            which, pair = np.nonzero(met)
            squared = _exact(x, x, place[which, left[pair]], place[which, right[pair]])
            whole = own.column("_whole").to_numpy(zero_copy_only=False).astype(bool)
            kept, number = whole[which], np.cumsum(whole) - 1
            filled = number[which[kept]], left[pair[kept]], right[pair[kept]], squared[kept]
            condition = np.full(len(rows), np.nan)
            condition[whole] = _conditions(_filled(whole.sum(), n, *filled), x.shape[1])
            ends = pa.array(np.searchsorted(which[~kept], np.arange(len(rows) + 1)), pa.int32())
            columns = arrow_keys(fields, [tuple(v.as_py() for v in key[: len(fields)])] * len(rows)) + [
                own.column("probe_id"),
                pa.array(whole),
                pa.array(condition),
                pa.array(np.full(len(rows), n), pa.int32()),
                pa.array(np.full(len(rows), x.shape[1]), pa.int32()),
                pa.ListArray.from_arrays(ends, pa.array((left * n + right)[pair[~kept]], pa.int32())),
                pa.ListArray.from_arrays(ends, pa.array(squared[~kept])),
            ]
            tables.append(pa.Table.from_arrays(columns, schema=schema))
        return pa.concat_tables(tables)

    return among


def _condition_of(fields: Sequence[T.StructField]):
    """The condition numbers of some probes' neighbours, put together from what groups found of them."""

    def conditions(table: pa.Table) -> pa.Table:
        whole = table.column("_whole").to_numpy(zero_copy_only=False).astype(bool)
        found = [table.column("_condition").to_numpy()[whole]]
        rest = table.filter(pa.array(~whole))
        sizes, widths = rest.column("_n").to_numpy(), rest.column("_d").to_numpy()
        for n, width in sorted(set(zip(sizes, widths))):
            own = rest.filter(pa.array((sizes == n) & (widths == width)))
            probes, number = np.unique(own.column("probe_id").to_numpy(), return_inverse=True)
            lists = own.column("_pairs").combine_chunks()
            at = np.repeat(number, np.asarray(pc.list_value_length(lists)))
            left, right = np.divmod(lists.flatten().to_numpy(), n)
            squared = own.column("_squared").combine_chunks().flatten().to_numpy()
            found.append(_conditions(_filled(len(probes), n, at, left, right, squared), width))
        values = np.concatenate(found)
        values = values[~np.isnan(values)]
        first = pa.array([0] * len(values), pa.int64())
        names = [f.name for f in fields]
        keys = [table.column(name).combine_chunks().take(first) for name in names]
        return pa.Table.from_arrays([*keys, pa.array(values, pa.float64())], names=[*names, "_condition"])

    return conditions


def _neighborhoods(near: DataFrame, placed: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """``(keys…, _condition)`` of the covariance of each probe's neighbours, from distances among them.

    Lists of neighbours meet the rows, an arm's in parts of bounded size, and a list goes to every pair of
    parts that it has rows in. So a row is copied once for each part of its arm, and no vector for a probe.
    """
    fields = key_fields(placed, keys)
    blocks = F.ceil(F.count(F.lit(1)) / PROBE_ROWS).cast("int")
    parts = broadcast_if_small(placed.groupBy(*keys).agg(_chunks(vector).alias("_m"), blocks.alias("_b")))
    groups_by = [*keys, "_x", "_y"]

    def part(number: Column) -> Column:
        return F.pmod(F.xxhash64(number), F.col("_m")).cast("int")

    rows = placed.select(*keys, "_at", vector).join(parts, list(keys)).withColumn("_own", part(F.col("_at")))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    least, most = F.least("_own", "_other"), F.greatest("_own", "_other")
    rows = rows.select(*keys, least.alias("_x"), most.alias("_y"), "_own", "_at", vector)
    lists = near.groupBy(*keys, "probe_id").agg(F.collect_list("_at").alias("_near")).join(parts, list(keys))
    lists = lists.withColumn("_in", F.array_distinct(F.transform("_near", part)))
    lists = lists.withColumn("_x", F.explode("_in")).withColumn("_y", F.explode("_in")).where("_x <= _y")
    lists = lists.withColumn("_whole", F.size("_in") == 1).select(*groups_by, "probe_id", "_near", "_whole")
    # aliased, since both come from the same rows
    lists = lists.withColumnsRenamed({c: f"_l_{c}" for c in groups_by})
    schema = T.StructType([*fields, *T.StructType.fromDDL(AMONG).fields])
    grouped = rows.groupBy(*groups_by).cogroup(lists.groupBy(*[f"_l_{c}" for c in groups_by]))
    found = grouped.applyInArrow(_among(fields, vector), schema).join(parts, list(keys))
    found = found.withColumn("_block", F.pmod(F.xxhash64("probe_id"), F.col("_b"))).drop("_m", "_b")
    schema = T.StructType([*fields, T.StructField("_condition", T.DoubleType())])
    return found.groupBy(*keys, "_block").applyInArrow(_condition_of(fields), schema)


def curvature(
    df: DataFrame,
    keys: Sequence[str],
    probes: int | None,
    row: str = "row_id",
    vector: str = "embedding",
    k: int = NEIGHBORS,
    seed: int = 0,
) -> DataFrame:
    """Mean condition number of the covariance of each probe's ``min(k, n-1)`` neighbours; 0 below
    three rows. Every row is a probe, or with ``probes`` that many of an arm's, chosen by hash. With the
    rows there are and the probes used."""
    own = df.where(F.col(vector).isNotNull()).select(*keys, row, vector)
    chosen = None if probes is None else durable(sample_rows(own, keys, probes, seed, row))
    near, placed = _nearest(own, chosen, keys, k, row, vector)
    found = _neighborhoods(near, placed, keys, vector)
    found = found.groupBy(*keys).agg(F.avg("_condition").alias("curvature"))
    sizes = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    used = F.col("n_rows") if probes is None else F.least("n_rows", F.lit(probes).cast("long"))
    value = F.when(F.col("n_rows") < 3, 0.0).otherwise(F.coalesce("curvature", F.lit(0.0)))
    return sizes.join(found, list(keys), "left").select(
        *keys, "n_rows", used.alias("n_probes"), value.alias("curvature")
    )
