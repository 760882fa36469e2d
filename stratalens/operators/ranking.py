"""Positions and running totals over a whole table, without a one-task window.

The table is range-sorted once and written to the shared folder with row ids that carry the
partition number. Partition totals are then added up on a frame with one row per partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

LIMITED_TASKS = 256  # neighbouring tasks whose rows are limited together first
_ROW_BITS = 33  # monotonically_increasing_id keeps the partition number above these


def _sorted_once(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    numbered = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    return durable(numbered.withColumn("_part", F.shiftright("_id", _ROW_BITS).cast("int")))


def running_totals(
    df: DataFrame, order: Sequence[Column], totals: Mapping[str, Column]
) -> DataFrame:
    """Adds inclusive running totals in ``order``, which must tell any two rows apart."""
    rows = _sorted_once(df.withColumns({f"_{n}": c for n, c in totals.items()}), order)
    per_part = rows.groupBy("_part").agg(*[F.sum(f"_{n}").alias(f"_{n}_sum") for n in totals])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per sorted partition
    offsets = per_part.select(
        "_part",
        *[F.coalesce(F.sum(f"_{n}_sum").over(before), F.lit(0)).alias(f"_{n}_off") for n in totals],
    )
    inside = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({n: F.sum(f"_{n}").over(inside) for n in totals})
    joined = local.join(F.broadcast(offsets), "_part")
    return joined.withColumns({n: F.col(n) + F.col(f"_{n}_off") for n in totals}).drop(
        "_part", "_id", *[f"_{n}" for n in totals], *[f"_{n}_off" for n in totals]
    )


def positions(
    df: DataFrame,
    order: Sequence[Column],
    group: Sequence[str] = (),
    name: str = "position",
    size: str | None = None,
) -> DataFrame:
    """Adds the 1-based position in ``order``, within ``group`` if given, and the group's size.

    A group may span any number of partitions: its rows are never brought together.
    """
    rows = _sorted_once(df, [*[F.col(c).asc() for c in group], *order])
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per sorted partition
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_off"))
    local = F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1
    placed = rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_off") + local)
    placed = placed.drop("_part", "_id", "_off")
    if group:
        spans = placed.groupBy(*group).agg(
            F.min(name).alias("_first"), F.count(F.lit(1)).alias("_size")
        )
        same = [placed[c].eqNullSafe(spans[c]) for c in group]
        placed = placed.join(spans, same).drop(*[spans[c] for c in group])
        placed = placed.withColumn(name, F.col(name) - F.col("_first") + 1).drop("_first")
    elif size:
        total = counts.agg(F.sum("_rows").alias("_rows"))
        placed = placed.withColumn("_size", total.scalar())
    if size:
        return placed.withColumnRenamed("_size", size)
    return placed.drop("_size")


def top_rows(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """The first ``n`` rows of each group in ``order``, with their rank.

    Spark limits each group per task before it shuffles, as long as ``n`` is not above its own setting
    for that (1000 unless changed); the session's settings are left as they are. The rows that leave the
    tasks are limited per run of tasks first, so that a group found in very many tasks does not meet in
    one of them.
    """
    salted = df.withColumn("_salt", F.floor(F.spark_partition_id() / LIMITED_TASKS))
    kept = salted
    for by in ([*group, "_salt"], list(group)):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        kept = kept.withColumn(rank, place).where(F.col(rank) <= n)
    return kept.drop("_salt")


def average_ranks(df: DataFrame, value: str, weight: str, name: str) -> DataFrame:
    """``(value, rank)``: average rank of each distinct value, every row counting ``weight``."""
    counted = df.groupBy(value).agg(F.sum(weight).alias("_w"))
    upto = running_totals(counted, [F.col(value).asc()], {"_upto": F.col("_w")})
    return upto.select(value, (F.col("_upto") - (F.col("_w") - 1) / 2).alias(name))


def chunks(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Adds ``chunk`` 0..n-1: contiguous runs of near-equal length, longer ones first."""
    placed = positions(df, order, size="_n")
    base = F.expr(f"_n div {n}")
    extra = F.col("_n") % n
    index = F.col("position") - 1
    in_long = F.expr(f"(position - 1) div (_n div {n} + 1)")
    rest = F.floor((index - extra * (base + 1)) / base) + extra
    chunk = F.when(index < extra * (base + 1), in_long).otherwise(rest)
    return placed.withColumn("chunk", chunk.cast("int")).drop("_n")
