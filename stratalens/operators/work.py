"""Resuming, sharding and counting units of work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import STATUSES
from ..functions import revisions as R
from .score_tables import settled

UNIT = ("model_size", "revision", "layer", "task")


def pending(grid: DataFrame, done: DataFrame, keys: Sequence[str] = UNIT) -> DataFrame:
    """Units without a completion marker."""
    return grid.join(done.select(*keys), list(keys), "left_anti")


def finished(grid: DataFrame, done: DataFrame, keys: Sequence[str] = UNIT) -> DataFrame:
    return grid.join(done.select(*keys), list(keys), "left_semi")


def shard(tasks: DataFrame, n: int, shard_id: int) -> DataFrame:
    """The tasks of one shard."""
    if not 0 <= shard_id < n:
        raise ValueError(f"shard {shard_id} of {n}")
    return tasks.where(R.task_bucket(F.col("task"), n) == shard_id)


def shard_meta(tasks: DataFrame, n: int) -> DataFrame:
    """Per shard its task count, the total and the sorted task list."""
    buckets = tasks.select("task").distinct().withColumn("shard_id", R.task_bucket(F.col("task"), n))
    total = tasks.agg(F.count_distinct("task")).scalar()
    return buckets.groupBy("shard_id").agg(
        F.count(F.lit(1)).alias("num_tasks_this_shard"),
        F.array_join(F.array_sort(F.collect_list("task")), ", ").alias("tasks_this_shard"),
    ).withColumn("num_tasks_total", total)


def status_counts(items: DataFrame) -> DataFrame:
    """Items per status, with a zero for statuses that do not occur."""
    counts = items.agg(
        *[F.count_if(F.col("status") == name).alias(name) for name in STATUSES]
    )
    return counts.unpivot([], STATUSES, "status", "n")


def pairs_by_checkpoint(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("revision").agg(F.count(F.lit(1)).alias("n_layers"))


def progress_rows(log: DataFrame, digits: int = 3) -> DataFrame:
    """Log rows as they are written: time to the second, elapsed seconds to three digits."""
    return log.withColumns(
        {
            "timestamp": F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"),
            "elapsed_sec": F.bround(settled(F.col("elapsed_sec")), digits),
        }
    )


def arms_left(arms: DataFrame, evaluated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Arms that were not evaluated yet, so that a replay can go on from an earlier log."""
    return arms.join(evaluated.select(*keys).distinct(), list(keys), "left_anti")


def with_model_size(arms: DataFrame, sizes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Arms with the model size that ``sizes`` has for their ``by`` columns; NULL where it has none."""
    return arms.join(sizes.select(*by, "model_size").distinct(), list(by), "left")
