"""Task, checkpoint and work grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import EARLY_STEPS, LAST_STEP, LAYERS_BY_SIZE, STEP_STRIDE, TASKS_BY_TYPE
from ..functions import revisions as R

TASKS = [task for group in TASKS_BY_TYPE.values() for task in group]

# Checkpoint samplings, by name.
LOG_STEPS = [1000, 2000, 4000, 8000, 16000, 32000, 64000, 128000]
SPARSE_STEPS = [1000, 2000, 5000, 10000, 20000, 40000, 80000]
GRADED_RANGES = [(1000, 10000, 1000), (15000, 50000, 5000), (60000, 143000, 10000)]


def task_dim(spark: SparkSession) -> DataFrame:
    """``(task, task_type, ord)``, one row per benchmark task."""
    types = [kind for kind, group in TASKS_BY_TYPE.items() for _ in group]
    listed = spark.range(1).select(F.posexplode(F.lit(TASKS)).alias("ord", "task"))
    return listed.select("task", F.get(F.lit(types), F.col("ord")).alias("task_type"), "ord")


def known_checkpoints(*names: DataFrame) -> DataFrame:
    """Distinct checkpoint names of several ``(revision)`` lists, such as branches and tags."""
    every = names[0]
    for more in names[1:]:
        every = every.unionByName(more)
    return every.where(R.is_checkpoint(F.col("revision"))).select("revision").distinct()


def _every(interval: int, first: int | None = None, last: int = LAST_STEP) -> Column:
    return F.sequence(F.lit(first or interval), F.lit(last), F.lit(interval))


def steps(kind: str, interval: int | None = None) -> Column:
    """Steps of a sampling as an array: all, dense, uniform, log, or the older sparse, graded
    and regular."""
    if kind == "all":
        parts = [F.lit(EARLY_STEPS), _every(STEP_STRIDE)]
    elif kind == "dense":
        interval = interval or STEP_STRIDE
        parts = [F.lit([s for s in EARLY_STEPS if s < interval]), _every(interval)]
    elif kind == "uniform":
        parts = [_every(interval or 2 * STEP_STRIDE)]
    elif kind == "log":
        parts = [F.lit(EARLY_STEPS), F.lit(LOG_STEPS)]
    elif kind == "sparse":
        parts = [F.lit(SPARSE_STEPS)]
    elif kind == "graded":
        parts = [_every(by, first, last) for first, last, by in GRADED_RANGES]
    elif kind == "regular":
        parts = [_every(interval or 5 * STEP_STRIDE)]
    else:
        raise ValueError(f"unknown sampling: {kind}")
    return F.concat(*parts)


def checkpoint_grid(
    spark: SparkSession, kind: str, interval: int | None = None, prefix: str = "step"
) -> DataFrame:
    """Checkpoint names of a sampling in order, ``main`` last, as ``(revision, step, ord)``."""
    listed = spark.range(1).select(F.posexplode(steps(kind, interval)).alias("ord", "step"))
    named = listed.select(F.concat(F.lit(prefix), "step").alias("revision"), "step", "ord")
    main = spark.range(1).select(
        F.lit("main").alias("revision"),
        F.lit(None).cast("int").alias("step"),
        F.size(steps(kind, interval)).alias("ord"),
    )
    return named.unionByName(main)


def work_grid(
    revisions: DataFrame,
    sizes: Sequence[str] = tuple(LAYERS_BY_SIZE),
    layers: str = "all",
    tasks: Sequence[str] | None = None,
    only_size: str | None = None,
) -> DataFrame:
    """Every size, revision and layer, and with ``tasks`` every task: the units of work."""
    kept = [size for size in sizes if only_size in (None, size)]
    counts = F.create_map(*[F.lit(x) for size in kept for x in (size, LAYERS_BY_SIZE[size])])
    grid = revisions.select("revision", F.explode(counts).alias("model_size", "n_layers"))
    grid = grid.select(
        "model_size",
        "revision",
        F.explode(R.layers_of(F.lit(layers), F.col("n_layers"))).alias("layer"),
    )
    if tasks is None:
        return grid
    return grid.withColumn("task", F.explode(F.lit(list(tasks))))


def missing_steps(revisions: DataFrame, stride: int = STEP_STRIDE) -> DataFrame:
    """Steps of the stride between the first and the last known one that are not there."""
    known = revisions.select(R.step_of(F.col("revision")).alias("step")).where(
        F.col("step").isNotNull()
    )
    ends = known.agg(F.min("step").alias("low"), F.max("step").alias("high"))
    expected = ends.where("low IS NOT NULL").select(
        F.explode(F.sequence("low", "high", F.lit(stride).cast("long"))).alias("step")
    )
    return expected.join(known, "step", "left_anti")
