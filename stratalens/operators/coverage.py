"""Coverage and comparability tables over score rows ``(revision, layer, task, main_score)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The checkpoints that were measured on their own.
PAIR_REVISIONS = ("step138000", "step139000")
SINGLE_REVISION = "step137000"


def comma_list(column: str) -> Column:
    """Distinct values of a group, sorted and joined with commas."""
    return F.array_join(F.array_sort(F.collect_set(column)), ", ")


def last_layers(scores: DataFrame, n: int) -> DataFrame:
    """The ``n`` highest layers."""
    return scores.select("layer").distinct().orderBy(F.desc("layer")).limit(n)


def in_last_layers(scores: DataFrame, n: int | None) -> DataFrame:
    if n is None:
        return scores
    return scores.join(F.broadcast(last_layers(scores, n)), "layer", "left_semi")


def _layer_array(scores: DataFrame, n: int) -> Column:
    return last_layers(scores, n).agg(F.collect_list("layer").alias("layers")).scalar()


def layer_skeleton(scores: DataFrame, n: int) -> DataFrame:
    """Every revision with each of the last ``n`` layers, present or not."""
    return scores.select("revision").distinct().select(
        "revision", F.explode(_layer_array(scores, n)).alias("layer")
    )


def _total(scores: DataFrame, *columns: str) -> Column:
    return scores.agg(F.count_distinct(*columns)).scalar()


def common_tasks(scores: DataFrame) -> DataFrame:
    """Tasks that every revision has."""
    per_task = scores.groupBy("task").agg(F.count_distinct("revision").alias("n"))
    return per_task.where(F.col("n") == _total(scores, "revision")).select("task")


def tasks_of(scores: DataFrame, revision: str) -> DataFrame:
    return scores.where(F.col("revision") == revision).select("task").distinct()


def common_tasks_pair(scores: DataFrame, first: str, second: str) -> DataFrame:
    return tasks_of(scores, first).intersect(tasks_of(scores, second))


def slice_rows(
    scores: DataFrame,
    slice_id: str = "S1",
    pair: tuple[str, str] = PAIR_REVISIONS,
    single: str = SINGLE_REVISION,
) -> DataFrame:
    """Comparable rows: S1 all revisions, S2 two of them, S3 one, each on its common tasks."""
    if slice_id == "S1":
        return scores.join(common_tasks(scores), "task", "left_semi")
    if slice_id == "S2":
        rows = scores.where(F.col("revision").isin(*pair))
        return rows.join(common_tasks_pair(scores, *pair), "task", "left_semi")
    if slice_id == "S3":
        return scores.where(F.col("revision") == single)
    raise ValueError(f"unknown slice: {slice_id}")


def revision_task_coverage(scores: DataFrame) -> DataFrame:
    return scores.groupBy("revision").agg(
        F.count_distinct("task").alias("n_tasks"), comma_list("task").alias("task_list")
    )


def revision_layer_coverage(scores: DataFrame, last_n: int = 8) -> DataFrame:
    """Task count and missing common tasks of every revision and late layer."""
    rows = in_last_layers(scores, last_n)
    common = common_tasks(rows).agg(F.collect_set("task")).scalar()
    seen = rows.groupBy("revision", "layer").agg(
        F.count_distinct("task").alias("n_tasks"), F.collect_set("task").alias("tasks")
    )
    full = layer_skeleton(rows, last_n).join(seen, ["revision", "layer"], "left")
    have = F.coalesce("tasks", F.array().cast("array<string>"))
    missing = F.sort_array(F.array_except(common, have))
    return full.select(
        "revision",
        "layer",
        F.coalesce("n_tasks", F.lit(0)).alias("n_tasks"),
        F.when(F.size(missing) == 0, "none").otherwise(F.array_join(missing, ", ")).alias(
            "missing_tasks"
        ),
    )


def comparable_slices(
    scores: DataFrame, pair: tuple[str, str] = PAIR_REVISIONS, single: str = SINGLE_REVISION
) -> DataFrame:
    """Definition rows of the three slices."""
    revisions = scores.agg(
        comma_list("revision").alias("revisions"),
        F.count_distinct("revision").alias("n_revisions"),
    )

    def tasks(of: DataFrame) -> DataFrame:
        return of.agg(comma_list("task").alias("tasks"), F.count("task").alias("n_tasks"))

    def row(slice_id: str, of: DataFrame, revs: Column, n_revisions: Column, text: str):
        return tasks(of).select(
            F.lit(slice_id).alias("slice_id"),
            F.lit(text).alias("description"),
            revs.alias("revisions"),
            "tasks",
            "n_tasks",
            n_revisions.cast("long").alias("n_revisions"),
        )

    first = row(
        "S1",
        common_tasks(scores),
        revisions.select("revisions").scalar(),
        revisions.select("n_revisions").scalar(),
        "all revisions, common tasks",
    )
    second = row(
        "S2",
        common_tasks_pair(scores, *pair),
        F.lit(", ".join(pair)),
        F.lit(2),
        f"{pair[0]} and {pair[1]}, common tasks",
    )
    third = row("S3", tasks_of(scores, single), F.lit(single), F.lit(1), f"{single}, all tasks")
    return first.unionByName(second).unionByName(third)


def complete_tasks(scores: DataFrame, last_n: int | None = None) -> DataFrame:
    """Tasks with a row for every revision and layer that occurs."""
    rows = in_last_layers(scores, last_n)
    cells = rows.groupBy("task").agg(F.count_distinct("revision", "layer").alias("n"))
    expected = _total(rows, "revision") * _total(rows, "layer")
    return cells.where(F.col("n") == expected).select("task")


def missing_combinations(scores: DataFrame) -> DataFrame:
    """Revision, layer and task triples without a row, though each part occurs."""
    layers = scores.agg(F.collect_set("layer")).scalar()
    tasks = scores.agg(F.collect_set("task")).scalar()
    expected = (
        scores.select("revision").distinct()
        .select("revision", F.explode(layers).alias("layer"))
        .select("revision", "layer", F.explode(tasks).alias("task"))
    )
    return expected.join(
        scores.select("revision", "layer", "task"), ["revision", "layer", "task"], "left_anti"
    )
