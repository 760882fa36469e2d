"""Summary, rank, trend, sensitivity, win-rate and difference tables over score rows.

Columns: ``revision, layer, task, main_score``. Means that decide a rank or a best row are compared
to 12 digits, since sums arrive in any order on a cluster; ties then go to the lower layer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import revisions as R
from .coverage import SINGLE_REVISION, complete_tasks, in_last_layers, layer_skeleton, slice_rows

_DIGITS = 12


def settled(value: Column) -> Column:
    return F.round(value, _DIGITS)


def _slice(scores: DataFrame, slice_id: str, last_n: int | None) -> DataFrame:
    return in_last_layers(slice_rows(scores, slice_id), last_n)


def arm_summary(scores: DataFrame, slice_id: str = "S1", last_n: int = 8) -> DataFrame:
    """Spread of the task scores of each revision and layer."""
    score = F.col("main_score")
    return _slice(scores, slice_id, last_n).groupBy("revision", "layer").agg(
        F.avg(score).alias("mean_main_score"),
        F.median(score).alias("median_main_score"),
        F.stddev(score).alias("std_over_tasks"),
        F.min(score).alias("min_task_score"),
        F.max(score).alias("max_task_score"),
        F.count(score).alias("n_tasks"),
    )


def _means(scores: DataFrame, slice_id: str, last_n: int) -> DataFrame:
    return _slice(scores, slice_id, last_n).groupBy("revision", "layer").agg(
        F.avg("main_score").alias("mean_main_score")
    )


def layer_profile(scores: DataFrame, slice_id: str = "S1", last_n: int = 8) -> DataFrame:
    """Mean score per revision and layer, ranked within the revision; at most ``last_n`` rows
    each."""
    by_mean = Window.partitionBy("revision").orderBy(settled(F.col("mean_main_score")).desc())
    return _means(scores, slice_id, last_n).withColumn(
        "rank_within_revision", F.rank().over(by_mean)
    )


def best_layer(scores: DataFrame, slice_id: str = "S1", last_n: int = 8) -> DataFrame:
    """Best layer of each revision and its margin to the second best, 0 if there is none."""
    ranked = Window.partitionBy("revision").orderBy(
        settled(F.col("mean_main_score")).desc(), F.col("layer")
    )
    means = _means(scores, slice_id, last_n)
    second = F.lead("mean_main_score").over(ranked)
    return (
        means.withColumn("place", F.row_number().over(ranked))
        .withColumn(
            "margin_to_2nd_best", F.coalesce(F.col("mean_main_score") - second, F.lit(0.0))
        )
        .where("place = 1")
        .select(
            "revision",
            F.col("layer").alias("best_layer"),
            F.col("mean_main_score").alias("best_mean_main_score"),
            "margin_to_2nd_best",
        )
    )


def trend_long(scores: DataFrame, slice_id: str = "S1", last_n: int = 8) -> DataFrame:
    return _means(scores, slice_id, last_n).select("layer", "revision", "mean_main_score")


def ordered_revisions(scores: DataFrame) -> list[str]:
    """The distinct revisions in checkpoint order: the columns of wide tables."""
    names = scores.select("revision").distinct()
    return [r.revision for r in names.orderBy(*R.revision_order(F.col("revision"))).collect()]


def trend_wide(
    scores: DataFrame,
    slice_id: str = "S1",
    last_n: int = 8,
    revisions: Sequence[str] | None = None,
) -> DataFrame:
    """One row per layer, one column per revision."""
    columns = list(revisions or ordered_revisions(scores))
    trend = trend_long(scores, slice_id, last_n)
    return trend.groupBy("layer").pivot("revision", columns).agg(F.first("mean_main_score"))


def task_sensitivity(scores: DataFrame, slice_id: str = "S1", last_n: int = 8) -> DataFrame:
    """How much each task's score depends on the layer."""
    layers = _slice(scores, slice_id, last_n).groupBy("task", "layer").agg(
        F.avg("main_score").alias("m")
    )
    top = F.max("m")
    best = F.max_by("layer", F.struct(settled(F.col("m")), -F.col("layer")))
    return layers.groupBy("task").agg(
        (top - F.min("m")).alias("range_over_layers"),
        F.stddev("m").alias("std_over_layers"),
        best.alias("best_layer"),
        top.alias("best_score"),
        F.avg("m").alias("mean_score"),
        (top - F.avg("m")).alias("best_minus_mean"),
    )


def win_rate(
    scores: DataFrame,
    slice_id: str = "S1",
    last_n: int = 8,
    baseline_revision: str = SINGLE_REVISION,
    baseline_layer: int = 23,
) -> DataFrame:
    """Wins, losses and ties of each revision and layer against one arm, task by task.

    Rows with a NULL score, or a task the baseline lacks, count nowhere.
    """
    rows = _slice(scores, slice_id, last_n)
    is_base = (F.col("revision") == baseline_revision) & (F.col("layer") == baseline_layer)
    base = rows.where(is_base).select("task", F.col("main_score").alias("base"))
    own = F.col("main_score")
    counts = rows.join(base, "task").groupBy("revision", "layer").agg(
        F.count_if(own > F.col("base")).alias("wins"),
        F.count_if(own < F.col("base")).alias("losses"),
        F.count_if(own == F.col("base")).alias("ties"),
    )
    full = layer_skeleton(rows, last_n).join(counts, ["revision", "layer"], "left")
    full = full.fillna(0, ["wins", "losses", "ties"])
    return full.withColumn("total_tasks", F.col("wins") + F.col("losses") + F.col("ties")).withColumn(
        "win_rate",
        F.when(F.col("total_tasks") > 0, F.col("wins") / F.col("total_tasks")).otherwise(0.0),
    )


def _task_rows(scores: DataFrame, last_n: int | None, include_main: bool) -> DataFrame:
    rows = scores if include_main else scores.where(F.col("revision") != "main")
    return in_last_layers(rows, last_n)


def task_table_long(
    scores: DataFrame, last_n: int | None = None, include_main: bool = False
) -> DataFrame:
    """Scores of the tasks that are complete over every revision and layer."""
    rows = _task_rows(scores, last_n, include_main)
    kept = rows.join(complete_tasks(rows), "task", "left_semi")
    return kept.select("task", "layer", "revision", "main_score")


def task_table_wide(
    scores: DataFrame,
    last_n: int | None = None,
    include_main: bool = False,
    revisions: Sequence[str] | None = None,
) -> DataFrame:
    """As :func:`task_table_long`, revisions as columns in checkpoint order."""
    rows = _task_rows(scores, last_n, include_main)
    columns = list(revisions or ordered_revisions(rows))
    long = task_table_long(scores, last_n, include_main)
    return long.groupBy("task", "layer").pivot("revision", columns).agg(F.first("main_score"))


def task_summary(
    scores: DataFrame, last_n: int | None = None, include_main: bool = False
) -> DataFrame:
    score = F.col("main_score")
    return task_table_long(scores, last_n, include_main).groupBy("task").agg(
        F.count(F.lit(1)).alias("n_combinations"),
        F.count_distinct("revision").alias("n_revisions"),
        F.count_distinct("layer").alias("n_layers"),
        F.avg(score).alias("mean_score"),
        F.stddev(score).alias("std_score"),
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
        (F.max(score) - F.min(score)).alias("score_range"),
    )


def average_main_score(
    scores: DataFrame, tasks: DataFrame, arm: Sequence[str] = ("layer",)
) -> DataFrame:
    """Mean over the expected tasks per layer, or per ``arm`` of several columns, with how many of
    them have a score."""
    expected = tasks.agg(F.count_distinct("task")).scalar()
    scored = scores.where(F.col("main_score").isNotNull())
    rows = scored.join(tasks.select("task"), "task", "left_semi")
    means = rows.groupBy(*arm).agg(
        F.avg("main_score").alias("average_main_score"),
        F.count_distinct("task").alias("num_tasks"),
    )
    state = F.when(F.col("num_tasks") == F.col("expected_tasks"), "complete").otherwise("partial")
    return means.withColumn("expected_tasks", expected).withColumn("status", state)


def average_extremes(averages: DataFrame) -> DataFrame:
    """Mean, lowest and highest layer average, and the layers they are at."""
    value = F.col("average_main_score")
    low = F.struct(settled(value), F.col("layer"))
    high = F.struct(settled(value), -F.col("layer"))
    return averages.agg(
        F.avg(value).alias("mean_across_layers"),
        F.min(value).alias("min_score"),
        F.min_by("layer", low).alias("min_layer"),
        F.max(value).alias("max_score"),
        F.max_by("layer", high).alias("max_layer"),
    )


def score_overview(scores: DataFrame) -> DataFrame:
    score = F.col("main_score")
    return scores.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(score).alias("n_scored"),
        F.count_distinct("revision").alias("n_revisions"),
        F.count_distinct("layer").alias("n_layers"),
        F.count_distinct("task").alias("n_tasks"),
        F.avg(score).alias("mean_score"),
        F.stddev(score).alias("std_score"),
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
    )


def group_stats(scores: DataFrame) -> DataFrame:
    """Mean, standard deviation and count by revision and by layer, in one pass."""
    grouped = scores.groupingSets([["revision"], ["layer"]], "revision", "layer").agg(
        F.avg("main_score").alias("mean_score"),
        F.stddev("main_score").alias("std_score"),
        F.count("main_score").alias("n_scores"),
        F.grouping("revision").alias("layer_row"),
    )
    by_revision = F.col("layer_row") == 0
    return grouped.select(
        F.when(by_revision, "revision").otherwise("layer").alias("grouping"),
        F.when(by_revision, F.col("revision")).otherwise(F.col("layer").cast("string")).alias("value"),
        "mean_score",
        "std_score",
        "n_scores",
    )


def task_type_stats(
    scores: DataFrame, task_types: DataFrame, first_layer: int = 15, last_layer: int = 23
) -> DataFrame:
    """Score statistics per task type and layer, and the gain in percent between two layers."""
    typed = scores.where(F.col("main_score").isNotNull()).join(task_types, "task")
    score = F.col("main_score")
    stats = typed.groupBy("task_type", "layer").agg(
        F.avg(score).alias("mean_score"),
        F.stddev_pop(score).alias("std_score"),
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
    )
    mean = F.col("mean_score")
    ends = stats.groupBy("task_type").agg(
        F.max(F.when(F.col("layer") == first_layer, mean)).alias("first_mean"),
        F.max(F.when(F.col("layer") == last_layer, mean)).alias("last_mean"),
    )
    gain = (F.col("last_mean") / F.nullif(F.col("first_mean"), F.lit(0.0)) - 1) * 100
    return stats.join(ends, "task_type").withColumn("improvement_pct", gain).drop(
        "first_mean", "last_mean"
    )


def read_reference_values(content: DataFrame) -> DataFrame:
    """``{task: {layer: score}}`` documents as ``(task, layer, reference)`` rows."""
    nested = F.from_json("content", "map<string,map<string,double>>")
    return content.select(F.explode(nested).alias("task", "layers")).select(
        "task", F.explode("layers").alias("l", "reference")
    ).select("task", F.col("l").try_cast("int").alias("layer"), "reference")


def compare_reference(ours: DataFrame, reference: DataFrame, how: str = "inner") -> DataFrame:
    """Difference to reference values per task and layer; ``how="full"`` keeps one-sided rows."""
    both = ours.join(reference, ["task", "layer"], how)
    ratio = F.col("ours") / F.nullif(F.col("reference"), F.lit(0.0))
    known = F.col("ours").isNotNull() & F.col("reference").isNotNull()
    pct = F.when(
        known & (F.col("reference") == 0), F.lit(float("inf"))
    ).otherwise((ratio - 1) * 100)
    return both.withColumn("diff", F.col("ours") - F.col("reference")).withColumn("pct_diff", pct)


def compare_summary(differences: DataFrame) -> DataFrame:
    diff = F.col("diff")
    return differences.agg(
        F.count(diff).alias("n"),
        F.avg(F.abs(diff)).alias("mean_abs_diff"),
        F.avg(F.abs(F.col("pct_diff"))).alias("mean_abs_pct_diff"),
        F.count_if(diff < 0).alias("n_below"),
        F.count_if(diff > 0).alias("n_above"),
    )
