"""Scores relative to a baseline checkpoint, and their aggregation over tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import EPS

SIZE = "model_size"


def arm_keys(df: DataFrame) -> list[str]:
    """The columns that name an arm: model size, where the table has it, revision and layer."""
    return [SIZE] * (SIZE in df.columns) + ["revision", "layer"]


def _size(*frames: DataFrame) -> list[str]:
    """The model size, where all frames have it: sizes are then kept apart."""
    return [SIZE] * all(SIZE in f.columns for f in frames)


BASELINE_METHODS = {"mean": F.avg, "max": F.max, "min": F.min}


def baseline_scores(
    scores: DataFrame,
    final_checkpoint: str = "main",
    model_size: str | None = None,
    layers: Sequence[int] | None = None,
    tasks: Sequence[str] | None = None,
) -> DataFrame:
    """``(model_size, task, layer, baseline)`` of the final checkpoint; without a size if the scores
    have none. No layers or tasks means all."""
    rows = scores.where((F.col("revision") == final_checkpoint) & F.col("main_score").isNotNull())
    if model_size is not None:
        rows = rows.where(F.col("model_size") == model_size)
    if layers:
        rows = rows.where(F.col("layer").isin(list(layers)))
    if tasks:
        rows = rows.where(F.col("task").isin(list(tasks)))
    return rows.groupBy(*_size(rows), "task", "layer").agg(F.avg("main_score").alias("baseline"))


def baseline_by_task(baseline: DataFrame, method: str = "mean") -> DataFrame:
    """``(model_size, task, centre, spread, n)`` over the layers; the spread is the population's."""
    if method not in BASELINE_METHODS:
        raise ValueError(f"unknown baseline method: {method}")
    return baseline.groupBy(*_size(baseline), "task").agg(
        BASELINE_METHODS[method]("baseline").alias("centre"),
        F.stddev_pop("baseline").alias("spread"),
        F.count("baseline").alias("n"),
    )


def _left(scores: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Scores with what belongs to their keys, and to their model size if both name one."""
    own = [*_size(scores, other), *keys]
    rest = [c for c in other.columns if c not in (*own, SIZE)]
    return scores.join(other.select(*own, *rest), own, "left")


def _scaled(score: Column, centre: Column, spread: Column) -> Column:
    return F.when(spread < EPS, score - centre).otherwise((score - centre) / spread)


def zscore_reward(scores: DataFrame, baseline: DataFrame, method: str = "mean") -> DataFrame:
    """Adds ``reward``: the score relative to its task's baseline; 0 for a task without one."""
    stats = baseline_by_task(baseline, method)
    spread = F.when(F.col("n") > 1, F.col("spread")).otherwise(0.0 if method == "mean" else 1.0)
    reward = F.when(F.col("centre").isNull(), 0.0).otherwise(
        _scaled(F.col("main_score"), F.col("centre"), spread)
    )
    return _left(scores, stats, ["task"]).withColumn("reward", reward).drop(
        "centre", "spread", "n"
    )


def task_reward(scores: DataFrame, baseline: DataFrame) -> DataFrame:
    """Adds ``reward``: the score against its layer's baseline, or the task mean without one."""
    stats = baseline_by_task(baseline)
    joined = _left(_left(scores, baseline, ["task", "layer"]), stats, ["task"])
    spread = F.when(F.col("n") > 1, F.col("spread")).otherwise(1.0)
    centre = F.coalesce("baseline", "centre")
    reward = F.when(centre.isNull(), 0.0).otherwise(_scaled(F.col("main_score"), centre, spread))
    return joined.withColumn("reward", reward).drop("baseline", "centre", "spread", "n")


def aggregate_rewards(
    rewards: DataFrame, keys: Sequence[str] | None = None, method: str = "mean"
) -> DataFrame:
    """One reward per arm, by :func:`arm_keys` unless others are named: mean, harmonic mean of the
    positive ones, or robust mean (median)."""
    reward = F.col("reward")
    positive = F.when(reward > 0, reward)
    methods = {
        "mean": F.avg(reward),
        "harmonic_mean": F.when(
            F.count(positive) > 0, F.count(positive) / F.sum(1 / positive)
        ).otherwise(F.avg(reward)),
        "robust_mean": F.median(reward),
    }
    if method not in methods:
        raise ValueError(f"unknown aggregation method: {method}")
    return rewards.groupBy(*(keys or arm_keys(rewards))).agg(
        F.coalesce(methods[method], F.lit(0.0)).alias("aggregated_reward"),
        F.count(reward).alias("n_tasks"),
    )
