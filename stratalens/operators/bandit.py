"""Linear contextual bandit over logged rewards, one linear model per arm.

The state of an arm, ``A = I + sum x x'`` and ``b = sum r x``, is a sum over its pulls, so it is an
ordinary aggregation that batches can be added to.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CONTEXT_METRICS, UNSEEN_ARM_SCORE
from ..functions import vectors as V
from ..session import broadcast_if_small
from . import rewards as RW
from .ranking import positions

def context_features(
    arms: DataFrame,
    metrics: DataFrame,
    keys: Sequence[str] | None = None,
    names: Sequence[str] = CONTEXT_METRICS,
) -> DataFrame:
    """Adds ``context``: the arm's metrics in order, 0 for any that is missing."""
    keys = list(keys or RW.arm_keys(arms))
    joined = arms.join(metrics.select(*keys, *names), list(keys), "left")
    features = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names]
    return joined.withColumn("context", F.array(*features)).drop(*names)


def _checked(context: Column, dim: int) -> Column:
    if dim <= 0:
        raise ValueError("context dimension must be positive")
    text = F.concat(F.lit(f"context dimension is not {dim}: "), F.size(context).cast("string"))
    wrong = context.isNotNull() & (F.size(context) != dim)
    return F.when(wrong, F.raise_error(text).cast("array<double>")).otherwise(context)


def linucb_state(
    history: DataFrame, dim: int, keys: Sequence[str] | None = None, prior: DataFrame | None = None
) -> DataFrame:
    """``(arm…, a, b, n)`` after the pulls ``(arm…, reward, context)``; ``a`` is row-major.

    ``prior`` is an earlier state the pulls come on top of.
    """
    keys = list(keys or RW.arm_keys(history))
    x = [F.get("_x", F.lit(i)) for i in range(dim)]
    pairs = {(i, j): F.sum(x[i] * x[j]) for i in range(dim) for j in range(i, dim)}
    rows = history.withColumn("_x", _checked(F.col("context"), dim))
    sums = rows.groupBy(*keys).agg(
        F.array(*[pairs[min(i, j), max(i, j)] for i in range(dim) for j in range(dim)]).alias("a"),
        F.array(*[F.sum(F.col("reward") * v) for v in x]).alias("b"),
        F.count(F.lit(1)).alias("n"),
    )
    unit = F.lit([float(v) for v in np.eye(dim).ravel()])

    def plus(left: Column, right: Column) -> Column:
        return F.zip_with(left, right, lambda p, q: p + q)

    if prior is None:
        return sums.withColumn("a", plus(F.col("a"), unit))
    old = prior.select(*keys, F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("n").alias("_n"))
    both = sums.join(old, list(keys), "full")
    zeros = F.lit([0.0] * dim)
    return both.select(
        *keys,
        plus(
            F.coalesce("_a", unit), F.coalesce("a", F.lit([0.0] * dim * dim))
        ).alias("a"),
        plus(F.coalesce("_b", zeros), F.coalesce("b", zeros)).alias("b"),
        (F.coalesce("_n", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n"),
    )


def _ucb(alpha: float):
    @F.pandas_udf("double")
    def ucb(a: pd.Series, b: pd.Series, context: pd.Series) -> pd.Series:
        out = pd.Series(UNSEEN_ARM_SCORE, index=context.index, dtype="float64")
        known = context.notna()
        if known.any():
            x = np.stack(context[known].to_numpy())
            d = x.shape[1]
            matrices = np.stack(a[known].to_numpy()).reshape(-1, d, d)
            vectors = np.stack(b[known].to_numpy())
            try:
                inverse = np.linalg.inv(matrices)
            except np.linalg.LinAlgError:
                inverse = np.linalg.pinv(matrices)
            mean = np.einsum("ni,nij,nj->n", x, inverse, vectors)
            spread = np.einsum("ni,nij,nj->n", x, inverse, x)
            out[known] = mean + alpha * np.sqrt(spread)
        return out

    return ucb


def linucb_score(
    arms: DataFrame, state: DataFrame, dim: int, alpha: float = 1.0, keys: Sequence[str] | None = None
) -> DataFrame:
    """Adds ``ucb = x'A^-1 b + alpha sqrt(x'A^-1 x)``. An arm without pulls starts from ``A = I``;
    one without context scores high enough to be tried first."""
    keys = list(keys or RW.arm_keys(arms))
    joined = arms.join(state.select(*keys, "a", "b"), list(keys), "left")
    unit = F.lit([float(v) for v in np.eye(dim).ravel()])
    score = _ucb(alpha)(
        F.coalesce("a", unit),
        F.coalesce("b", F.lit([0.0] * dim)),
        _checked(F.col("context"), dim),
    )
    return joined.withColumn("ucb", score).drop("a", "b")


def closed_form(history: DataFrame, alpha: float = 1.0, keys: Sequence[str] | None = None) -> DataFrame:
    """The same score where an arm's context never changes, from ``q = x'x``, pulls and their
    reward sum: mean ``R q / (1 + m q)``, spread ``alpha sqrt(q / (1 + m q))``."""
    keys = list(keys or RW.arm_keys(history))
    q = F.max(V.dot(F.col("context"), F.col("context")))
    sums = history.groupBy(*keys).agg(
        q.alias("q"), F.count(F.lit(1)).alias("m"), F.sum("reward").alias("r")
    )
    below = 1 + F.col("m") * F.col("q")
    mean = F.col("r") * F.col("q") / below
    spread = alpha * F.sqrt(F.col("q") / below)
    return sums.select(
        *keys,
        F.col("m").alias("n"),
        mean.alias("mean_reward"),
        spread.alias("uncertainty"),
        (mean + spread).alias("ucb"),
    )


def select_arm(scored: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """The arm with the highest score; the first in list order wins ties."""
    return scored.orderBy(F.desc("ucb"), *(order or RW.arm_keys(scored))).limit(1)


def trajectory(history: DataFrame, keys: Sequence[str] | None = None, seq: str = "seq") -> DataFrame:
    """Every pull with its arm's running pull count. A hot arm may span many tasks."""
    keys = list(keys or RW.arm_keys(history))
    return positions(history, [F.col(seq).asc()], group=keys, name="count")


def best_arm(history: DataFrame, keys: Sequence[str] | None = None, seq: str = "seq") -> DataFrame:
    """The arm with the highest mean reward; the one pulled first wins ties."""
    keys = list(keys or RW.arm_keys(history))
    means = history.groupBy(*keys).agg(
        F.avg("reward").alias("mean_reward"),
        F.count(F.lit(1)).alias("n"),
        F.min(seq).alias("first_seq"),
    )
    return means.orderBy(F.round("mean_reward", 12).desc(), "first_seq").limit(1)


def replay(
    contexts: DataFrame,
    scores: DataFrame,
    baseline: DataFrame,
    budget: int,
    alpha: float = 1.0,
    method: str = "mean",
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Spend a budget of arm evaluations on logged scores.

    No arm is pulled twice, so an arm is always scored with ``A = I`` and the order of pulls is
    that of ``alpha |x|``: the first ``budget`` arms in one sort. Arms without scores use budget
    but earn no reward.
    """
    keys = list(keys or RW.arm_keys(contexts))
    first = F.coalesce(alpha * V.norm(F.col("context")), F.lit(UNSEEN_ARM_SCORE))
    chosen = contexts.withColumn("ucb", first).orderBy(F.round("ucb", 12).desc(), *keys).limit(budget)
    # at most ``budget`` rows
    order = Window.orderBy(F.round("ucb", 12).desc(), *keys)
    pulls = chosen.withColumn("seq", F.row_number().over(order)).select(*keys, "seq", "ucb")
    scored = scores.where(F.col("main_score").isNotNull())
    scored = scored.join(broadcast_if_small(pulls.select(*keys)), list(keys), "left_semi")
    earned = RW.aggregate_rewards(RW.task_reward(scored, baseline), keys, method)
    return pulls.join(earned, list(keys), "left").withColumn(
        "n_tasks", F.coalesce("n_tasks", F.lit(0))
    )


def progress(
    pulls: DataFrame,
    scores: DataFrame,
    baseline: DataFrame,
    model_size: str | None,
    at: Column,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """The log of a replay: one row per pulled arm and task with its raw score, its reward and the
    arm's aggregated reward. ``model_size`` names the size of arms that have none of their own."""
    keys = list(keys or RW.arm_keys(pulls))
    chosen = broadcast_if_small(pulls.select(*keys, "aggregated_reward"))
    scored = scores.where(F.col("main_score").isNotNull()).join(chosen, list(keys))
    return RW.task_reward(scored, baseline).select(
        at.alias("timestamp"),
        (F.col("model_size") if "model_size" in keys else F.lit(model_size)).alias("model_size"),
        F.col("revision").alias("arm_checkpoint"),
        F.col("layer").alias("arm_layer"),
        "task",
        F.col("main_score").alias("raw_score"),
        "reward",
        "aggregated_reward",
        F.lit("ok").alias("status"),
    )


def final_result(pulls: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """One row: best arm, pulls with a reward, arms evaluated and budget used."""
    keys = list(keys or RW.arm_keys(pulls))
    mean = F.round("aggregated_reward", 12)
    best = F.max_by(F.struct(*keys), F.when(mean.isNotNull(), F.struct(mean, -F.col("seq"))))
    return pulls.agg(
        best.alias("best"),
        F.count("aggregated_reward").alias("trajectory_length"),
        F.count(F.lit(1)).alias("arms_evaluated"),
        F.count(F.lit(1)).alias("budget_used"),
    ).select(
        *[F.col(f"best.{k}").alias(f"best_{k}") for k in keys],
        "trajectory_length", "arms_evaluated", "budget_used",
    )
