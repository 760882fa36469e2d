"""Long and wide metric tables, and summaries of the per-arm statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import EARLY_LAYERS, KEY_LAYERS, LATE_LAYERS, METRICS
from ..functions import scores as S
from .coverage import comma_list
from .ranking import running_totals, top_rows
from .score_tables import settled


def metric_entries(scores: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per metric of the preferred split: ``name, value`` still as JSON.

    The outer explode keeps Spark from parsing twice, once to drop empty maps.
    """
    entries = F.explode_outer(S.metric_map(F.col("all_scores"))).alias("name", "value")
    return scores.select(*keep, entries).where("name IS NOT NULL")


def metrics_long(
    scores: DataFrame, keep: Sequence[str] = ("revision", "layer", "task"), lists: bool = True
) -> DataFrame:
    """``(…, metric_name, metric_value)``: numbers and booleans; lists as ``<name>_mean``."""
    entries = metric_entries(scores, keep)
    if not lists:
        entries = entries.where(~S.is_list(F.col("value")))
    suffix = F.when(S.is_list(F.col("value")), "_mean").otherwise("")
    return entries.select(
        *keep,
        F.concat("name", suffix).alias("metric_name"),
        S.metric_value(F.col("value")).alias("metric_value"),
    ).where(F.col("metric_value").isNotNull())


def metric_names(scores: DataFrame) -> list[str]:
    """Distinct metrics that can hold a number: the columns of the wide table.

    Names are deduplicated together with their JSON types; which types count is decided after.
    """
    kinds = F.transform(
        F.map_entries(S.metric_map(F.col("all_scores"))),
        lambda e: F.struct(
            e["key"].alias("name"),
            F.schema_of_variant(e["value"]).alias("kind"),
            F.schema_of_variant(F.try_variant_get(e["value"], "$[0]", "variant")).alias("head"),
        ),
    )
    found = scores.select(F.inline_outer(kinds)).distinct()
    kind = F.col("kind")
    name = F.when(S.kind_is_number(kind) | (kind == "VOID"), F.col("name")).when(
        kind.startswith("ARRAY") & S.kind_is_number(F.col("head")), F.concat("name", F.lit("_mean"))
    )
    named = found.select(name.alias("name")).where("name IS NOT NULL").distinct()
    return [r.name for r in named.orderBy("name").collect()]


def metrics_wide(scores: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Adds a column ``score_<metric>`` per metric, read from the parsed map row by row."""
    names = metric_names(scores) if names is None else names
    found = F.transform(
        F.map_entries(S.metric_map(F.col("all_scores"))),
        lambda e: F.struct(
            F.concat(e["key"], F.when(S.is_list(e["value"]), "_mean").otherwise("")).alias("key"),
            S.metric_value(e["value"]).alias("value"),
        ),
    )
    columns = {
        (n if n.startswith("score_") else f"score_{n}"): F.try_element_at("_metrics", F.lit(n))
        for n in names
    }
    return (
        scores.withColumn("_metrics", F.map_from_entries(found))
        .withColumns(columns)
        .drop("_metrics")
    )


def metric_availability(scores: DataFrame, long: DataFrame) -> DataFrame:
    """Per task how many metrics ever have a value, and which; tasks with none stay."""
    have = long.groupBy("task").agg(
        F.count_distinct("metric_name").alias("n_metrics"),
        comma_list("metric_name").alias("available_metrics"),
    )
    full = scores.select("task").distinct().join(have, "task", "left")
    return full.select(
        "task",
        F.coalesce("n_metrics", F.lit(0)).alias("n_metrics"),
        F.coalesce("available_metrics", F.lit("")).alias("available_metrics"),
    )


def unpivot_metrics(
    metrics: DataFrame, keys: Sequence[str], names: Sequence[str] = METRICS
) -> DataFrame:
    return metrics.unpivot(list(keys), list(names), "metric", "value")


def _quantiles(values: DataFrame, shares: Sequence[float]) -> DataFrame:
    """Exact interpolated quantiles per metric over any number of rows.

    Equal values are counted before anything is sorted; a quantile then needs the two values whose
    running count first reaches its neighbours' positions.
    """
    counted = values.groupBy("metric", "value").agg(F.count(F.lit(1)).alias("c"))
    sizes = values.groupBy("metric").agg(F.count(F.lit(1)).alias("n"))
    upto = running_totals(counted, [F.col("metric"), F.col("value")], {"upto": F.col("c")})
    starts = upto.groupBy("metric").agg(F.min(F.col("upto") - F.col("c")).alias("start"))
    placed = upto.join(F.broadcast(starts.join(sizes, "metric")), "metric")
    picks = []
    for share in shares:
        at = (F.col("n") - 1) * F.lit(share)
        name = f"p{int(share * 100)}"
        last = F.col("upto") - F.col("start")
        low = F.min(F.when(last >= F.floor(at) + 1, F.col("value")))
        high = F.min(F.when(last >= F.ceil(at) + 1, F.col("value")))
        part = F.max(at - F.floor(at))
        picks.append((low + (high - low) * part).alias(name))
    return placed.groupBy("metric").agg(*picks)


def describe(metrics: DataFrame, names: Sequence[str] = METRICS) -> DataFrame:
    """Count, mean, standard deviation, extremes and quartiles of every metric."""
    values = unpivot_metrics(metrics, [], names).where(F.col("value").isNotNull())
    basic = values.groupBy("metric").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = _quantiles(values, [0.25, 0.5, 0.75])
    return basic.join(quartiles, "metric").withColumn("median", F.col("p50"))


def _summaries(names: Sequence[str], digits: int) -> list:
    steps = {"mean": F.avg, "std": F.stddev, "min": F.min, "max": F.max}
    return [
        F.bround(settled(how(name)), digits).alias(f"{name}_{label}")
        for name in names
        for label, how in steps.items()
    ]


def by_checkpoint(
    metrics: DataFrame, names: Sequence[str] = METRICS, digits: int = 4
) -> DataFrame:
    return metrics.groupBy("checkpoint").agg(
        *_summaries(names, digits), F.count("layer").alias("num_layers")
    )


def by_layer(metrics: DataFrame, names: Sequence[str] = METRICS, digits: int = 4) -> DataFrame:
    return metrics.groupBy("layer").agg(
        *_summaries(names, digits), F.count_distinct("checkpoint").alias("num_checkpoints")
    )


def top_extremes(metrics: DataFrame, n: int = 10, names: Sequence[str] = METRICS) -> DataFrame:
    """The ``n`` highest and lowest arms of every metric; fewer if there are fewer."""
    values = unpivot_metrics(metrics, ["checkpoint", "layer"], names).where("value IS NOT NULL")
    tie = [F.col("checkpoint"), F.col("layer")]

    def side(label: str, first) -> DataFrame:
        return top_rows(values, ["metric"], [first, *tie], n).withColumn("side", F.lit(label))

    return side("highest", F.col("value").desc()).unionByName(side("lowest", F.col("value").asc()))


def report(metrics: DataFrame) -> DataFrame:
    """Overview numbers: extremes of effective rank and curvature, early against late layers."""
    rank = F.col("effective_rank")
    bend = F.col("curvature")
    arm = F.concat_ws("@", "checkpoint", F.col("layer").cast("string"))

    def first(value):
        """The arm of the least value; an arm without a value never."""
        order = F.struct(value, F.col("checkpoint"), F.col("layer"))
        return F.min_by(F.when(value.isNotNull(), arm), F.when(value.isNotNull(), order))

    def first_max(value):
        return first(-value)

    def first_min(value):
        return first(value)

    overall = metrics.agg(
        F.count(F.lit(1)).alias("n_arms"),
        F.count_distinct("checkpoint").alias("n_checkpoints"),
        F.count_distinct("layer").alias("n_layers"),
        first_max(rank).alias("max_rank_arm"),
        first_min(rank).alias("min_rank_arm"),
        F.max(rank).alias("max_rank"),
        F.min(rank).alias("min_rank"),
        first_max(bend).alias("max_curvature_arm"),
        first_min(bend).alias("min_curvature_arm"),
    )
    layers = metrics.groupBy("layer").agg(F.bround(settled(F.avg(rank)), 4).alias("m"))
    halves = layers.agg(
        F.avg(F.when(F.col("layer").isin(EARLY_LAYERS), F.col("m"))).alias("early_rank"),
        F.avg(F.when(F.col("layer").isin(LATE_LAYERS), F.col("m"))).alias("late_rank"),
    )
    early = halves.select("early_rank").scalar()
    late = halves.select("late_rank").scalar()
    return overall.withColumns(
        {"early_rank": early, "late_rank": late, "early_minus_late": early - late}
    )


def key_layer_ranks(
    metrics: DataFrame, layers: Sequence[int] = tuple(KEY_LAYERS), digits: int = 4
) -> DataFrame:
    """Effective rank of the layers the report lists."""
    rows = metrics.where(F.col("layer").isin(*layers))
    return by_layer(rows, ["effective_rank"], digits).select(
        "layer", "effective_rank_mean", "effective_rank_std", "num_checkpoints"
    )
