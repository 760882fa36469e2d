"""Writers of tables, logs, caches and keyed JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import revisions as R


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, escape='"').csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Append a batch of rows to a log."""
    df.write.mode("append").options(header=True, escape='"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_arms(df: DataFrame, path: str, mode: str = "append") -> None:
    """Cache embeddings or metrics by arm. Rows of an arm go to few files, a hot arm to many:
    the rebalance splits partitions by size."""
    keys = [c for c in ("model_size", "revision", "layer") if c in df.columns]
    df.hint("rebalance", *keys).write.mode(mode).partitionBy(*keys).parquet(path)


def write_task_tables(df: DataFrame, path: str) -> None:
    """One directory per task, named after it, in a single job."""
    named = df.withColumn("task_safe", R.safe_name(F.col("task")))
    named.write.mode("overwrite").partitionBy("task_safe").options(header=True).csv(path)


def keyed_json(df: DataFrame, key: Column, fields: Sequence[str]) -> DataFrame:
    """``(key, json)`` rows, one per arm: the entries of a keyed JSON document."""
    return df.select(key.alias("key"), F.to_json(F.struct(*fields)).alias("json"))


def write_keyed_json(entries: DataFrame, path: str) -> None:
    """One ``{"key": {...}}`` object per line; the lines together are the keyed document."""
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("key").alias("k"))), r'^\{"k":(.*)\}$', 1)
    text = F.concat(F.lit("{"), quoted, F.lit(":"), F.col("json"), F.lit("}"))
    entries.select(text.alias("value")).write.mode("overwrite").text(path)


def layer_json(averages: DataFrame, scores: DataFrame) -> DataFrame:
    """``(key, json)`` per layer of every model size and revision the tables have, with its average,
    counts and task -> score map. The key is the layer, behind size and revision where there are any;
    a task that has several scores there keeps its highest."""
    arm = [c for c in ("model_size", "revision", "layer") if c in averages.columns]
    best = scores.groupBy(*arm, "task").agg(F.max("main_score").alias("main_score"))
    per_layer = best.groupBy(*arm).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("task", "main_score")))).alias(
            "task_scores"
        )
    )
    joined = averages.join(per_layer, arm)
    fields = ["average_main_score", "num_tasks", "expected_tasks", "task_scores"]
    key = F.concat_ws("_", *arm[:-1], F.concat(F.lit("layer_"), F.col("layer").cast("string")))
    return keyed_json(joined, key if arm[:-1] else F.col("layer").cast("string"), fields)


def save_bandit_state(state: DataFrame, path: str) -> None:
    keyed = state.withColumn("arm", R.arm_key(F.col("revision"), F.col("layer")))
    keyed.drop("revision", "layer").write.mode("overwrite").parquet(path)


def load_bandit_state(spark, path: str) -> DataFrame:
    state = spark.read.parquet(path)
    revision, layer = R.parse_arm_key(F.col("arm"))
    return state.select(
        revision.alias("revision"), layer.alias("layer"), *[c for c in state.columns if c != "arm"]
    )
