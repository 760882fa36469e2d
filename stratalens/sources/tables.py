"""Readers of score tables, progress logs, metric chunks, queue logs and caches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import METRIC_CHUNK, SCORES, SWEEP_PROGRESS, WORK_ITEM

CSV_OPTIONS = {"header": True, "escape": '"'}


def without_nan(df: DataFrame) -> DataFrame:
    """NULL for every NaN of a number column."""
    kinds = ("double", "float")
    return df.withColumns({n: F.nanvl(n, F.lit(None).cast(k)) for n, k in df.dtypes if k in kinds})


def read_scores(
    spark: SparkSession, path: str, schema=SCORES, multi_line: bool = True
) -> DataFrame:
    """A score table written as CSV; JSON text columns are quoted.

    With ``multi_line`` a quoted value may hold line ends and every file is read by one task; without it,
    for tables whose values hold none, files are split over tasks.
    """
    rows = spark.read.schema(schema).options(**CSV_OPTIONS, multiLine=multi_line).csv(path)
    return without_nan(rows)


def read_progress(
    spark: SparkSession,
    run_dir: str,
    pattern: str = "progress_shard*.csv",
    schema: str = SWEEP_PROGRESS,
    multi_line: bool = False,
) -> DataFrame:
    """The progress logs of all shards, by header; the bandit's with ``BANDIT_PROGRESS``. Lines as in
    :func:`read_scores`; log values hold no line ends."""
    reader = spark.read.schema(schema).options(**CSV_OPTIONS, enforceSchema=False)
    reader = reader.options(multiLine=multi_line, timestampFormat="yyyy-MM-dd HH:mm:ss")
    return without_nan(reader.csv(f"{run_dir}/{pattern}"))


def completed_pairs(progress: DataFrame, status: str | None = None) -> DataFrame:
    """Distinct (revision, layer) in the log; of any status unless one is named."""
    rows = progress if status is None else progress.where(F.col("status") == status)
    named = F.coalesce(F.col("revision"), F.lit("")) != ""
    digits = F.col("layer").cast("string").rlike(r"^\d+$")
    return rows.where(named & digits).select(
        "revision", F.col("layer").try_cast("int").alias("layer")
    ).distinct()


def read_metric_chunks(spark: SparkSession, run_dir: str) -> DataFrame:
    files = f"{run_dir}/computed_metrics_chunk_*.json"
    return spark.read.text(files, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")
    )


def merge_chunks(chunks: DataFrame) -> DataFrame:
    """Metric records of all chunk files; for a key in several files the last file wins."""
    entries = chunks.select("path", F.explode_outer(F.from_json("content", METRIC_CHUNK)))
    latest = entries.where("key IS NOT NULL").groupBy("key").agg(F.max_by("value", "path").alias("value"))
    return without_nan(latest.select("key", "value.*"))


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WORK_ITEM).json(path)


def read_arms(spark: SparkSession, path: str, **arm: object) -> DataFrame:
    """Cached embeddings or metrics of the named arms; the filter prunes directories."""
    cached = spark.read.parquet(path)
    for name, value in arm.items():
        cached = cached.where(F.col(name) == value)
    return without_nan(cached)


def with_cached_metrics(arms: DataFrame, cached: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Arms with their cached metric record; NULL metrics where none was computed yet."""
    return arms.join(cached, list(keys), "left")
