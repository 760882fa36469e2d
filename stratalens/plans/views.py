"""Engine inputs derived from the tables, each as a DataFrame and as the same view in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import METRICS
from ..session import durable
from ..sources.grids import TASKS

N_LAYERS = 24


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of a few small files over all cores, for work that costs much per row. A scan with
    as many partitions as cores, as of any large table, stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def revision_sql(number: str) -> str:
    return (
        f"CASE WHEN {number} % 8 = 7 THEN 'main' "
        f"ELSE concat('step', cast(137000 + 1000 * ({number} % 8) AS string)) END"
    )


def _revision(number: Column) -> Column:
    step = F.concat(F.lit("step"), (137000 + 1000 * (number % 8)).cast("string"))
    return F.when(number % 8 == 7, "main").otherwise(step)


TASK_LIST = "[" + ", ".join(f"'{t}'" for t in TASKS) + "]"

# Every line item counts: a revision's tasks are those its orders are spread over, 32, 12 or 7.
_CELLS = f"""
  SELECT revision, layer, c, l_linenumber, l_quantity, l_tax, l_partkey, l_suppkey,
         CASE WHEN revision = 'step137000' THEN l_orderkey % 32
              WHEN revision IN ('step138000', 'step139000') THEN l_orderkey % 12
              ELSE l_orderkey % 7 END AS t
  FROM (SELECT *, {revision_sql("l_suppkey")} AS revision, l_partkey % 24 AS layer,
               cast(round(l_discount * 100) AS bigint) AS c FROM lineitem)"""

_SCORE = "cast(sum(c) * 100000 // count(*) AS bigint) / 1e6"

VIEWS = {
    "cells": _CELLS,
    "scores": f"""
  SELECT revision, cast(layer AS int) AS layer, {TASK_LIST}[t + 1] AS task, {_SCORE} AS main_score
  FROM cells GROUP BY revision, layer, t""",
    "holey": f"""
  SELECT revision, layer, {TASK_LIST}[t + 1] AS task, {_SCORE} AS main_score
  FROM (SELECT revision, c, t, cast(CASE WHEN layer % 5 = 3 AND t % 4 = 1 THEN layer - 1
                                    ELSE layer END AS int) AS layer FROM cells)
  GROUP BY revision, layer, t""",
    "metrics": """
  SELECT revision AS checkpoint, cast(layer AS int) AS layer,
         cast(sum(cast(l_quantity AS bigint)) * 1000 // count(*) AS bigint) / 1e3 AS prompt_entropy,
         cast(sum(c) * 1000 // count(*) AS bigint) / 1e3 AS dataset_entropy,
         cast(sum(l_partkey % 97) * 1000 // count(*) AS bigint) / 1e3 AS curvature,
         cast(sum(l_suppkey % 11) * 1000 // count(*) AS bigint) / 1e3 AS effective_rank,
         -cast(sum(l_linenumber) * 1000 // count(*) AS bigint) / 1e3 AS logdet_covariance,
         cast(sum(t) * 1000 // count(*) AS bigint) / 1e3 AS anisotropy,
         cast(max(l_quantity) AS double) AS spectral_norm,
         cast(sum(c * c) * 1000 // count(*) AS bigint) / 1e3 AS mean_pairwise_cosine
  FROM cells GROUP BY revision, layer""",
    "arm_embeddings": """
  SELECT r AS revision, cast(vec_id % 4 AS int) AS layer, vec_id AS row_id, label,
         list_transform(embedding, lambda x, i: cast(x AS double) * pow(i, -0.25 * r)) AS embedding
  FROM (SELECT *, unnest([0, 1, 2]) AS r FROM embeddings)""",
    "progress": f"""
  SELECT ts AS timestamp, {revision_sql("user_id")} AS revision,
         cast(event_id % 24 AS int) AS layer, event_type AS task,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status,
         value AS elapsed_sec FROM events""",
    "pulls": f"""
  SELECT event_id AS seq, {revision_sql("user_id")} AS revision,
         cast(event_id % 24 AS int) AS layer, user_id,
         cast(round(value * 100) AS bigint) / 1.0 AS reward FROM events""",
}


def with_views(body: str, *names: str) -> str:
    """``body`` with the named views in front, in dependency order."""
    needed = {n for n in names}
    if needed & {"scores", "holey", "metrics"}:
        needed.add("cells")
    chain = ", ".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in needed)
    return f"WITH {chain} {body}"


def cells(spark: SparkSession, folder: str) -> DataFrame:
    o = F.col("l_orderkey")
    named = table(spark, folder, "lineitem").select(
        _revision(F.col("l_suppkey")).alias("revision"),
        (F.col("l_partkey") % N_LAYERS).cast("int").alias("layer"),
        F.round(F.col("l_discount") * 100).cast("long").alias("c"),
        "l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey",
    )
    t = (
        F.when(F.col("revision") == "step137000", o % 32)
        .when(F.col("revision").isin("step138000", "step139000"), o % 12)
        .otherwise(o % 7)
    )
    return named.withColumn("t", t.cast("int"))


def _score_rows(rows: DataFrame) -> DataFrame:
    grouped = rows.groupBy("revision", "layer", "t").agg(
        F.expr("sum(c) * 100000 div count(1)").alias("micro")
    )
    return grouped.select(
        "revision",
        "layer",
        F.get(F.lit(TASKS), F.col("t")).alias("task"),
        (F.col("micro") / 1e6).alias("main_score"),
    )


def scores(spark: SparkSession, folder: str, once: bool = False) -> DataFrame:
    """Score rows. They are written down first unless the caller reads them only ``once``: the
    line items behind them are then read a single time."""
    rows = _score_rows(cells(spark, folder))
    return rows if once else durable(rows)


def holey(spark: SparkSession, folder: str) -> DataFrame:
    """Score rows of a grid with holes: some cells are counted to the layer below."""
    moved = (F.col("layer") % 5 == 3) & (F.col("t") % 4 == 1)
    layer = F.when(moved, F.col("layer") - 1).otherwise(F.col("layer"))
    return durable(_score_rows(cells(spark, folder).withColumn("layer", layer)))


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    """One record of the eight statistics per arm."""

    def mean(total: str) -> Column:
        return F.expr(f"{total} * 1000 div count(1)") / 1e3

    values = [
        mean("sum(cast(l_quantity AS bigint))"),
        mean("sum(c)"),
        mean("sum(l_partkey % 97)"),
        mean("sum(l_suppkey % 11)"),
        -mean("sum(l_linenumber)"),
        mean("sum(t)"),
        F.max("l_quantity").cast("double"),
        mean("sum(c * c)"),
    ]
    named = [value.alias(name) for name, value in zip(METRICS, values)]
    return (
        cells(spark, folder)
        .groupBy(F.col("revision").alias("checkpoint"), "layer")
        .agg(*named)
    )


def arm_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Twelve arms: the vectors of four layers at three dampings."""
    damped = F.transform(
        "embedding",
        lambda x, i: x.cast("double") * F.pow((i + 1).cast("double"), -0.25 * F.col("revision")),
    )
    return (
        table(spark, folder, "embeddings")
        .withColumn("revision", F.explode(F.lit([0, 1, 2])))
        .select(
            "revision",
            (F.col("vec_id") % 4).cast("int").alias("layer"),
            F.col("vec_id").alias("row_id"),
            "label",
            damped.alias("embedding"),
        )
    )


def progress(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("ts").alias("timestamp"),
        _revision(F.col("user_id")).alias("revision"),
        (F.col("event_id") % 24).cast("int").alias("layer"),
        F.col("event_type").alias("task"),
        F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"),
        F.col("value").alias("elapsed_sec"),
    )


def pulls(spark: SparkSession, folder: str) -> DataFrame:
    """Logged bandit pulls, one per event, rewards in whole cents."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("seq"),
        _revision(F.col("user_id")).alias("revision"),
        (F.col("event_id") % 24).cast("int").alias("layer"),
        "user_id",
        F.round(F.col("value") * 100).cast("long").cast("double").alias("reward"),
    )
