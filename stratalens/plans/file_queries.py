"""What is written and read again: logs, queues, caches, tables and keyed JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..constants import METRICS
from ..functions import vectors as X
from ..operators import score_tables as S
from ..operators import work as W
from ..session import shared_folder
from ..sources import sinks as K
from ..sources import tables as T
from . import views as V
from .registry import query, rounded
from .registry import sql_half_even as half_even
from .registry import sql_round as r
from .views import with_views


def _scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("progress_log", f"""SELECT {V.revision_sql("user_id")} AS revision, cast(event_id % 24 AS varchar) AS layer,
    CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, count(*) AS n,
    strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, {r("sum(" + half_even("value", 3) + ")", 3)} AS elapsed_sec
  FROM events GROUP BY ALL""")  # fmt: skip
def progress_log(spark, folder):
    """Two shards' logs, appended to in two batches each, read as one."""
    path = _scratch(spark, "logs")
    empty = F.lit(None).cast("string")
    rows = W.progress_rows(V.progress(spark, folder)).withColumn("layer", F.col("layer").cast("string"))
    rows = rows.select(
        "timestamp", empty.alias("model_size"), "revision", "layer", "task", "status", "elapsed_sec",
        empty.alias("output_dir"), empty.alias("error"),
    )
    for part in range(4):
        batch = rows.where(F.pmod(F.col("layer").cast("int"), F.lit(4)) == part)
        K.append_csv(batch, f"{path}/progress_shard{part % 2}.csv")
    log = T.read_progress(spark, path)
    found = log.groupBy("revision", "layer", "status").agg(
        F.count(F.lit(1)).alias("n"),
        F.date_format(F.min("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("first_at"),
        F.sum("elapsed_sec").alias("elapsed_sec"),
    )
    return rounded(found, "elapsed_sec", digits=3)


@query("queue_file", """SELECT concat('step', o_custkey % 8) AS checkpoint, ['pending', 'processing', 'completed']
    [o_orderkey % 3 + 1] AS status, count(*) AS n, min(cast(o_orderkey % 24 AS int)) AS first_layer
  FROM orders GROUP BY ALL""")  # fmt: skip
def queue_file(spark, folder):
    path = _scratch(spark, "queue")
    status = F.get(F.lit(["pending", "processing", "completed"]), (F.col("o_orderkey") % 3).cast("int"))
    items = V.table(spark, folder, "orders").select(
        F.concat(F.lit("step"), (F.col("o_custkey") % 8).cast("string")).alias("checkpoint"),
        (F.col("o_orderkey") % 24).cast("int").alias("layer"),
        status.alias("status"),
    )
    K.write_json(items, path)
    queue = T.read_queue(spark, path)
    return queue.groupBy("checkpoint", "status").agg(
        F.count(F.lit(1)).alias("n"), F.min("layer").alias("first_layer")
    )


_LENGTH = "sqrt(list_dot_product(embedding, embedding))"


@query("embedding_cache", with_views(f""" SELECT revision, layer, count(*) AS n, {r(f"avg({_LENGTH})")} AS mean_norm
  FROM arm_embeddings WHERE layer = 2 GROUP BY revision, layer""", "arm_embeddings"))  # fmt: skip
def embedding_cache(spark, folder):
    """Embeddings cached by arm; only the asked layer's directories are read."""
    path = _scratch(spark, "embeddings")
    K.write_arms(V.arm_embeddings(spark, folder), path)
    rows = T.read_arms(spark, path, layer=2)
    norm = X.norm(X.as_double(F.col("embedding")))
    found = rows.groupBy("revision", "layer").agg(F.count(F.lit(1)).alias("n"), F.avg(norm).alias("mean_norm"))
    return rounded(found, "mean_norm")


@query("task_tables", with_views(f""" SELECT task, count(*) AS n, {r("sum(main_score)")} AS total
  FROM scores GROUP BY task""", "scores"))  # fmt: skip
def task_tables(spark, folder):
    path = _scratch(spark, "tasks")
    K.write_task_tables(V.scores(spark, folder, once=True), path)
    schema = "revision string, layer int, task string, main_score double, task_safe string"
    rows = spark.read.schema(schema).csv(path, header=True)
    found = rows.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.sum("main_score").alias("total"))
    return rounded(found, "total")


@query("saved_state", with_views(""" SELECT revision, layer, count(*) AS n, sum(reward) AS total
  FROM pulls GROUP BY revision, layer""", "pulls"))  # fmt: skip
def saved_state(spark, folder):
    path = _scratch(spark, "state")
    state = V.pulls(spark, folder).groupBy("revision", "layer").agg(
        F.count(F.lit(1)).alias("n"), F.sum("reward").alias("total")
    )
    K.save_bandit_state(state, path)
    return K.load_bandit_state(spark, path)


@query("arm_metrics_json", with_views(f""" SELECT concat(checkpoint, '_layer_', layer) AS "key", checkpoint, layer,
  {", ".join(METRICS)} FROM metrics""", "metrics"))  # fmt: skip
def arm_metrics_json(spark, folder):
    """Every arm's metrics as an entry of a keyed document, written and merged again."""
    path = _scratch(spark, "metrics")
    key = F.concat("checkpoint", F.lit("_layer_"), F.col("layer").cast("string"))
    entries = K.keyed_json(V.metrics(spark, folder), key, ["checkpoint", "layer", *METRICS])
    K.write_keyed_json(entries, path)
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")
    )
    return T.merge_chunks(lines)


def _register_slice(name: str, slice_id: str, revisions: tuple[str, ...]) -> None:
    listed = ", ".join(f"'{x}'" for x in revisions)
    sql = with_views(f"""
  , own AS (SELECT * FROM scores WHERE revision IN ({listed})),
  shared AS (SELECT task FROM own GROUP BY task HAVING count(DISTINCT revision) = {len(revisions)}),
  rows8 AS (SELECT * FROM own WHERE task IN (SELECT task FROM shared)),
  late AS (SELECT * FROM rows8 WHERE layer IN (SELECT DISTINCT layer FROM rows8 ORDER BY layer DESC LIMIT 8))
  SELECT revision, layer, {r("avg(main_score)")} AS mean_main_score, count(main_score) AS n_tasks
  FROM late GROUP BY revision, layer""", "scores")  # fmt: skip

    @query(name, sql)
    def run(spark, folder):
        summary = S.arm_summary(V.scores(spark, folder), slice_id)
        return rounded(summary.select("revision", "layer", "mean_main_score", "n_tasks"), "mean_main_score")


_register_slice("arm_summary_two_revisions", "S2", ("step138000", "step139000"))
_register_slice("arm_summary_one_revision", "S3", ("step137000",))
