"""Grids, checkpoint order, sharding, resuming and progress counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import EARLY_STEPS
from ..functions import revisions as R
from ..operators import ranking as K
from ..operators import work as W
from ..sources import grids as G
from ..sources import tables as T
from . import views as V
from .registry import query, rounded
from .registry import sql_half_even as half_even
from .registry import sql_round as r
from .views import with_views

# Grid kinds with their interval.
_KINDS = [("all", None), ("dense", 64), ("uniform", 2000), ("log", None), ("sparse", None),
          ("graded", None), ("regular", 5000)]
_EARLY = f"SELECT unnest({EARLY_STEPS}) AS step"
_GRIDS = f"""grids AS (
  SELECT 'all' AS kind, step FROM ({_EARLY} UNION ALL SELECT unnest(range(1000, 143001, 1000)))
  UNION ALL SELECT 'dense', step FROM ({_EARLY}) WHERE step < 64
  UNION ALL SELECT 'dense', unnest(range(64, 143001, 64))
  UNION ALL SELECT 'uniform', unnest(range(2000, 143001, 2000))
  UNION ALL SELECT 'log', step FROM ({_EARLY})
  UNION ALL SELECT 'log', unnest([1000, 2000, 4000, 8000, 16000, 32000, 64000, 128000])
  UNION ALL SELECT 'sparse', unnest([1000, 2000, 5000, 10000, 20000, 40000, 80000])
  UNION ALL SELECT 'graded', unnest(range(1000, 10001, 1000))
  UNION ALL SELECT 'graded', unnest(range(15000, 50001, 5000))
  UNION ALL SELECT 'graded', unnest(range(60000, 143001, 10000))
  UNION ALL SELECT 'regular', unnest(range(5000, 143001, 5000)))"""


@query("checkpoint_grid", f"""WITH {_GRIDS},
  named AS (SELECT kind, concat('step', step) AS revision FROM grids
    UNION ALL SELECT DISTINCT kind, 'main' FROM grids),
  seen AS (SELECT concat('step', 1000 * (l_partkey % 144)) AS revision, count(*) AS n
    FROM lineitem GROUP BY ALL)
  SELECT kind, revision, coalesce(n, 0) AS n_rows FROM named LEFT JOIN seen USING (revision)""")  # fmt: skip
def checkpoint_grid(spark, folder):
    """How many rows there are for each checkpoint of every sampling."""
    step = (1000 * (F.col("l_partkey") % 144)).cast("string")
    seen = V.table(spark, folder, "lineitem").groupBy(
        F.concat(F.lit("step"), step).alias("revision")
    ).agg(F.count(F.lit(1)).alias("n_rows"))
    grids = None
    for kind, interval in _KINDS:
        grid = G.checkpoint_grid(spark, kind, interval).select(F.lit(kind).alias("kind"), "revision")
        grids = grid if grids is None else grids.unionByName(grid)
    return grids.join(seen, "revision", "left").fillna(0, ["n_rows"])


_GRID_SQL = f"""SELECT model_size, revision, layer, task FROM
  (SELECT DISTINCT {V.revision_sql("l_suppkey")} AS revision FROM lineitem),
  (SELECT '14m' AS model_size, cast(unnest(range(0, 6)) AS int) AS layer
   UNION ALL SELECT '70m', cast(unnest(range(0, 6)) AS int)
   UNION ALL SELECT '410m', cast(unnest(range(0, 24)) AS int)),
  (SELECT unnest({V.TASK_LIST}) AS task)"""
_DONE_SQL = f"""SELECT DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN '70m' ELSE '410m' END AS model_size,
  revision, cast(layer AS int) AS layer, {V.TASK_LIST}[t + 1] AS task FROM cells"""


def _grid(spark, folder):
    revisions = V.cells(spark, folder).select("revision").distinct()
    return G.work_grid(revisions, tasks=G.TASKS)


def _done(spark, folder):
    return V.cells(spark, folder).select(
        F.when(F.col("l_linenumber") % 2 == 0, "70m").otherwise("410m").alias("model_size"),
        "revision",
        "layer",
        F.get(F.lit(G.TASKS), F.col("t")).alias("task"),
    ).distinct()


@query("work_grid", _GRID_SQL)
def work_grid(spark, folder):
    return _grid(spark, folder)


@query("work_grid_of_size", f"SELECT * FROM ({_GRID_SQL}) WHERE model_size = '410m'")
def work_grid_of_size(spark, folder):
    revisions = V.cells(spark, folder).select("revision").distinct()
    return G.work_grid(revisions, tasks=G.TASKS, only_size="410m")


@query("resume_pending", with_views(
    f", grid AS ({_GRID_SQL}) SELECT * FROM grid EXCEPT {_DONE_SQL}", "cells"))
def resume_pending(spark, folder):
    return W.pending(_grid(spark, folder), _done(spark, folder))


@query("resume_done", with_views(
    f", grid AS ({_GRID_SQL}) SELECT * FROM grid INTERSECT {_DONE_SQL}", "cells"))
def resume_done(spark, folder):
    return W.finished(_grid(spark, folder), _done(spark, folder))


_SPEC = """CASE p_size % 3 WHEN 0 THEN 'all' WHEN 1 THEN concat(cast(p_size AS string), ', 3,, 5')
  ELSE concat(' ', cast(p_size AS string), ' ,') END"""


@query("layer_spec", f"""SELECT p_partkey, cast(unnest(CASE WHEN spec = 'all' THEN range(0, n)
    ELSE list_transform(list_filter(string_split(spec, ','), lambda x: trim(x) <> ''),
      lambda x: cast(trim(x) AS bigint)) END) AS int) AS layer
  FROM (SELECT p_partkey, {_SPEC} AS spec, p_size % 24 + 1 AS n FROM part)""")  # fmt: skip
def layer_spec(spark, folder):
    parts = V.table(spark, folder, "part")
    layers = R.layers_of(F.expr(_SPEC), F.col("p_size") % 24 + 1)
    return parts.select("p_partkey", F.explode(layers).alias("layer"))


@query("model_id", """SELECT p_partkey, concat('EleutherAI/pythia-', p_size, 'm') AS model_id,
  concat('EleutherAI__pythia-', p_size, 'm') AS escaped FROM part""")  # fmt: skip
def model_id(spark, folder):
    size = F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("M "))
    name = R.model_id(size)
    parts = V.table(spark, folder, "part")
    return parts.select("p_partkey", name.alias("model_id"), R.escaped(name).alias("escaped"))


@query("arm_key", f"""SELECT concat(revision, '@', layer) AS arm, revision, layer FROM
  (SELECT DISTINCT {V.revision_sql("l_suppkey")} AS revision,
   cast(l_partkey % 24 AS int) AS layer FROM lineitem)""")  # fmt: skip
def arm_key(spark, folder):
    arms = V.cells(spark, folder).select("revision", "layer").distinct()
    keyed = arms.select(R.arm_key(F.col("revision"), F.col("layer")).alias("arm"))
    revision, layer = R.parse_arm_key(F.col("arm"))
    return keyed.select("arm", revision.alias("revision"), layer.alias("layer"))


_NAMES = """CASE p_size % 5 WHEN 0 THEN concat('step', cast(p_partkey AS string))
  WHEN 1 THEN concat('step-', cast(p_partkey AS string)) WHEN 2 THEN 'main'
  WHEN 3 THEN concat('step', p_brand) ELSE 'dev' END"""


@query("rev_filter", f"""SELECT p_partkey, name FROM (SELECT p_partkey, {_NAMES} AS name FROM part)
  WHERE regexp_matches(name, '^step[0-9]+$') OR name = 'main'""")  # fmt: skip
def rev_filter(spark, folder):
    names = V.table(spark, folder, "part").select("p_partkey", F.expr(_NAMES).alias("name"))
    return names.where(R.is_checkpoint(F.col("name")))


@query("revision_order", f"""SELECT name, row_number() OVER (ORDER BY CASE WHEN name = 'main' THEN 1
    WHEN regexp_matches(name, '^step-?[0-9]+$') THEN 0 ELSE 2 END,
    coalesce(try_cast(nullif(regexp_extract(name, '^step-?([0-9]+)$', 1), '') AS bigint), 0), name)
  AS position FROM (SELECT DISTINCT {_NAMES} AS name FROM part)""")  # fmt: skip
def revision_order(spark, folder):
    names = V.table(spark, folder, "part").select(F.expr(_NAMES).alias("name")).distinct()
    return K.positions(names, R.revision_order(F.col("name")))


@query("known_checkpoints", f"""SELECT DISTINCT name AS revision FROM (SELECT {_NAMES} AS name FROM part
    UNION ALL SELECT {V.revision_sql("o_custkey")} FROM orders)
  WHERE regexp_matches(name, '^step[0-9]+$') OR name = 'main'""")  # fmt: skip
def known_checkpoints(spark, folder):
    branches = V.table(spark, folder, "part").select(F.expr(_NAMES).alias("revision"))
    tags = V.table(spark, folder, "orders").select(V._revision(F.col("o_custkey")).alias("revision"))
    return G.known_checkpoints(branches, tags)


_SQUARES = "concat('step', cast(1000 * ((l_partkey * l_partkey) % 143) AS string))"


@query("missing_steps", f"""WITH k AS (SELECT DISTINCT cast(substr({_SQUARES}, 5) AS bigint) AS step FROM lineitem)
  SELECT unnest(range((SELECT min(step) FROM k), (SELECT max(step) FROM k) + 1, 1000)) AS step
  EXCEPT SELECT step FROM k""")  # fmt: skip
def missing_steps(spark, folder):
    steps = V.table(spark, folder, "lineitem").select(F.expr(_SQUARES).alias("revision"))
    return G.missing_steps(steps.distinct())


# Adler-32 of an ASCII string in closed form.
_BUCKETS = f"""buckets AS (SELECT name, cast(
    ((len(x) + list_sum(list_transform(x, lambda c, i: (len(x) - i + 1) * c))) % 65521 * 65536
     + (1 + list_sum(x)) % 65521) % 4 AS bigint) AS b
  FROM (SELECT DISTINCT p_name AS name,
        list_transform(string_split(p_name, ''), lambda c: ascii(c)) AS x FROM part))"""


def _part_tasks(spark, folder):
    return V.table(spark, folder, "part").select(F.col("p_name").alias("task")).distinct()


@query("task_bucket", f"WITH {_BUCKETS} SELECT name AS task, b AS bucket FROM buckets")
def task_bucket(spark, folder):
    return _part_tasks(spark, folder).withColumn("bucket", R.task_bucket(F.col("task"), 4))


@query("shard_filter", f"WITH {_BUCKETS} SELECT name AS task FROM buckets WHERE b = 1")
def shard_filter(spark, folder):
    return W.shard(_part_tasks(spark, folder), 4, 1)


@query("shard_meta", """WITH t AS (SELECT DISTINCT source AS task FROM documents),
  b AS (SELECT task, cast(((len(x) + list_sum(list_transform(x, lambda c, i: (len(x) - i + 1) * c)))
      % 65521 * 65536 + (1 + list_sum(x)) % 65521) % 4 AS bigint) AS shard_id
    FROM (SELECT task, list_transform(string_split(task, ''), lambda c: ascii(c)) AS x FROM t))
  SELECT shard_id, count(*) AS num_tasks_this_shard, string_agg(task, ', ' ORDER BY task)
    AS tasks_this_shard, (SELECT count(*) FROM t) AS num_tasks_total FROM b GROUP BY shard_id""")  # fmt: skip
def shard_meta(spark, folder):
    return W.shard_meta(V.table(spark, folder, "documents").select(F.col("source").alias("task")), 4)


@query("completed_pairs", with_views("SELECT DISTINCT revision, layer FROM progress", "progress"))
def completed_pairs(spark, folder):
    return T.completed_pairs(V.progress(spark, folder))


@query("completed_ok_pairs", with_views(
    "SELECT DISTINCT revision, layer FROM progress WHERE status = 'ok'", "progress"))
def completed_ok_pairs(spark, folder):
    return T.completed_pairs(V.progress(spark, folder), status="ok")


@query("pairs_by_checkpoint", with_views(
    "SELECT revision, count(DISTINCT layer) AS n_layers FROM progress GROUP BY revision",
    "progress"))
def pairs_by_checkpoint(spark, folder):
    return W.pairs_by_checkpoint(T.completed_pairs(V.progress(spark, folder)))


@query("chunk_assign", with_views("""SELECT revision, layer,
    cast(ntile(16) OVER (ORDER BY revision, layer) - 1 AS int) AS chunk
  FROM (SELECT DISTINCT revision, layer FROM progress)""", "progress"))  # fmt: skip
def chunk_assign(spark, folder):
    pairs = T.completed_pairs(V.progress(spark, folder))
    return K.chunks(pairs, [F.col("revision"), F.col("layer")], 16).drop("position")


@query("status_counts", """SELECT status, count(o_orderkey) AS n FROM
  (SELECT unnest(['pending', 'processing', 'completed', 'failed']) AS status) LEFT JOIN
  (SELECT o_orderkey, ['pending', 'processing', 'completed'][o_orderkey % 3 + 1] AS status FROM orders)
  USING (status) GROUP BY status""")  # fmt: skip
def status_counts(spark, folder):
    names = F.lit(["pending", "processing", "completed"])
    status = F.get(names, (F.col("o_orderkey") % 3).cast("int"))
    return W.status_counts(V.table(spark, folder, "orders").select(status.alias("status")))


@query("progress_rows", f"""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "timestamp",
  {half_even("value / 8", 3)} AS elapsed_sec FROM events""")  # fmt: skip
def progress_rows(spark, folder):
    rows = V.table(spark, folder, "events").select(
        "event_id", F.col("ts").alias("timestamp"), (F.col("value") / 8).alias("elapsed_sec")
    )
    return W.progress_rows(rows)
