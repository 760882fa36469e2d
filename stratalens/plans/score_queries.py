"""Coverage, score and metric tables over the derived score rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import METRICS, TASKS_BY_TYPE
from ..operators import coverage as C
from ..operators import metric_tables as M
from ..operators import score_tables as S
from ..sources import grids as G
from ..sources import sinks as K
from . import views as V
from .registry import query, rounded
from .registry import sql_half_even as half_even
from .registry import sql_round as r
from .views import with_views

_COMMON = """common AS (SELECT task FROM scores GROUP BY task
  HAVING count(DISTINCT revision) = (SELECT count(DISTINCT revision) FROM scores))"""
_SLICE = f"""{_COMMON}, s1 AS (SELECT * FROM scores WHERE task IN (SELECT task FROM common)),
  last AS (SELECT DISTINCT layer FROM s1 ORDER BY layer DESC LIMIT 8),
  late AS (SELECT * FROM s1 WHERE layer IN (SELECT layer FROM last)),
  means AS (SELECT revision, layer, avg(main_score) AS m FROM late GROUP BY revision, layer)"""


def _slice_sql(body: str) -> str:
    return with_views(f", {_SLICE} {body}", "scores").replace(" , common", ", common", 1)


@query("last_n_layers", with_views(
    "SELECT DISTINCT layer FROM scores ORDER BY layer DESC LIMIT 8", "scores"))
def last_n_layers(spark, folder):
    return C.last_layers(V.scores(spark, folder, once=True), 8)


@query("common_tasks", with_views(f", {_COMMON} SELECT task FROM common", "scores"))
def common_tasks(spark, folder):
    return C.common_tasks(V.scores(spark, folder))


@query("common_tasks_pair", with_views("""
  SELECT task FROM scores WHERE revision = 'step138000'
  INTERSECT SELECT task FROM scores WHERE revision = 'step137000'""", "scores"))  # fmt: skip
def common_tasks_pair(spark, folder):
    return C.common_tasks_pair(V.scores(spark, folder), "step138000", "step137000")


@query("complete_tasks", with_views("""
  SELECT task FROM holey GROUP BY task HAVING count(DISTINCT (revision, layer)) =
    (SELECT count(DISTINCT revision) * count(DISTINCT layer) FROM holey)""", "holey"))  # fmt: skip
def complete_tasks(spark, folder):
    return C.complete_tasks(V.holey(spark, folder))


@query("missing_combos", with_views("""
  SELECT revision, layer, task FROM (SELECT DISTINCT revision FROM holey),
    (SELECT DISTINCT layer FROM holey), (SELECT DISTINCT task FROM holey)
  EXCEPT SELECT revision, layer, task FROM holey""", "holey"))  # fmt: skip
def missing_combos(spark, folder):
    return C.missing_combinations(V.holey(spark, folder))


@query("t1_coverage", with_views("""
  SELECT revision, count(DISTINCT task) AS n_tasks,
         string_agg(DISTINCT task, ', ' ORDER BY task) AS task_list
  FROM scores GROUP BY revision""", "scores"))  # fmt: skip
def t1_coverage(spark, folder):
    return C.revision_task_coverage(V.scores(spark, folder, once=True))


@query("t2_layer_coverage", with_views("""
  , rows8 AS (SELECT * FROM holey WHERE layer IN
      (SELECT DISTINCT layer FROM holey ORDER BY layer DESC LIMIT 8)),
  common AS (SELECT task FROM rows8 GROUP BY task HAVING count(DISTINCT revision) =
      (SELECT count(DISTINCT revision) FROM rows8)),
  cells8 AS (SELECT * FROM (SELECT DISTINCT revision FROM rows8), (SELECT DISTINCT layer FROM rows8)),
  gaps AS (SELECT revision, layer, string_agg(task, ', ' ORDER BY task) AS missing FROM
      (SELECT revision, layer, task FROM cells8, common
       EXCEPT SELECT revision, layer, task FROM rows8) GROUP BY revision, layer),
  seen AS (SELECT revision, layer, count(DISTINCT task) AS n FROM rows8 GROUP BY revision, layer)
  SELECT revision, layer, coalesce(n, 0) AS n_tasks, coalesce(missing, 'none') AS missing_tasks
  FROM cells8 LEFT JOIN seen USING (revision, layer) LEFT JOIN gaps USING (revision, layer)""",
  "holey"))
def t2_layer_coverage(spark, folder):
    return C.revision_layer_coverage(V.holey(spark, folder), 8)


@query("t3_slices", with_views(f"""
  , {_COMMON}, two AS (SELECT task FROM scores WHERE revision = 'step138000'
      INTERSECT SELECT task FROM scores WHERE revision = 'step139000'),
  one AS (SELECT DISTINCT task FROM scores WHERE revision = 'step137000'),
  revs AS (SELECT string_agg(DISTINCT revision, ', ' ORDER BY revision) AS revisions,
                  count(DISTINCT revision) AS n_revisions FROM scores)
  SELECT 'S1' AS slice_id, 'all revisions, common tasks' AS description, revisions,
    (SELECT string_agg(task, ', ' ORDER BY task) FROM common) AS tasks,
    (SELECT count(*) FROM common) AS n_tasks, n_revisions FROM revs
  UNION ALL SELECT 'S2', 'step138000 and step139000, common tasks', 'step138000, step139000',
    (SELECT string_agg(task, ', ' ORDER BY task) FROM two), (SELECT count(*) FROM two), 2
  UNION ALL SELECT 'S3', 'step137000, all tasks', 'step137000',
    (SELECT string_agg(task, ', ' ORDER BY task) FROM one), (SELECT count(*) FROM one), 1""",
  "scores"))
def t3_slices(spark, folder):
    return C.comparable_slices(V.scores(spark, folder))


@query("t4_arm_summary", _slice_sql(f"""
  SELECT revision, layer, {r("avg(main_score)")} AS mean_main_score,
    {r("median(main_score)")} AS median_main_score, {r("stddev_samp(main_score)")} AS std_over_tasks,
    min(main_score) AS min_task_score, max(main_score) AS max_task_score,
    count(main_score) AS n_tasks FROM late GROUP BY revision, layer"""))  # fmt: skip
def t4_arm_summary(spark, folder):
    summary = S.arm_summary(V.scores(spark, folder))
    return rounded(summary, "mean_main_score", "median_main_score", "std_over_tasks")


@query("t5_layer_profile", _slice_sql(f"""
  SELECT revision, layer, {r("m")} AS mean_main_score, cast(rank() OVER
    (PARTITION BY revision ORDER BY round(m, 12) DESC) AS int) AS rank_within_revision
  FROM means"""))  # fmt: skip
def t5_layer_profile(spark, folder):
    return rounded(S.layer_profile(V.scores(spark, folder)), "mean_main_score")


@query("t6_best_layer", _slice_sql(f"""
  SELECT revision, layer AS best_layer, {r("m")} AS best_mean_main_score,
    {r("coalesce(m - second, 0)")} AS margin_to_2nd_best FROM (
    SELECT *, lead(m) OVER w AS second, row_number() OVER w AS n FROM means
    WINDOW w AS (PARTITION BY revision ORDER BY round(m, 12) DESC, layer)) WHERE n = 1"""))  # fmt: skip
def t6_best_layer(spark, folder):
    best = S.best_layer(V.scores(spark, folder))
    return rounded(best, "best_mean_main_score", "margin_to_2nd_best")


@query("t7_trend_long", _slice_sql(
    f"SELECT layer, revision, {r('m')} AS mean_main_score FROM means"))
def t7_trend_long(spark, folder):
    return rounded(S.trend_long(V.scores(spark, folder)), "mean_main_score")


_REVISIONS = [f"step{137000 + 1000 * i}" for i in range(7)] + ["main"]
_WIDE = ", ".join(f"{r(f'max(m) FILTER (revision = {chr(39)}{x}{chr(39)})')} AS {x}" for x in _REVISIONS)


@query("t7_trend_wide", _slice_sql(f"SELECT layer, {_WIDE} FROM means GROUP BY layer"))
def t7_trend_wide(spark, folder):
    wide = S.trend_wide(V.scores(spark, folder))
    return rounded(wide, *[c for c in wide.columns if c != "layer"])


@query("t8_sensitivity", _slice_sql(f"""
  SELECT task, {r("max(m) - min(m)")} AS range_over_layers,
    {r("stddev_samp(m)")} AS std_over_layers,
    arg_max(layer, (round(m, 12), -layer)) AS best_layer,
    {r("max(m)")} AS best_score, {r("avg(m)")} AS mean_score,
    {r("max(m) - avg(m)")} AS best_minus_mean
  FROM (SELECT task, layer, avg(main_score) AS m FROM late GROUP BY task, layer)
  GROUP BY task"""))  # fmt: skip
def t8_sensitivity(spark, folder):
    table = S.task_sensitivity(V.scores(spark, folder))
    return rounded(
        table, "range_over_layers", "std_over_layers", "best_score", "mean_score",
        "best_minus_mean",
    )


@query("t9_win_rate", _slice_sql(f"""
  SELECT revision, layer, coalesce(wins, 0) AS wins, coalesce(losses, 0) AS losses,
    coalesce(ties, 0) AS ties, coalesce(wins + losses + ties, 0) AS total_tasks,
    {r("CASE WHEN wins + losses + ties > 0 THEN wins / (wins + losses + ties) ELSE 0 END")} AS win_rate
  FROM (SELECT * FROM (SELECT DISTINCT revision FROM late), last) LEFT JOIN (
    SELECT a.revision, a.layer,
      cast(sum(CASE WHEN a.main_score > b.main_score THEN 1 ELSE 0 END) AS bigint) AS wins,
      cast(sum(CASE WHEN a.main_score < b.main_score THEN 1 ELSE 0 END) AS bigint) AS losses,
      cast(sum(CASE WHEN a.main_score = b.main_score THEN 1 ELSE 0 END) AS bigint) AS ties
    FROM late a JOIN late b USING (task) WHERE b.revision = 'step137000' AND b.layer = 23
    GROUP BY a.revision, a.layer) USING (revision, layer)"""))  # fmt: skip
def t9_win_rate(spark, folder):
    return rounded(S.win_rate(V.scores(spark, folder)), "win_rate")


_STEPS = """, s AS (SELECT * FROM holey WHERE revision <> 'main'),
  full_tasks AS (SELECT task FROM s GROUP BY task HAVING count(DISTINCT (revision, layer)) =
    (SELECT count(DISTINCT revision) * count(DISTINCT layer) FROM s)),
  kept AS (SELECT * FROM s WHERE task IN (SELECT task FROM full_tasks))"""


@query("task_table_long", with_views(
    f"{_STEPS} SELECT task, layer, revision, main_score FROM kept", "holey"))
def task_table_long(spark, folder):
    return S.task_table_long(V.holey(spark, folder))


_TASK_WIDE = ", ".join(
    f"max(main_score) FILTER (revision = '{x}') AS {x}" for x in _REVISIONS if x != "main"
)


@query("task_table_wide", with_views(
    f"{_STEPS} SELECT task, layer, {_TASK_WIDE} FROM kept GROUP BY task, layer", "holey"))
def task_table_wide(spark, folder):
    return S.task_table_wide(V.holey(spark, folder))


@query("task_summary", with_views(f"""{_STEPS}
  SELECT task, count(*) AS n_combinations, count(DISTINCT revision) AS n_revisions,
    count(DISTINCT layer) AS n_layers, {r("avg(main_score)")} AS mean_score,
    {r("stddev_samp(main_score)")} AS std_score, min(main_score) AS min_score,
    max(main_score) AS max_score, {r("max(main_score) - min(main_score)")} AS score_range
  FROM kept GROUP BY task""", "holey"))  # fmt: skip
def task_summary(spark, folder):
    return rounded(
        S.task_summary(V.holey(spark, folder)), "mean_score", "std_score", "score_range"
    )


_AVERAGES = """avgs AS (SELECT layer, avg(main_score) AS a, count(DISTINCT task) AS n
  FROM scores GROUP BY layer)"""


@query("avg_main_score", with_views(f"""
  , {_AVERAGES} SELECT layer, {r("a")} AS average_main_score, n AS num_tasks,
  cast(32 AS bigint) AS expected_tasks, CASE WHEN n = 32 THEN 'complete' ELSE 'partial' END AS status
  FROM avgs""", "scores"))  # fmt: skip
def avg_main_score(spark, folder):
    averages = S.average_main_score(V.scores(spark, folder, once=True), G.task_dim(spark))
    return rounded(averages, "average_main_score")


@query("avg_main_extremes", with_views(f"""
  , {_AVERAGES} SELECT {r("avg(a)")} AS mean_across_layers, {r("min(a)")} AS min_score,
  arg_min(layer, (round(a, 12), layer)) AS min_layer, {r("max(a)")} AS max_score,
  arg_max(layer, (round(a, 12), -layer)) AS max_layer FROM avgs""", "scores"))  # fmt: skip
def avg_main_extremes(spark, folder):
    averages = S.average_main_score(V.scores(spark, folder, once=True), G.task_dim(spark))
    return rounded(S.average_extremes(averages), "mean_across_layers", "min_score", "max_score")


@query("score_overview", with_views(f"""
  SELECT count(*) AS n_rows, count(main_score) AS n_scored,
    count(DISTINCT revision) AS n_revisions, count(DISTINCT layer) AS n_layers,
    count(DISTINCT task) AS n_tasks, {r("avg(main_score)")} AS mean_score,
    {r("stddev_samp(main_score)")} AS std_score, min(main_score) AS min_score,
    max(main_score) AS max_score FROM scores""", "scores"))  # fmt: skip
def score_overview(spark, folder):
    return rounded(S.score_overview(V.scores(spark, folder, once=True)), "mean_score", "std_score")


@query("score_group_stats", with_views(f"""
  SELECT 'revision' AS "grouping", revision AS "value", {r("avg(main_score)")} AS mean_score,
    {r("stddev_samp(main_score)")} AS std_score, count(main_score) AS n_scores
  FROM scores GROUP BY revision
  UNION ALL SELECT 'layer', cast(layer AS varchar), {r("avg(main_score)")},
    {r("stddev_samp(main_score)")}, count(main_score) FROM scores GROUP BY layer""",
  "scores"))
def score_group_stats(spark, folder):
    return rounded(S.group_stats(V.scores(spark, folder, once=True)), "mean_score", "std_score")


_TYPES = " UNION ALL ".join(
    f"SELECT unnest({tasks!r}) AS task, '{kind}' AS task_type" for kind, tasks in TASKS_BY_TYPE.items()
)


@query("task_dim", with_views(f"""
  , dim AS (SELECT *, cast(list_position({V.TASK_LIST}, task) - 1 AS int) AS ord FROM ({_TYPES}))
  SELECT task, task_type, ord, count(c) AS n_rows FROM dim LEFT JOIN
    (SELECT {V.TASK_LIST}[t + 1] AS task, c FROM cells) USING (task)
  GROUP BY task, task_type, ord""", "cells"))  # fmt: skip
def task_dim(spark, folder):
    named = V.cells(spark, folder).select(F.get(F.lit(G.TASKS), F.col("t")).alias("task"))
    counts = named.groupBy("task").agg(F.count(F.lit(1)).alias("n_rows"))
    return G.task_dim(spark).join(counts, "task", "left").fillna(0, ["n_rows"])


@query("task_type_stats", with_views(f"""
  , stats AS (SELECT task_type, layer, avg(main_score) AS m, stddev_pop(main_score) AS s,
      min(main_score) AS lo, max(main_score) AS hi FROM scores JOIN ({_TYPES}) USING (task)
      GROUP BY task_type, layer),
  ends AS (SELECT task_type, max(m) FILTER (layer = 15) AS a, max(m) FILTER (layer = 23) AS b
      FROM stats GROUP BY task_type)
  SELECT task_type, layer, {r("m")} AS mean_score, {r("s")} AS std_score, lo AS min_score,
    hi AS max_score, {r("(b / nullif(a, 0) - 1) * 100")} AS improvement_pct
  FROM stats JOIN ends USING (task_type)""", "scores"))  # fmt: skip
def task_type_stats(spark, folder):
    types = G.task_dim(spark).select("task", "task_type")
    stats = S.task_type_stats(V.scores(spark, folder), types)
    return rounded(stats, "mean_score", "std_score", "improvement_pct")


def _sides(spark, folder):
    rows = V.scores(spark, folder)

    def of(revision, name):
        kept = rows.where(F.col("revision") == revision)
        return kept.select("task", "layer", F.col("main_score").alias(name))

    return of("main", "ours"), of("step137000", "reference")


_DIFF = """, d AS (SELECT task, layer, o.main_score AS ours, p.main_score AS reference,
    o.main_score - p.main_score AS diff, CASE WHEN p.main_score = 0 THEN 'inf'::DOUBLE
    ELSE (o.main_score / p.main_score - 1) * 100 END AS pct
  FROM scores o JOIN scores p USING (task, layer)
  WHERE o.revision = 'main' AND p.revision = 'step137000')"""


@query("compare_reference", with_views(f"""{_DIFF}
  SELECT task, layer, ours, reference, {r("diff")} AS diff, {r("pct")} AS pct_diff FROM d""",
  "scores"))
def compare_reference(spark, folder):
    return rounded(S.compare_reference(*_sides(spark, folder)), "diff", "pct_diff")


@query("compare_reference_full", with_views(f"""
  SELECT coalesce(o.task, p.task) AS task, coalesce(o.layer, p.layer) AS layer, o.main_score AS ours,
    p.main_score AS reference, {r("o.main_score - p.main_score")} AS diff,
    {r("CASE WHEN p.main_score = 0 THEN 'inf'::DOUBLE ELSE (o.main_score / p.main_score - 1) * 100 END")} AS pct_diff
  FROM (SELECT * FROM scores WHERE revision = 'main') o
  FULL JOIN (SELECT * FROM holey WHERE revision = 'step137000') p ON o.task = p.task AND o.layer = p.layer""",
  "scores", "holey"))
def compare_reference_full(spark, folder):
    """Against a grid with holes, rows that only one side has kept."""
    ours, _ = _sides(spark, folder)
    rows = V.holey(spark, folder).where("revision = 'step137000'")
    reference = rows.select("task", "layer", F.col("main_score").alias("reference"))
    return rounded(S.compare_reference(ours, reference, how="full"), "diff", "pct_diff")


@query("compare_summary", with_views(f"""{_DIFF}
  SELECT count(*) AS n, {r("avg(abs(diff))")} AS mean_abs_diff,
    {r("avg(abs(pct))")} AS mean_abs_pct_diff, count(*) FILTER (diff < 0) AS n_below,
    count(*) FILTER (diff > 0) AS n_above FROM d""", "scores"))  # fmt: skip
def compare_summary(spark, folder):
    summary = S.compare_summary(S.compare_reference(*_sides(spark, folder)))
    return rounded(summary, "mean_abs_diff", "mean_abs_pct_diff")


_LONG = f"(SELECT * FROM metrics UNPIVOT (value FOR metric IN ({', '.join(METRICS)})))"


@query("metrics_describe", with_views(f"""
  SELECT metric, count(value) AS "count", {r("avg(value)")} AS mean, {r("stddev_samp(value)")} AS std,
    min(value) AS min, max(value) AS max, {r("quantile_cont(value, 0.25)")} AS p25,
    {r("quantile_cont(value, 0.5)")} AS p50, {r("quantile_cont(value, 0.75)")} AS p75,
    {r("median(value)")} AS median FROM {_LONG} GROUP BY metric""", "metrics"))  # fmt: skip
def metrics_describe(spark, folder):
    from ..session import durable

    table = M.describe(durable(V.metrics(spark, folder)))
    return rounded(table, "mean", "std", "p25", "p50", "p75", "median")


def _summary_sql(names) -> str:
    steps = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    return ", ".join(
        f"{half_even(f'{how}({n})', 4)} AS {n}_{label}" for n in names for label, how in steps.items()
    )


@query("metrics_by_checkpoint", with_views(f"""
  SELECT checkpoint, {_summary_sql(METRICS)}, count(layer) AS num_layers
  FROM metrics GROUP BY checkpoint""", "metrics"))  # fmt: skip
def metrics_by_checkpoint(spark, folder):
    return M.by_checkpoint(V.metrics(spark, folder))


@query("metrics_by_layer", with_views(f"""
  SELECT layer, {_summary_sql(METRICS)}, count(DISTINCT checkpoint) AS num_checkpoints
  FROM metrics GROUP BY layer""", "metrics"))  # fmt: skip
def metrics_by_layer(spark, folder):
    return M.by_layer(V.metrics(spark, folder))


@query("top_extremes", with_views(f"""
  , long AS {_LONG}, ranked AS (SELECT *,
    cast(row_number() OVER (PARTITION BY metric ORDER BY value DESC, checkpoint, layer) AS int) AS hi,
    cast(row_number() OVER (PARTITION BY metric ORDER BY value, checkpoint, layer) AS int) AS lo
    FROM long)
  SELECT checkpoint, layer, metric, value, hi AS rank, 'highest' AS side FROM ranked WHERE hi <= 10
  UNION ALL SELECT checkpoint, layer, metric, value, lo, 'lowest' FROM ranked WHERE lo <= 10""",
  "metrics"))
def top_extremes(spark, folder):
    from ..session import durable

    return M.top_extremes(durable(V.metrics(spark, folder)), 10)


@query("metrics_report", with_views(f"""
  , halves AS (SELECT avg(m) FILTER (layer IN (0, 1, 2, 3)) AS early,
      avg(m) FILTER (layer IN (20, 21, 22, 23)) AS late FROM
      (SELECT layer, {half_even("avg(effective_rank)", 4)} AS m FROM metrics GROUP BY layer)),
  named AS (SELECT *, concat(checkpoint, '@', layer) AS arm FROM metrics)
  SELECT count(*) AS n_arms, count(DISTINCT checkpoint) AS n_checkpoints,
    count(DISTINCT layer) AS n_layers,
    arg_min(arm, (-effective_rank, checkpoint, layer)) AS max_rank_arm,
    arg_min(arm, (effective_rank, checkpoint, layer)) AS min_rank_arm,
    max(effective_rank) AS max_rank, min(effective_rank) AS min_rank,
    arg_min(arm, (-curvature, checkpoint, layer)) AS max_curvature_arm,
    arg_min(arm, (curvature, checkpoint, layer)) AS min_curvature_arm,
    (SELECT {r("early")} FROM halves) AS early_rank, (SELECT {r("late")} FROM halves) AS late_rank,
    (SELECT {r("early - late")} FROM halves) AS early_minus_late FROM named""",
  "metrics"))
def metrics_report(spark, folder):
    from ..session import durable

    table = M.report(durable(V.metrics(spark, folder)))
    return rounded(table, "early_rank", "late_rank", "early_minus_late")


@query("key_layer_ranks", with_views(f"""
  SELECT layer, {half_even("avg(effective_rank)", 4)} AS effective_rank_mean,
    {half_even("stddev_samp(effective_rank)", 4)} AS effective_rank_std,
    count(DISTINCT checkpoint) AS num_checkpoints FROM metrics
  WHERE layer IN (0, 1, 2, 3, 5, 10, 15, 20, 22, 23) GROUP BY layer""", "metrics"))  # fmt: skip
def key_layer_ranks(spark, folder):
    return M.key_layer_ranks(V.metrics(spark, folder))


@query("arm_json", with_views("""
  SELECT concat(revision, '_layer_', layer) AS "key", concat('{"checkpoint":"', revision,
    '","layer":', layer, ',"num_tasks":', count(*), '}') AS json
  FROM scores GROUP BY revision, layer""", "scores"))  # fmt: skip
def arm_json(spark, folder):
    counts = V.scores(spark, folder, once=True).groupBy("revision", "layer").agg(
        F.count(F.lit(1)).alias("num_tasks")
    )
    named = counts.withColumnRenamed("revision", "checkpoint")
    key = F.concat("checkpoint", F.lit("_layer_"), F.col("layer").cast("string"))
    return K.keyed_json(named, key, ["checkpoint", "layer", "num_tasks"])


@query("layer_json", with_views("""
  SELECT concat(revision, '_layer_', layer) AS "key", count(*) AS num_tasks, string_agg(task, ', ' ORDER BY task) AS tasks,
    string_agg(cast(cast(round(main_score * 1000000) AS bigint) AS varchar), ', ' ORDER BY task) AS micro_scores,
    round(avg(main_score) + 1e-10, 6) AS average_main_score
  FROM scores GROUP BY revision, layer""",
  "scores"))
def layer_json(spark, folder):
    rows = V.scores(spark, folder)
    averages = S.average_main_score(rows, G.task_dim(spark), ["revision", "layer"])
    written = K.layer_json(averages, rows)
    schema = "average_main_score double, num_tasks long, task_scores map<string,double>"
    back = F.from_json("json", schema)
    scores = F.array_sort(F.map_entries(back["task_scores"]))
    micro = F.transform(scores, lambda e: F.round(e["value"] * 1_000_000).cast("long").cast("string"))
    read = written.select(
        "key",
        back["num_tasks"].alias("num_tasks"),
        F.array_join(F.transform(scores, lambda e: e["key"]), ", ").alias("tasks"),
        F.array_join(micro, ", ").alias("micro_scores"),
        back["average_main_score"].alias("average_main_score"),
    )
    return rounded(read, "average_main_score")
