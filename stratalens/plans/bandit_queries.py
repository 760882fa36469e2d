"""Baselines, rewards and the bandit over score rows and logged pulls."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bandit as B
from ..operators import rewards as W
from ..operators import work as K
from ..session import shared_folder
from ..streaming.bandit_state import follow_pulls, read_state
from . import views as V
from .registry import query, rounded
from .registry import sql_round as r
from .views import with_views

_BASE = """base AS (SELECT task, layer, avg(main_score) AS baseline FROM scores
    WHERE revision = 'main' GROUP BY task, layer),
  stats AS (SELECT task, avg(baseline) AS mean, max(baseline) AS max, min(baseline) AS min,
    stddev_pop(baseline) AS s, count(*) AS n FROM base GROUP BY task)"""
_TASK = f"""{_BASE}, rewarded AS (SELECT revision, layer, task, main_score, CASE
    WHEN coalesce(baseline, mean) IS NULL THEN 0.0
    WHEN (CASE WHEN n > 1 THEN s ELSE 1.0 END) < 1e-10 THEN main_score - coalesce(baseline, mean)
    ELSE (main_score - coalesce(baseline, mean)) / (CASE WHEN n > 1 THEN s ELSE 1.0 END) END AS reward
  FROM scores LEFT JOIN base USING (task, layer) LEFT JOIN stats USING (task))"""


def _baseline(scores: DataFrame) -> DataFrame:
    return W.baseline_scores(scores, "main")


@query("baseline_scores", with_views(
    f", {_BASE} SELECT task, layer, {r('baseline')} AS baseline FROM base", "scores"))
def baseline_scores(spark, folder):
    return rounded(_baseline(V.scores(spark, folder, once=True)), "baseline")


_SOME = V.TASKS[::3]


@query("baseline_of_some", with_views(f"""SELECT task, layer, {r('avg(main_score)')} AS baseline FROM scores
  WHERE revision = 'step137000' AND layer IN (0, 5, 23) AND task IN ({", ".join(f"'{t}'" for t in _SOME)})
  GROUP BY task, layer""", "scores"))  # fmt: skip
def baseline_of_some(spark, folder):
    """Another checkpoint's, for the layers and tasks that are given."""
    scores = V.scores(spark, folder, once=True)
    return rounded(W.baseline_scores(scores, "step137000", layers=[0, 5, 23], tasks=_SOME), "baseline")


def _register_zscore(method: str) -> None:
    name = "zscore_reward" if method == "mean" else f"zscore_reward_{method}"
    sql = f""", {_BASE} SELECT revision, layer, task, main_score, {r(f'''CASE WHEN {method} IS NULL THEN 0.0
      WHEN s < 1e-10 THEN main_score - {method} ELSE (main_score - {method}) / s END''')} AS reward
      FROM scores LEFT JOIN stats USING (task)"""

    @query(name, with_views(sql, "scores"))
    def run(spark, folder):
        scores = V.scores(spark, folder)
        return rounded(W.zscore_reward(scores, _baseline(scores), method), "reward")


for _method in ("mean", "max", "min"):
    _register_zscore(_method)


@query("task_reward", with_views(
    f", {_TASK} SELECT revision, layer, task, main_score, {r('reward')} AS reward FROM rewarded",
    "scores"))
def task_reward(spark, folder):
    scores = V.scores(spark, folder)
    return rounded(W.task_reward(scores, _baseline(scores)), "reward")


def _register_aggregate(method: str, sql: str) -> None:
    name = "aggregate_rewards" if method == "mean" else f"aggregate_rewards_{method}"
    body = f""", {_TASK} SELECT revision, layer, {r(sql)} AS aggregated_reward, count(*) AS n_tasks
      FROM rewarded GROUP BY revision, layer"""

    @query(name, with_views(body, "scores"))
    def run(spark, folder):
        scores = V.scores(spark, folder)
        rewards = W.task_reward(scores, _baseline(scores))
        return rounded(W.aggregate_rewards(rewards, method=method), "aggregated_reward")


_register_aggregate("mean", "avg(reward)")
_register_aggregate(
    "harmonic_mean",
    "CASE WHEN max(reward) > 0 THEN count(*) FILTER (reward > 0) / "
    "sum(1 / reward) FILTER (reward > 0) ELSE avg(reward) END",
)
_register_aggregate("robust_mean", "median(reward)")

_CONTEXT_SQL = """contexts AS (SELECT revision, layer, round(avg(main_score) + 1e-10, 6) AS c1,
    round(coalesce(stddev_samp(main_score), 0) + 1e-10, 6) AS c2, min(main_score) AS c3,
    max(main_score) AS c4 FROM scores GROUP BY revision, layer)"""


def _features(scores: DataFrame) -> DataFrame:
    """Four features per arm."""
    score = F.col("main_score")
    rows = scores.groupBy("revision", "layer").agg(
        F.avg(score).alias("c1"),
        F.coalesce(F.stddev(score), F.lit(0.0)).alias("c2"),
        F.min(score).alias("c3"),
        F.max(score).alias("c4"),
    )
    return rounded(rows, "c1", "c2")


@query("context_features", with_views(f""", {_CONTEXT_SQL},
  arms AS (SELECT DISTINCT revision, layer FROM scores)
  SELECT revision, layer, coalesce(c1, 0) AS c1, coalesce(c2, 0) AS c2, coalesce(c3, 0) AS c3,
    coalesce(c4, 0) AS c4 FROM arms LEFT JOIN contexts USING (revision, layer)""", "scores"))  # fmt: skip
def context_features(spark, folder):
    scores = V.scores(spark, folder)
    arms = scores.select("revision", "layer").distinct()
    named = B.context_features(arms, _features(scores), names=["c1", "c2", "c3", "c4"])
    return named.select(
        "revision", "layer", *[F.get("context", F.lit(i)).alias(f"c{i + 1}") for i in range(4)]
    )


# Logged pulls with a context of whole numbers, so that sums are exact in any order.
_X = ["cast(1 AS double)", "cast(seq % 7 AS double)", "cast(user_id % 5 AS double)", "cast(seq % 3 AS double)"]
_SUMS = ", ".join(
    [f"sum({_X[i]} * {_X[j]}) AS a{i}{j}" for i in range(4) for j in range(i, 4)]
    + [f"sum(reward * {x}) AS b{i}" for i, x in enumerate(_X)]
)
_STATE = f"state AS (SELECT revision, layer, {_SUMS}, count(*) AS n FROM pulls GROUP BY revision, layer)"
_STATE_COLUMNS = ", ".join(
    [f"a{i}{j}{' + 1' if i == j else ''} AS a{i}{j}" for i in range(4) for j in range(i, 4)]
    + [f"b{i}" for i in range(4)]
)


def _history(spark, folder) -> DataFrame:
    return V.pulls(spark, folder).withColumn("context", F.array(*[F.expr(x) for x in _X]))


def _state_columns(state: DataFrame) -> DataFrame:
    cells = [
        F.get("a", F.lit(4 * i + j)).alias(f"a{i}{j}") for i in range(4) for j in range(i, 4)
    ]
    vector = [F.get("b", F.lit(i)).alias(f"b{i}") for i in range(4)]
    return state.select("revision", "layer", *cells, *vector, "n")


@query("linucb_state", with_views(
    f", {_STATE} SELECT revision, layer, {_STATE_COLUMNS}, n FROM state", "pulls"))
def linucb_state(spark, folder):
    return _state_columns(B.linucb_state(_history(spark, folder), 4))


@query("linucb_state_merged", with_views(
    f", {_STATE} SELECT revision, layer, {_STATE_COLUMNS}, n FROM state", "pulls"))
def linucb_state_merged(spark, folder):
    """The state after two batches, the second added to the first."""
    history = _history(spark, folder)
    early = F.col("user_id") % 2 == 0
    first = B.linucb_state(history.where(early), 4)
    return _state_columns(B.linucb_state(history.where(~early), 4, prior=first))


@query("linucb_state_stream", with_views(
    f", {_STATE} SELECT revision, layer, {_STATE_COLUMNS}, n FROM state", "pulls"))
def linucb_state_stream(spark, folder):
    """The state after a log that comes in three batches, the second one twice, each after a restart."""
    root = f"{shared_folder(spark)}/bandit-{uuid.uuid4().hex}"
    history = _history(spark, folder)
    for part in (0, 1, 1, 2):
        batch = history.where(F.col("user_id") % 3 == part)
        batch.write.mode("append").parquet(f"{root}/log")
        follow_pulls(spark, f"{root}/log", history.schema, f"{root}/table", f"{root}/stream", 4).awaitTermination()
    return _state_columns(read_state(spark, f"{root}/table"))


def _solve_sql(alpha: float) -> str:
    """UCB by a Cholesky factor: with L y = b and L z = x the score is y.z + alpha |z|."""
    steps, names = [], ["revision", "layer"]
    names += [f"a{i}{j}" for i in range(4) for j in range(i, 4)]
    names += [f"b{i}" for i in range(4)] + [f"x{i}" for i in range(4)]
    source = f"""SELECT revision, layer, {_STATE_COLUMNS}, c1 AS x0, c2 AS x1, c3 AS x2, c4 AS x3
      FROM state JOIN contexts USING (revision, layer)"""
    for i in range(4):
        square = "".join(f" - l{i}{k} * l{i}{k}" for k in range(i))
        source = f"SELECT *, sqrt(a{i}{i}{square}) AS l{i}{i} FROM ({source})"
        below = []
        for j in range(i + 1, 4):
            inner = "".join(f" - l{j}{k} * l{i}{k}" for k in range(i))
            below.append(f"(a{i}{j}{inner}) / l{i}{i} AS l{j}{i}")
        if below:
            source = f"SELECT *, {', '.join(below)} FROM ({source})"
        done_b = "".join(f" - l{i}{k} * y{k}" for k in range(i))
        done_x = "".join(f" - l{i}{k} * z{k}" for k in range(i))
        source = (
            f"SELECT *, (b{i}{done_b}) / l{i}{i} AS y{i}, (x{i}{done_x}) / l{i}{i} AS z{i} "
            f"FROM ({source})"
        )
    mean = " + ".join(f"y{i} * z{i}" for i in range(4))
    spread = " + ".join(f"z{i} * z{i}" for i in range(4))
    return f"SELECT revision, layer, {mean} + {alpha} * sqrt({spread}) AS ucb FROM ({source})"


_SCORED = f"""{_CONTEXT_SQL}, {_STATE}, arms AS (SELECT DISTINCT revision, layer FROM scores),
  solved AS ({_solve_sql(0.5)}),
  scored AS (SELECT revision, layer, CASE WHEN c1 IS NULL THEN 1e6
    ELSE coalesce(ucb, 0.5 * sqrt(c1 * c1 + c2 * c2 + c3 * c3 + c4 * c4)) END AS ucb
    FROM arms LEFT JOIN contexts USING (revision, layer) LEFT JOIN solved USING (revision, layer))"""


def _scored(spark, folder) -> DataFrame:
    scores = V.scores(spark, folder)
    arms = scores.select("revision", "layer").distinct()
    features = _features(scores).select(
        "revision", "layer", F.array("c1", "c2", "c3", "c4").alias("context")
    )
    state = B.linucb_state(_history(spark, folder), 4)
    return B.linucb_score(arms.join(features, ["revision", "layer"], "left"), state, 4, alpha=0.5)


@query("linucb_score", with_views(
    f", {_SCORED} SELECT revision, layer, {r('ucb')} AS ucb FROM scored", "scores", "pulls"))
def linucb_score(spark, folder):
    return rounded(_scored(spark, folder).drop("context"), "ucb")


@query("linucb_select", with_views(f""", {_SCORED} SELECT revision, layer, {r('ucb')} AS ucb
  FROM scored ORDER BY scored.ucb DESC, revision, layer LIMIT 1""", "scores", "pulls"))  # fmt: skip
def linucb_select(spark, folder):
    return rounded(B.select_arm(_scored(spark, folder)).drop("context"), "ucb")


_Q = "(1.0 + layer * layer + (layer % 5) * (layer % 5))"


@query("linucb_closed_form", with_views(f""", p AS (SELECT revision, layer, max({_Q}) AS q, count(*) AS m,
    sum(reward / 100) AS rr FROM pulls GROUP BY revision, layer)
  SELECT revision, layer, m AS n, {r("rr * q / (1 + m * q)")} AS mean_reward,
    {r("2 * sqrt(q / (1 + m * q))")} AS uncertainty,
    {r("rr * q / (1 + m * q) + 2 * sqrt(q / (1 + m * q))")} AS ucb FROM p""", "pulls"))  # fmt: skip
def linucb_closed_form(spark, folder):
    layer = F.col("layer").cast("double")
    history = V.pulls(spark, folder).select(
        "revision",
        "layer",
        (F.col("reward") / 100).alias("reward"),
        F.array(F.lit(1.0), layer, layer % 5).alias("context"),
    )
    return rounded(B.closed_form(history, alpha=2.0), "mean_reward", "uncertainty", "ucb")


@query("trajectory", with_views("""SELECT seq, revision, layer, reward,
    row_number() OVER (PARTITION BY revision, layer ORDER BY seq) AS "count" FROM pulls""",
  "pulls"))
def trajectory(spark, folder):
    return B.trajectory(V.pulls(spark, folder)).drop("user_id")


@query("best_arm", with_views(f"""SELECT revision, layer, {r("avg(reward)")} AS mean_reward,
    count(*) AS n, min(seq) AS first_seq FROM pulls GROUP BY revision, layer
  ORDER BY round(avg(reward), 12) DESC, min(seq) LIMIT 1""", "pulls"))  # fmt: skip
def best_arm(spark, folder):
    return rounded(B.best_arm(V.pulls(spark, folder)), "mean_reward")


_REPLAY = f"""{_TASK}, {_CONTEXT_SQL}, arms AS (SELECT DISTINCT revision, layer FROM scores),
  first AS (SELECT revision, layer, coalesce(0.5 * sqrt(c1 * c1 + c2 * c2 + c3 * c3 + c4 * c4), 1e6) AS u
    FROM arms LEFT JOIN contexts USING (revision, layer)),
  chosen AS (SELECT revision, layer, u AS ucb, cast(row_number() OVER
    (ORDER BY round(u, 12) DESC, revision, layer) AS int) AS seq FROM first QUALIFY seq <= 60),
  replayed AS (SELECT revision, layer, any_value(seq) AS seq, any_value(ucb) AS ucb,
    avg(reward) AS aggregated_reward, count(reward) AS n_tasks
    FROM chosen LEFT JOIN rewarded USING (revision, layer) GROUP BY revision, layer)"""


def _replayed(spark, folder, scores: DataFrame | None = None) -> DataFrame:
    scores = V.scores(spark, folder) if scores is None else scores
    arms = scores.select("revision", "layer").distinct()
    features = _features(scores).select(
        "revision", "layer", F.array("c1", "c2", "c3", "c4").alias("context")
    )
    contexts = arms.join(features, ["revision", "layer"], "left")
    return B.replay(contexts, scores, _baseline(scores), budget=60, alpha=0.5)


@query("bandit_replay", with_views(f""", {_REPLAY} SELECT revision, layer, seq, {r("ucb")} AS ucb,
  {r("aggregated_reward")} AS aggregated_reward, n_tasks FROM replayed""", "scores"))  # fmt: skip
def bandit_replay(spark, folder):
    return rounded(_replayed(spark, folder), "ucb", "aggregated_reward")


@query("final_result", with_views(f""", {_REPLAY} SELECT
  arg_max(revision, (round(aggregated_reward, 12), -seq)) AS best_revision,
  arg_max(layer, (round(aggregated_reward, 12), -seq)) AS best_layer,
  count(aggregated_reward) AS trajectory_length, count(*) AS arms_evaluated, count(*) AS budget_used
  FROM replayed""", "scores"))  # fmt: skip
def final_result(spark, folder):
    return B.final_result(_replayed(spark, folder))


@query("bandit_progress", with_views(f""", {_REPLAY} SELECT '2024-01-01 00:00:00' AS "timestamp",
  '410m' AS model_size, revision AS arm_checkpoint, layer AS arm_layer, task, main_score AS raw_score,
  {r("reward")} AS reward, {r("aggregated_reward")} AS aggregated_reward, 'ok' AS status
  FROM rewarded JOIN replayed USING (revision, layer)""", "scores"))  # fmt: skip
def bandit_progress(spark, folder):
    scores = V.scores(spark, folder)
    pulls = _replayed(spark, folder, scores)
    log = B.progress(pulls, scores, _baseline(scores), "410m", F.lit("2024-01-01 00:00:00"))
    return rounded(log, "reward", "aggregated_reward")


# ---- model sizes kept apart -----------------------------------------------------------------

_SIZED_SQL = """sized AS (SELECT concat(CASE WHEN l % 2 = 0 THEN '70' ELSE '410' END, 'm') AS model_size, revision,
    layer, task, main_score * CASE WHEN l % 2 = 0 THEN 1 ELSE 2 END AS main_score FROM
    (SELECT *, unnest([0, 1]) AS l FROM scores))"""
_SIZED_BASE = f"""{_SIZED_SQL}, base AS (SELECT model_size, task, layer, avg(main_score) AS baseline FROM sized
    WHERE revision = 'main' GROUP BY ALL),
  stats AS (SELECT model_size, task, avg(baseline) AS mean, stddev_pop(baseline) AS s, count(*) AS n
    FROM base GROUP BY ALL),
  rewarded AS (SELECT model_size, revision, layer, task, main_score, CASE
    WHEN coalesce(baseline, mean) IS NULL THEN 0.0
    WHEN (CASE WHEN n > 1 THEN s ELSE 1.0 END) < 1e-10 THEN main_score - coalesce(baseline, mean)
    ELSE (main_score - coalesce(baseline, mean)) / (CASE WHEN n > 1 THEN s ELSE 1.0 END) END AS reward
  FROM sized LEFT JOIN base USING (model_size, task, layer) LEFT JOIN stats USING (model_size, task))"""


def _sized(spark, folder) -> DataFrame:
    """The scores of two model sizes, the larger one twice as good."""
    sizes = F.explode(F.map_from_arrays(F.lit(["70m", "410m"]), F.lit([1.0, 2.0]))).alias("model_size", "k")
    rows = V.scores(spark, folder).select("*", sizes)
    return rows.withColumn("main_score", F.col("main_score") * F.col("k")).drop("k")


@query("baseline_scores_by_size", with_views(
    f", {_SIZED_BASE} SELECT model_size, task, layer, {r('baseline')} AS baseline FROM base", "scores"))
def baseline_scores_by_size(spark, folder):
    return rounded(_baseline(_sized(spark, folder)), "baseline")


@query("reward_by_size", with_views(f""", {_SIZED_BASE}
  SELECT model_size, revision, layer, {r('avg(reward)')} AS aggregated_reward, count(reward) AS n_tasks
  FROM rewarded GROUP BY model_size, revision, layer""", "scores"))  # fmt: skip
def reward_by_size(spark, folder):
    scores = _sized(spark, folder)
    return rounded(W.aggregate_rewards(W.task_reward(scores, _baseline(scores))), "aggregated_reward")


@query("arms_left", with_views(f""", {_SIZED_SQL}, arms AS (SELECT DISTINCT model_size, revision, layer FROM sized)
  SELECT * FROM arms WHERE NOT (model_size = '70m' AND layer % 3 = 0)""", "scores"))  # fmt: skip
def arms_left(spark, folder):
    """Arms not in the log of an earlier replay, which got to every third layer of the small model."""
    arms = _sized(spark, folder).select(*W.arm_keys(_sized(spark, folder))).distinct()
    log = _sized(spark, folder).where("model_size = '70m' AND layer % 3 = 0")
    return K.arms_left(arms, log, W.arm_keys(arms))


@query("arm_model_size", with_views(f""", {_SIZED_SQL}, sizes AS (SELECT DISTINCT revision, layer, model_size
    FROM sized WHERE layer % 2 = 0 AND model_size = '410m')
  SELECT a.revision, a.layer, model_size FROM (SELECT DISTINCT revision, layer FROM scores) a
  LEFT JOIN sizes s ON a.revision = s.revision AND a.layer = s.layer""", "scores"))  # fmt: skip
def arm_model_size(spark, folder):
    """Arms of a log without sizes get those of the score table; odd layers are not in it."""
    arms = V.scores(spark, folder).select("revision", "layer").distinct()
    sizes = _sized(spark, folder).where("layer % 2 = 0 AND model_size = '410m'")
    return K.with_model_size(arms, sizes, ["revision", "layer"])
