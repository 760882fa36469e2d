"""Rewards, and the bandit against a plain loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.operators import bandit as B
from stratalens.operators import rewards as W

SCORES = "model_size string, revision string, layer int, task string, main_score double"


@pytest.fixture
def scores(spark, rng):
    rows = []
    for revision in "main", "step1", "step2":
        for layer in range(3):
            for task in "a", "b", "flat":
                score = 0.5 if task == "flat" else round(float(rng.uniform(0.1, 0.9)), 3)
                rows.append(("70m", revision, layer, task, score))
    rows += [("70m", "step1", 0, "unknown", 0.4), ("70m", "step1", 9, "a", 0.6)]
    rows += [("70m", "main", 2, "single", 0.3), ("70m", "step1", 2, "single", 0.8)]
    rows += [("70m", "main", 1, "a", None), ("14m", "main", 0, "a", 99.0)]
    return spark.createDataFrame(rows, SCORES)


@pytest.fixture
def baseline(scores):
    return W.baseline_scores(scores, "main", "70m")


def table(baseline):
    found = {}
    for r in baseline.collect():
        found.setdefault(r.task, {})[r.layer] = r.baseline
    return found


def test_no_layers_means_all_layers(scores, baseline):
    every = table(baseline)
    assert {t: len(v) for t, v in every.items()} == {"a": 3, "b": 3, "flat": 3, "single": 1}
    assert table(W.baseline_scores(scores, "main", "70m", layers=[])) == every
    some = table(W.baseline_scores(scores, "main", "70m", layers=[0], tasks=["a"]))
    assert some == {"a": {0: every["a"][0]}}


@pytest.mark.parametrize("method, centre", [("mean", np.mean), ("max", np.max), ("min", np.min)])
def test_zscore(scores, baseline, method, centre):
    base = table(baseline)
    for r in W.zscore_reward(scores.where("revision = 'step1'"), baseline, method).collect():
        values = list(base.get(r.task, {}).values())
        if not values:
            assert r.reward == 0.0
            continue
        spread = np.std(values)
        if method != "mean" and len(values) == 1:
            spread = 1.0
        diff = r.main_score - centre(values)
        assert r.reward == pytest.approx(diff if spread < 1e-10 else diff / spread)
    with pytest.raises(ValueError):
        W.zscore_reward(scores, baseline, "odd")


def test_task_reward(scores, baseline):
    base = table(baseline)
    for r in W.task_reward(scores.where("revision = 'step1'"), baseline).collect():
        own = base.get(r.task)
        if own is None:
            assert r.reward == 0.0
            continue
        values = list(own.values())
        centre = own.get(r.layer, np.mean(values))
        spread = np.std(values) if len(values) > 1 else 1.0
        diff = r.main_score - centre
        assert r.reward == pytest.approx(diff if spread < 1e-10 else diff / spread)


def test_aggregation(spark):
    rows = [("x", 0, v) for v in (0.5, -1.0, 2.0, 0.25)] + [("y", 0, -1.0), ("y", 0, -2.0)]
    rewards = spark.createDataFrame(rows, "revision string, layer int, reward double")
    expected = {
        "mean": (0.4375, -1.5),
        "harmonic_mean": (3 / (2 + 0.5 + 4), -1.5),
        "robust_mean": (0.375, -1.5),
    }
    for method, values in expected.items():
        found = {r.revision: r for r in W.aggregate_rewards(rewards, method=method).collect()}
        assert (found["x"].aggregated_reward, found["y"].aggregated_reward) == pytest.approx(values)
        assert found["x"].n_tasks == 4
    with pytest.raises(ValueError):
        W.aggregate_rewards(rewards, method="odd")


@pytest.fixture
def pulls(spark, rng):
    """Logged pulls, half of them of one arm."""
    arms = [("hot", 0)] * 3 + [("a", 1), ("a", 2), ("main", 0)]
    rows = []
    for seq in range(300):
        revision, layer = arms[rng.integers(len(arms))]
        rows.append((seq, revision, layer, float(rng.normal()), [float(v) for v in rng.normal(size=4)]))
    ddl = "seq long, revision string, layer int, reward double, context array<double>"
    return rows, spark.createDataFrame(rows, ddl).repartition(5)


def loop_state(rows):
    state = {}
    for _, revision, layer, reward, x in rows:
        a, b, n = state.get((revision, layer), (np.eye(4), np.zeros(4), 0))
        x = np.asarray(x)
        state[revision, layer] = a + np.outer(x, x), b + reward * x, n + 1
    return state


def assert_state(found, expected):
    assert len(found) == len(expected)
    for r in found:
        a, b, n = expected[r.revision, r.layer]
        np.testing.assert_allclose(np.reshape(r.a, (4, 4)), a, rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(r.b, b, rtol=1e-9, atol=1e-9)
        assert r.n == n


def test_state_is_a_sum_and_batches_add_up(pulls):
    rows, frame = pulls
    assert_state(B.linucb_state(frame, 4).collect(), loop_state(rows))
    early = B.linucb_state(frame.where("seq < 40"), 4)
    both = B.linucb_state(frame.where("seq >= 40"), 4, prior=early)
    assert_state(both.collect(), loop_state(rows))


def test_score_and_selection(spark, pulls):
    rows, frame = pulls
    context = [0.5, -1.0, 2.0, 0.1]
    arms = [("hot", 0, context), ("a", 1, context), ("new", 5, context), ("blind", 1, None), ("blind", 0, None)]
    frame_arms = spark.createDataFrame(arms, "revision string, layer int, context array<double>")
    scored = B.linucb_score(frame_arms, B.linucb_state(frame, 4), 4, alpha=0.7)
    found = {(r.revision, r.layer): r.ucb for r in scored.collect()}
    x, state = np.asarray(context), loop_state(rows)
    for arm in ("hot", 0), ("a", 1), ("new", 5):
        a, b, _ = state.get(arm, (np.eye(4), np.zeros(4), 0))
        inverse = np.linalg.inv(a)
        assert found[arm] == pytest.approx(x @ inverse @ b + 0.7 * np.sqrt(x @ inverse @ x))
    assert found["blind", 0] == 1e6
    best = B.select_arm(scored).first()
    assert (best.revision, best.layer) == ("blind", 0)
    seen = B.select_arm(scored.where("context IS NOT NULL")).first()
    known = {k: v for k, v in found.items() if k[0] != "blind"}
    assert (seen.revision, seen.layer) == max(known, key=known.get)


def test_wrong_context_width_is_an_error(spark, pulls):
    frame = pulls[1]
    with pytest.raises(Exception, match="context dimension is not 3"):
        B.linucb_state(frame, 3).collect()
    with pytest.raises(ValueError):
        B.linucb_state(frame, 0)


def test_closed_form_equals_the_general_score(spark, pulls):
    constant = F.array(F.lit(1.0), F.col("layer") + 0.5, F.lit(0.0), F.lit(2.0))
    history = pulls[1].withColumn("context", constant)
    arms = history.select("revision", "layer", "context").distinct()
    general = B.linucb_score(arms, B.linucb_state(history, 4), 4, alpha=1.5)
    closed = {(r.revision, r.layer): r.ucb for r in B.closed_form(history, 1.5).collect()}
    for r in general.collect():
        assert closed[r.revision, r.layer] == pytest.approx(r.ucb)


def test_trajectory_and_best_arm(spark, pulls):
    rows, frame = pulls
    counts, expected = {}, []
    for seq, revision, layer, *_ in rows:
        counts[revision, layer] = counts.get((revision, layer), 0) + 1
        expected.append((seq, counts[revision, layer]))
    found = B.trajectory(frame).collect()
    assert sorted((r.seq, r["count"]) for r in found) == expected
    rewards = {}
    for _, revision, layer, reward, _ in rows:
        rewards.setdefault((revision, layer), []).append(reward)
    best = B.best_arm(frame).first()
    assert (best.revision, best.layer) == max(rewards, key=lambda k: np.mean(rewards[k]))
    ties = [(5, "b", 0, 1.0), (3, "c", 0, 1.0), (9, "a", 0, 0.5)]
    tied = spark.createDataFrame(ties, "seq long, revision string, layer int, reward double")
    assert B.best_arm(tied).first().revision == "c"


def replay_loop(contexts, scores, base, budget, alpha):
    """The bandit loop as it is written down: select, score, reward, update."""
    order, history, available = [], [], sorted(contexts)
    while budget > 0 and available:
        def ucb(arm):
            x = contexts[arm]
            return 1e6 if x is None else alpha * np.sqrt(np.dot(x, x))

        arm = max(available, key=ucb)
        available.remove(arm)
        budget -= 1
        rewards = []
        for task, score in scores.get(arm, []):
            own = base.get(task)
            if own is None:
                rewards.append(0.0)
                continue
            values = list(own.values())
            spread = np.std(values) if len(values) > 1 else 1.0
            diff = score - own.get(arm[1], np.mean(values))
            rewards.append(diff if spread < 1e-10 else diff / spread)
        order.append((arm, float(np.mean(rewards)) if rewards else None))
    return order


@pytest.mark.parametrize("budget", [1, 4, 50])
def test_replay_equals_the_loop(spark, scores, baseline, rng, budget):
    kept = scores.where("model_size = '70m'")
    contexts = {
        (revision, layer): [float(v) for v in rng.uniform(0, 1, 4)]
        for revision in ("main", "step1", "step2", "step3") for layer in range(3)
    }
    contexts["step2", 1] = None
    by_arm = {}
    for r in kept.collect():
        if r.main_score is not None:
            by_arm.setdefault((r.revision, r.layer), []).append((r.task, r.main_score))
    expected = replay_loop(contexts, by_arm, table(baseline), budget, 0.5)
    frame = spark.createDataFrame(
        [(*arm, x) for arm, x in contexts.items()],
        "revision string, layer int, context array<double>",
    )
    pulls = B.replay(frame, kept, baseline, budget, alpha=0.5)
    found = pulls.orderBy("seq").collect()
    assert [(r.revision, r.layer) for r in found] == [arm for arm, _ in expected]
    for r, (_, reward) in zip(found, expected):
        if reward is None:
            assert r.aggregated_reward is None and r.n_tasks == 0
        else:
            assert r.aggregated_reward == pytest.approx(reward)
    result = B.final_result(pulls).first()
    rewarded = [(arm, reward) for arm, reward in expected if reward is not None]
    assert result.arms_evaluated == result.budget_used == len(expected)
    assert result.trajectory_length == len(rewarded)
    if rewarded:
        best = max(rewarded, key=lambda p: round(p[1], 12))[0]
        assert (result.best_revision, result.best_layer) == best


def test_context_features_default_to_zero(spark):
    arms = spark.createDataFrame([("a", 0), ("b", 1)], "revision string, layer int")
    metrics = spark.createDataFrame(
        [("a", 0, 1.0, None, 3.0, 4.0)],
        "revision string, layer int, prompt_entropy double, dataset_entropy double, "
        "curvature double, effective_rank double",
    )
    found = {r.revision: r.context for r in B.context_features(arms, metrics).collect()}
    assert found == {"a": [1.0, 0.0, 3.0, 4.0], "b": [0.0] * 4}


def test_model_sizes_are_kept_apart(spark):
    rows = [(s, rev, 0, "t", x) for s, x in (("70m", 0.2), ("410m", 0.8)) for rev in ("main", "step1")]
    frame = spark.createDataFrame(rows, "model_size string, revision string, layer int, task string, main_score double")
    base = W.baseline_scores(frame)
    assert {(r.model_size, r.baseline) for r in base.collect()} == {("70m", 0.2), ("410m", 0.8)}
    rewards = W.aggregate_rewards(W.task_reward(frame, base)).collect()
    assert len(rewards) == 4 and all(r.aggregated_reward == 0.0 for r in rewards)
    assert W.zscore_reward(frame, base).where("reward <> 0").count() == 0
    # a baseline without sizes serves all of them
    assert W.task_reward(frame, base.where("model_size = '70m'").drop("model_size")).count() == 4
