"""Writers, caches, and the progress log as a stream."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stratalens.operators import bandit as B
from stratalens.operators import score_tables as S
from stratalens.sources import sinks as K
from stratalens.sources import tables as T
from stratalens.streaming import progress as P

DDL = "revision string, layer int, task string, main_score double, all_scores string"


@pytest.fixture
def scores(spark):
    rows = [
        ("main", 0, "STS12", 0.5, '{"test": {"note": "a, \\"b\\"\n"}}'),
        ("main", 1, "a/b c", None, None),
    ]
    return spark.createDataFrame(rows, DDL)


def test_csv_round_trip_with_json_text(spark, scores, tmp_path):
    path = str(tmp_path / "scores")
    K.write_csv(scores, path)
    back = T.read_scores(spark, path, DDL)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, scores.collect()), key=str)


def test_append_keeps_what_is_there(spark, scores, tmp_path):
    path = str(tmp_path / "log")
    K.append_csv(scores, path)
    K.append_csv(scores, path)
    assert T.read_scores(spark, path, DDL).count() == 4


def test_json_and_keyed_json(spark, scores, tmp_path):
    K.write_json(scores, str(tmp_path / "rows"))
    assert spark.read.json(str(tmp_path / "rows")).count() == 2
    key = F.concat_ws("_layer_", "revision", F.col("layer").cast("string"))
    entries = K.keyed_json(scores.drop("all_scores"), key, ["revision", "layer", "main_score"])
    K.write_keyed_json(entries, str(tmp_path / "keyed"))
    merged = {}
    for part in (tmp_path / "keyed").glob("part-*"):
        for line in part.read_text().splitlines():
            merged.update(json.loads(line))
    assert merged["main_layer_0"] == {"revision": "main", "layer": 0, "main_score": 0.5}
    assert set(merged) == {"main_layer_0", "main_layer_1"}


def test_layer_json_holds_the_task_map(spark, scores):
    tasks = spark.createDataFrame([("STS12",)], "task string")
    rows = scores.where("main_score IS NOT NULL")
    found = K.layer_json(S.average_main_score(rows, tasks), rows).collect()
    assert [(r.key, json.loads(r.json)) for r in found] == [
        ("0", {"average_main_score": 0.5, "num_tasks": 1, "expected_tasks": 1, "task_scores": {"STS12": 0.5}})
    ]


def test_layer_json_of_several_sizes_and_revisions(spark):
    rows = [(size, rev, layer, task, 0.25 * layer + 0.5 * (rev == "b"))
            for size in ("1b", "2b") for rev in ("a", "b") for layer in (0, 1) for task in ("t", "u")]
    rows.append(("1b", "a", 0, "t", -1.0))
    frame = spark.createDataFrame(
        rows, "model_size string, revision string, layer int, task string, main_score double"
    )
    tasks = spark.createDataFrame([("t",), ("u",)], "task string")
    averages = S.average_main_score(frame, tasks, ["model_size", "revision", "layer"])
    found = {r.key: json.loads(r.json) for r in K.layer_json(averages, frame).collect()}
    assert set(found) == {f"{m}_{r}_layer_{i}" for m in ("1b", "2b") for r in "ab" for i in (0, 1)}
    assert found["2b_b_layer_1"]["task_scores"] == {"t": 0.75, "u": 0.75}
    assert found["1b_a_layer_0"]["task_scores"] == {"t": 0.0, "u": 0.0}


def test_arm_cache_is_pruned_by_arm(spark, tmp_path):
    path = str(tmp_path / "cache")
    frame = spark.createDataFrame(
        [("70m", "main", layer, 10 * layer + i, [float(i)] * 3) for layer in range(3) for i in range(4)],
        "model_size string, revision string, layer int, row_id long, embedding array<float>",
    )
    K.write_arms(frame, path)
    one = T.read_arms(spark, path, model_size="70m", revision="main", layer=2)
    assert sorted(r.row_id for r in one.collect()) == [20, 21, 22, 23]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "layer" in plan.split("PartitionFilters")[1]


def test_arms_without_cached_metrics_stay(spark, tmp_path):
    path = str(tmp_path / "metrics")
    K.write_arms(spark.createDataFrame([("main", 0, 2.5)], "revision string, layer int, curvature double"), path)
    arms = spark.createDataFrame([("main", 0), ("main", 1)], "revision string, layer int")
    found = T.with_cached_metrics(arms, T.read_arms(spark, path), ["revision", "layer"])
    assert sorted((r.layer, r.curvature) for r in found.collect()) == [(0, 2.5), (1, None)]


def test_one_directory_per_task(spark, scores, tmp_path):
    K.write_task_tables(scores.drop("all_scores"), str(tmp_path / "tasks"))
    names = sorted(p.name for p in Path(tmp_path / "tasks").glob("task_safe=*"))
    assert names == ["task_safe=STS12", "task_safe=a_b_c"]


def test_bandit_state_round_trip(spark, tmp_path):
    history = spark.createDataFrame(
        [("step1", 3, 0.5, [1.0, 2.0]), ("main", 0, 1.0, [0.0, 1.0])],
        "revision string, layer int, reward double, context array<double>",
    )
    state = B.linucb_state(history, 2)
    K.save_bandit_state(state, str(tmp_path / "state"))
    back = K.load_bandit_state(spark, str(tmp_path / "state")).select(*state.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, state.collect()))
    grown = B.linucb_state(history, 2, prior=back)
    assert {r.n for r in grown.collect()} == {2}


def test_progress_log_is_followed_once_per_row(spark, tmp_path):
    log, out, checkpoint = (str(tmp_path / n) for n in ("log", "out", "checkpoint"))
    ddl = "timestamp string, model_size string, revision string, layer string, task string, status string, elapsed_sec double, output_dir string, error string"

    def rows(*layers):
        data = [("2024-01-02 03:04:05", "70m", "main", str(i), "A", "ok", 1.23456, "/x", None) for i in layers]
        return spark.createDataFrame(data, ddl)

    K.append_csv(rows(0, 1), log)
    P.follow(spark, log, out, checkpoint).awaitTermination(60)
    K.append_csv(rows(2), log)
    P.follow(spark, log, out, checkpoint).awaitTermination(60)
    P.follow(spark, log, out, checkpoint).awaitTermination(60)
    found = spark.read.parquet(out)
    assert sorted(r.layer for r in found.collect()) == ["0", "1", "2"]
    first = found.first()
    assert first.elapsed_sec == 1.235 and first.timestamp.year == 2024
    assert T.completed_pairs(found).count() == 3
