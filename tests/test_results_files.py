"""Score tables from a tree of result files."""

import json

import pytest

from stratalens.sources import results as P
from stratalens.sources import tables as T


def write(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")


def result(score, **extra):
    return {"scores": {"test": [{"main_score": score}]}, **extra}


@pytest.fixture
def run(tmp_path):
    base = tmp_path / "outputs" / "mteb" / "Pythia" / "410m" / "step1000" / "layer_003"
    cache = "no_model_name_available/no_revision_available"
    results = "results/EleutherAI__pythia-410m/step1000"

    def unit(task, marker=None):
        folder = base / task
        write(folder / "done.json", {"task": task} if marker is None else marker)
        return folder

    both = unit("STS12")
    write(both / cache / "STS12.json", result(0.1))
    write(both / "STS12.json", result(0.2))
    write(both / results / "STS12.json", result(0.3, task_name="named", mteb_version="1.2"))
    write(both / results / "model_meta.json", result(0.9))
    write(both / results / "other.json", result(0.8))

    direct = unit("STS13")
    write(direct / cache / "STS13.json", "{bad")
    write(direct / "STS13.json", result(0.4))

    legacy = unit("STS14", marker="{bad")
    write(legacy / "mteb_return.json", [{"odd": {"spearman": 0.5}}])

    unit("STS15")

    broken = unit("STS16")
    write(broken / results / "STS16.json", "{bad")
    write(broken / "STS16.json", result(0.6))

    write(base / "NoMarker" / results / "NoMarker.json", result(0.7))
    write(base / "NoMarkerDirect" / "NoMarkerDirect.json", result(0.7))

    write(
        tmp_path / "outputs" / "flat" / "done.json",
        {"model_size": "14m", "revision": "main", "layer": 2, "task": "X"},
    )
    return tmp_path


def test_collect_takes_the_first_place_that_yields(spark, run):
    rows = P.collect_results(P.read_documents(spark, str(run))).collect()
    found = {r.task: (r.model_size, r.revision, r.layer, r.score) for r in rows}
    unit = ("410m", "step1000", 3)
    assert found == {
        "STS12": (*unit, 0.1),
        "STS13": (*unit, 0.4),
        "STS14": (*unit, 0.5),
        "STS15": (*unit, None),
        "STS16": (*unit, 0.6),
        "X": ("14m", "main", 2, None),
    }
    assert all(r.output_dir.startswith("file:") for r in rows)


def test_one_place_order_serves_other_readers(spark, run):
    rows = P.collect_results(P.read_documents(spark, str(run)), P.REPLAY_ORDER).collect()
    assert {r.task: r.score for r in rows}["STS12"] == 0.3


def test_result_files_are_named_after_their_task(spark, run):
    rows = P.result_files(P.read_documents(spark, str(run))).collect()
    assert sorted(r.task for r in rows) == ["NoMarker", "STS12", "STS16"]


def test_extract_prefers_results_and_falls_back_next_to_markers(spark, run):
    rows = P.extract_scores(P.read_documents(spark, str(run))).collect()
    found = {r.task: r for r in rows}
    # STS16's own result file is broken, so it has no row; NoMarkerDirect has no marker
    assert sorted(found) == ["NoMarker", "STS12", "STS13"]
    first = found["STS12"]
    assert first.main_score == 0.3 and first.task_name == "named" and first.mteb_version == "1.2"
    assert first.output_dir.endswith("STS12/results")
    assert json.loads(first.all_scores) == {"test": {"main_score": 0.3}}
    assert found["STS13"].main_score == 0.4 and found["STS13"].task_name == "STS13"
    assert found["STS13"].evaluation_time == ""


def test_first_path_wins_for_the_same_unit(spark, tmp_path):
    for root, score in (("b", 0.2), ("a", 0.1)):
        unit = tmp_path / root / "outputs/mteb/Pythia/70m/main/layer_000/T"
        write(unit / "results/M/main/T.json", result(score))
    rows = P.extract_scores(P.read_documents(spark, str(tmp_path))).collect()
    assert [r.main_score for r in rows] == [0.1]


def test_merge_chunks_last_file_wins(spark, tmp_path):
    record = {"checkpoint": "main", "layer": 1}
    write(tmp_path / "computed_metrics_chunk_00.json", {"main_layer_1": {**record, "curvature": 1.0}})
    write(tmp_path / "computed_metrics_chunk_01.json", {"main_layer_1": {**record, "curvature": 2.0}})
    write(tmp_path / "other.json", {"main_layer_9": record})
    rows = T.merge_chunks(T.read_metric_chunks(spark, str(tmp_path))).collect()
    assert [(r.key, r.layer, r.curvature) for r in rows] == [("main_layer_1", 1, 2.0)]


def test_completed_pairs_of_all_shards(spark, tmp_path):
    header = "timestamp,model_size,revision,layer,task,status,elapsed_sec,output_dir,error\n"
    rows = [
        "2024-01-02 03:04:05,70m,step1,3,A,ok,1.5,/x,\n2024-01-02 03:04:05,70m,step1,3,B,failed,1,/x,\"a, b\"\n",
        "2024-01-02 03:04:05,70m,step2,x,A,ok,1,/x,\n2024-01-02 03:04:05,70m,step2,4,A,failed,1,/x,\n",
    ]
    for i, text in enumerate(rows):
        (tmp_path / f"progress_shard{i}.csv").write_text(header + text)
    (tmp_path / "progress.csv").write_text(header + "2024-01-02 03:04:05,70m,main,1,A,ok,1,/x,\n")
    log = T.read_progress(spark, str(tmp_path))
    assert log.count() == 4
    pairs = {tuple(r) for r in T.completed_pairs(log).collect()}
    assert pairs == {("step1", 3), ("step2", 4)}
    assert {tuple(r) for r in T.completed_pairs(log, "ok").collect()} == {("step1", 3)}


def test_queue_log(spark, tmp_path):
    from stratalens.operators import work as W

    lines = [
        {"model_size": "70m", "checkpoint": "main", "layer": i, "status": s}
        for i, s in enumerate(["pending", "pending", "failed"])
    ]
    (tmp_path / "queue.jsonl").write_text("\n".join(json.dumps(x) for x in lines))
    counts = W.status_counts(T.read_queue(spark, str(tmp_path / "queue.jsonl"))).collect()
    assert {r.status: r.n for r in counts} == {
        "pending": 2, "processing": 0, "completed": 0, "failed": 1,
    }


def test_bandit_log(spark, tmp_path):
    from stratalens.schemas import BANDIT_PROGRESS

    header = "timestamp,model_size,arm_checkpoint,arm_layer,task,raw_score,reward,aggregated_reward,status\n"
    line = "2024-01-02 03:04:05,70m,step1,3,STS12,0.5,-1.25,0.75,ok\n"
    (tmp_path / "bandit_progress.csv").write_text(header + line)
    log = T.read_progress(spark, str(tmp_path), "bandit_progress.csv", BANDIT_PROGRESS)
    row = log.first()
    assert (row.arm_checkpoint, row.arm_layer, row.raw_score, row.reward) == ("step1", 3, 0.5, -1.25)


def test_nan_keeps_its_unit_and_does_not_get_in(spark, tmp_path):
    from stratalens.functions import scores as S
    from stratalens.sources import tables

    texts = ['{"a": NaN, "scores": {"test": [{"main_score": 0.5}]}}', "{bad", "[1, NaN]", "", None, "3"]
    frame = spark.createDataFrame([(t,) for t in texts], "content string")
    found = [r[0] for r in frame.select(S.is_document(frame.content)).collect()]
    assert [bool(f) for f in found] == [True, False, True, False, False, True]
    write(tmp_path / "chunks" / "computed_metrics_chunk_00.json", {"main_layer_1": {"curvature": float("nan")}})
    chunks = tables.read_metric_chunks(spark, str(tmp_path / "chunks"))
    assert tables.merge_chunks(chunks).first().curvature is None
    (tmp_path / "s.csv").write_text("x,y\n1.5,NaN\nNaN,b\n")
    rows = tables.read_scores(spark, str(tmp_path / "s.csv"), "x double, y double").collect()
    assert [tuple(r) for r in rows] == [(1.5, None), (None, None)]
    path = str(tmp_path / "arms")
    spark.createDataFrame([(float("nan"),)], "curvature double").write.parquet(path)
    assert tables.read_arms(spark, path).first().curvature is None
