"""Checkpoint names, layers, shards and grids."""

import zlib

import pytest
from pyspark.sql import functions as F

from stratalens.functions import revisions as R
from stratalens.operators import work as W
from stratalens.sources import grids as G


def frame(spark, values, name="x"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_revision_order(spark):
    names = ["main", "dev", "step10", "step9", "step-11", "stepx", "step0"]
    rows = frame(spark, names).orderBy(*R.revision_order(F.col("x"))).collect()
    assert [r.x for r in rows] == ["step0", "step9", "step10", "step-11", "main", "dev", "stepx"]


def test_checkpoint_names(spark):
    names = ["main", "step10", "step", "step-1", "xstep1", "step1x", "mainline"]
    kept = frame(spark, names).where(R.is_checkpoint(F.col("x"))).collect()
    assert [r.x for r in kept] == ["main", "step10"]


@pytest.mark.parametrize(
    "spec, n, expected",
    [("all", 3, [0, 1, 2]), ("0, 5,,7 ", 3, [0, 5, 7]), ("4", 6, [4]), ("", 2, [])],
)
def test_layer_spec(spark, spec, n, expected):
    row = frame(spark, [spec]).select(R.layers_of(F.col("x"), F.lit(n)).alias("l")).first()
    assert row.l == expected


def test_task_bucket_is_adler32(spark):
    names = ["STS12", "", "Ünï – 漢字", "a" * 400, "SICK-R"]
    rows = frame(spark, names).select("x", R.task_bucket(F.col("x"), 1 << 31).alias("b")).collect()
    for r in rows:
        assert r.b == zlib.adler32(r.x.encode()) % (1 << 31)


def test_shards_cover_every_task_once(spark):
    tasks = frame(spark, G.TASKS, "task")
    shards = [W.shard(tasks, 4, i) for i in range(4)]
    found = [r.task for s in shards for r in s.collect()]
    assert sorted(found) == sorted(G.TASKS)
    meta = W.shard_meta(tasks, 4).collect()
    assert sum(r.num_tasks_this_shard for r in meta) == 32
    assert {r.num_tasks_total for r in meta} == {32}
    with pytest.raises(ValueError):
        W.shard(tasks, 4, 4)


def test_paths_and_ids(spark):
    path = "/run/outputs/mteb/Pythia/410m/step1/layer_007/STS12/done.json"
    row = frame(spark, [path]).select(
        *[c.alias(n) for n, c in R.unit_of(F.col("x")).items()],
        R.parent(F.col("x"), 2).alias("up"),
        R.file_stem(F.col("x")).alias("stem"),
    ).first()
    assert tuple(row)[:5] == ("Pythia", "410m", "step1", 7, "STS12")
    assert row.up.endswith("layer_007") and row.stem == "done"
    name = R.model_id(F.lit(" 410M "))
    row = spark.range(1).select(name.alias("m"), R.escaped(name).alias("e")).first()
    assert (row.m, row.e) == ("EleutherAI/pythia-410m", "EleutherAI__pythia-410m")
    assert spark.range(1).select(R.safe_name(F.lit("a/b c")).alias("s")).first().s == "a_b_c"


def test_checkpoint_grids(spark):
    def names(kind, interval=None):
        return [r.revision for r in G.checkpoint_grid(spark, kind, interval).orderBy("ord").collect()]

    every = names("all")
    assert len(every) == 155 and every[:3] == ["step0", "step1", "step2"] and every[-1] == "main"
    assert names("dense", 64)[:7] == ["step0", "step1", "step2", "step4", "step8", "step16", "step32"]
    assert names("uniform")[0] == "step2000" and len(names("uniform")) == 72
    assert len(names("log")) == 20
    assert len(names("sparse")) == 8
    assert len(names("graded")) == 28
    assert len(names("regular")) == 29
    with pytest.raises(ValueError):
        G.checkpoint_grid(spark, "odd")


def test_work_grid_and_resume(spark):
    grid = G.work_grid(frame(spark, ["main"], "revision"), tasks=G.TASKS)
    assert grid.count() == 36 * 32
    assert G.work_grid(frame(spark, ["main", "a"], "revision"), only_size="410m").count() == 48
    done = grid.where("layer = 0")
    assert W.pending(grid, done).count() == 33 * 32
    assert W.finished(grid, done).count() == 3 * 32


def test_missing_steps_uses_the_stride(spark):
    names = frame(spark, ["step1000", "step4000", "main", "step2000"], "revision")
    assert [r.step for r in G.missing_steps(names).collect()] == [3000]
    assert G.missing_steps(frame(spark, ["main"], "revision")).count() == 0


def test_arm_key_round_trip(spark):
    revision, layer = R.parse_arm_key(R.arm_key(F.lit("step1"), F.lit(7)))
    assert tuple(spark.range(1).select(revision, layer).first()) == ("step1", 7)
