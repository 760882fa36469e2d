"""The bandit's state over a log stream, and the corpus cache with its manifest."""

import pytest
from pyspark.sql import functions as F

from stratalens.operators import bandit as B
from stratalens.sources import corpus_cache as H
from stratalens.streaming import bandit_state as S

PULLS = "revision string, layer int, seq long, reward double, context array<double>"


def pulls(spark, seqs):
    rows = [(f"step{i % 3}", i % 2, i, float(i), [1.0, float(i % 5)]) for i in seqs]
    return spark.createDataFrame(rows, PULLS)


def rows(state):
    return sorted((r.revision, r.layer, tuple(r.a), tuple(r.b), r.n) for r in state.collect())


def test_each_pull_counts_once(spark, tmp_path):
    root = str(tmp_path / "state")
    S.start_state(spark, root)
    assert S.read_state(spark, root) is None
    for seqs in (range(10), range(5, 20), [], range(20), [25, 25]):
        S.merge_pulls(pulls(spark, seqs), root, 2)
    expected = B.linucb_state(pulls(spark, [*range(20), 25]), 2)
    assert rows(S.read_state(spark, root)) == rows(expected)
    assert rows(S.read_state(spark, root, 1)) == rows(B.linucb_state(pulls(spark, range(10)), 2))
    with pytest.raises(ValueError):
        S.read_state(spark, root, 9)


def test_a_merge_that_was_cut_off_is_done_again(spark, tmp_path):
    root = str(tmp_path / "state")
    S.start_state(spark, root)
    S.merge_pulls(pulls(spark, range(10)), root, 2)
    # pulls and state of the next version, not its number
    pulls(spark, range(10, 14)).write.parquet(f"{root}/pulls/2")
    B.linucb_state(pulls(spark, range(3)), 2).write.parquet(f"{root}/state/2")
    assert rows(S.read_state(spark, root)) == rows(B.linucb_state(pulls(spark, range(10)), 2))
    S.merge_pulls(pulls(spark, range(10, 16)), root, 2)
    assert rows(S.read_state(spark, root)) == rows(B.linucb_state(pulls(spark, range(16)), 2))


def test_a_stream_without_its_checkpoint_adds_nothing_twice(spark, tmp_path):
    log, root = str(tmp_path / "log"), str(tmp_path / "state")
    kinds = pulls(spark, [0]).schema
    for number, seqs in enumerate((range(8), range(4, 12))):
        pulls(spark, seqs).write.mode("append").parquet(log)
        S.follow_pulls(spark, log, kinds, root, str(tmp_path / f"stream{number}"), 2).awaitTermination()
    assert rows(S.read_state(spark, root)) == rows(B.linucb_state(pulls(spark, range(12)), 2))


def test_corpus_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    sources = spark.createDataFrame([("a", i, f"text {i}") for i in range(20)], "task string, pos long, text string")

    def build(df):
        return df.where("pos > 2")

    def read(df):
        found, built = H.validated_corpus(spark, path, df, build)
        return found.count(), built

    assert read(sources) == (17, True)
    assert read(sources.repartition(5)) == (17, False)
    other = sources.withColumn("text", F.when(F.col("pos") != 7, F.col("text")))
    assert read(other) == (17, True)
    assert read(sources) == (17, True)
    # fewer rows than the manifest tells of, then other columns
    sources.limit(4).write.mode("overwrite").parquet(H.rows_folder(spark, path))
    assert read(sources) == (17, True)
    spark.range(17).write.mode("overwrite").parquet(H.rows_folder(spark, path))
    assert read(sources) == (17, True)
    assert read(sources) == (17, False)
    assert read(sources.limit(0)) == (0, True)
    (tmp_path / "cache" / "manifest" / "part-x.json").write_text("{broken")
    assert read(sources.limit(0)) == (0, False)
