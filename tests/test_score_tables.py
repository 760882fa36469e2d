"""Edge cases of the relational tables; the queries cover the ordinary ones."""

import math

import pytest

from stratalens.operators import coverage as C
from stratalens.operators import metric_tables as M
from stratalens.operators import score_tables as S

DDL = "revision string, layer int, task string, main_score double"


@pytest.fixture
def scores(spark):
    rows = [
        ("main", 0, "a", 0.5), ("main", 1, "a", 0.7), ("main", 0, "b", 0.1), ("main", 1, "b", 0.1),
        ("step137000", 0, "a", 0.5), ("step137000", 1, "a", 0.6), ("step137000", 1, "b", 0.1),
        ("step137000", 1, "only", 0.9), ("main", 1, "c", None), ("step137000", 1, "c", 0.2),
    ]
    return spark.createDataFrame(rows, DDL)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_null_scores_count_nowhere(scores):
    found = S.win_rate(scores, last_n=2, baseline_layer=1)
    assert rows(found, "revision", "layer", "wins", "losses", "ties", "win_rate") == [
        ("main", 0, 0, 1, 1, 0.0),
        ("main", 1, 1, 0, 1, 0.5),
        ("step137000", 0, 0, 1, 0, 0.0),
        ("step137000", 1, 0, 0, 3, 0.0),
    ]


def test_missing_baseline_keeps_every_row(scores):
    found = S.win_rate(scores, last_n=2, baseline_revision="none")
    assert rows(found, "total_tasks", "win_rate") == [(0, 0.0)] * 4


def test_coverage_lists_missing_common_tasks(scores):
    found = C.revision_layer_coverage(scores, 2)
    assert rows(found, "revision", "layer", "n_tasks", "missing_tasks") == [
        ("main", 0, 2, "c"),
        ("main", 1, 3, "none"),
        ("step137000", 0, 1, "b, c"),
        ("step137000", 1, 4, "none"),
    ]


def test_slices(scores):
    assert rows(C.common_tasks(scores), "task") == [("a",), ("b",), ("c",)]
    pair = C.slice_rows(scores, "S2", pair=("main", "step137000"))
    assert pair.where("task = 'only'").count() == 0
    assert C.slice_rows(scores, "S3").count() == 5
    with pytest.raises(ValueError):
        C.slice_rows(scores, "S9")
    table = {r.slice_id: r for r in C.comparable_slices(scores).collect()}
    assert table["S2"].n_tasks == 0 and table["S2"].tasks == ""
    assert table["S3"].tasks == "a, b, c, only" and table["S1"].n_revisions == 2


def test_single_layer_has_no_margin(spark):
    one = spark.createDataFrame([("main", 3, "a", 0.5), ("main", 3, "b", 0.7)], DDL)
    best = S.best_layer(one).first()
    assert (best.best_layer, best.margin_to_2nd_best) == (3, 0.0)
    summary = S.arm_summary(one).first()
    assert summary.n_tasks == 2 and summary.median_main_score == pytest.approx(0.6)
    lone = S.arm_summary(spark.createDataFrame([("main", 3, "a", 0.5)], DDL)).first()
    assert lone.std_over_tasks is None


def test_equal_means_share_a_rank(spark):
    tied = spark.createDataFrame(
        [("main", 0, "a", 0.1), ("main", 0, "b", 0.2), ("main", 1, "a", 0.2), ("main", 1, "b", 0.1),
         ("main", 2, "a", 0.0), ("main", 2, "b", 0.0)], DDL)
    assert rows(S.layer_profile(tied), "layer", "rank_within_revision") == [(0, 1), (1, 1), (2, 3)]
    assert S.best_layer(tied).first().best_layer == 0


def test_wide_columns_are_in_checkpoint_order(spark):
    data = [(r, 0, "a", 0.1) for r in ("main", "step9", "step10", "odd")]
    frame = spark.createDataFrame(data, DDL)
    assert S.trend_wide(frame).columns == ["layer", "step9", "step10", "main", "odd"]
    assert S.task_table_wide(frame).columns == ["task", "layer", "step9", "step10", "odd"]


def test_reference_values_have_text_layers(spark):
    content = spark.createDataFrame([('{"a": {"0": 0.5, "1": 0.0}, "b": {"0": 1}}',)], "content string")
    reference = S.read_reference_values(content)
    ours = spark.createDataFrame([("a", 0, 0.6), ("a", 1, 0.2), ("c", 0, 1.0)], "task string, layer int, ours double")
    found = S.compare_reference(ours, reference)
    diffs = {(r.task, r.layer): r for r in found.collect()}
    assert set(diffs) == {("a", 0), ("a", 1)}
    assert diffs["a", 0].pct_diff == pytest.approx(20) and diffs["a", 1].pct_diff == math.inf
    assert S.compare_reference(ours, reference, "full").count() == 4
    summary = S.compare_summary(found).first()
    assert (summary.n, summary.n_above, summary.n_below) == (2, 2, 0)


def test_top_extremes_with_fewer_rows_than_asked(spark):
    metrics = spark.createDataFrame(
        [("main", i, float(v)) for i, v in enumerate([3, 1, 1])], "checkpoint string, layer int, curvature double"
    )
    found = M.top_extremes(metrics, 10, ["curvature"])
    assert rows(found.where("side = 'lowest'"), "rank", "layer") == [(1, 1), (2, 2), (3, 0)]
    assert found.count() == 6


def test_describe_skips_missing_values_and_interpolates(spark):
    values = [4.0, 1.0, 1.0, 2.0, 8.0, None]
    metrics = spark.createDataFrame([(v, 1.0) for v in values], "curvature double, anisotropy double")
    found = {r.metric: r for r in M.describe(metrics, ["curvature", "anisotropy"]).collect()}
    row = found["curvature"]
    assert (row["count"], row["p25"], row["p50"], row["p75"], row["median"]) == (5, 1.0, 2.0, 4.0, 2.0)
    assert found["anisotropy"]["std"] == 0.0 and found["anisotropy"]["count"] == 6


def test_layer_counts_are_rows_and_checkpoint_counts_distinct(spark):
    metrics = spark.createDataFrame(
        [("main", 0, 1.0), ("main", 0, 3.0), ("step1", 0, 5.0)],
        "checkpoint string, layer int, curvature double",
    )
    by_checkpoint = M.by_checkpoint(metrics, ["curvature"])
    assert rows(by_checkpoint, "checkpoint", "num_layers", "curvature_mean") == [
        ("main", 2, 2.0), ("step1", 1, 5.0),
    ]
    assert M.by_layer(metrics, ["curvature"]).first().num_checkpoints == 2


def test_group_stats_keeps_the_two_groupings_apart(scores):
    found = S.group_stats(scores)
    assert rows(found.select("grouping", "value", "n_scores"), "grouping", "value", "n_scores") == [
        ("layer", "0", 3), ("layer", "1", 6), ("revision", "main", 4), ("revision", "step137000", 5),
    ]


def test_average_scores_say_when_they_are_partial(scores, spark):
    tasks = spark.createDataFrame([("a",), ("b",)], "task string")
    found = S.average_main_score(scores.where("revision = 'step137000'"), tasks)
    assert rows(found, "layer", "num_tasks", "expected_tasks", "status") == [
        (0, 1, 2, "partial"), (1, 2, 2, "complete"),
    ]
    extremes = S.average_extremes(found).first()
    assert (extremes.min_layer, extremes.max_layer) == (1, 0)
