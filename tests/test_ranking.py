"""Positions and running totals against a plain sort."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.operators import ranking as K


@pytest.fixture
def skewed(spark, rng):
    """Three groups, one with two thirds of the rows."""
    groups = rng.choice(["a", "b", "hot"], 3000, p=[0.1, 0.2, 0.7])
    rows = [(str(g), int(i), int(v)) for i, (g, v) in enumerate(zip(groups, rng.integers(0, 50, 3000)))]
    return spark.createDataFrame(rows, "g string, id long, v long").repartition(7)


def test_positions_over_the_whole_table(skewed):
    rows = K.positions(skewed, [F.col("v").desc(), F.col("id")], size="n").collect()
    expected = sorted(rows, key=lambda r: (-r.v, r.id))
    assert [r.position for r in expected] == list(range(1, 3001))
    assert {r.n for r in rows} == {3000}


def test_positions_within_groups(skewed):
    rows = K.positions(skewed, [F.col("id")], group=["g"], name="k", size="n").collect()
    for group in "a", "b", "hot":
        own = sorted((r for r in rows if r.g == group), key=lambda r: r.id)
        assert [r.k for r in own] == list(range(1, len(own) + 1))
        assert {r.n for r in own} == {len(own)}


def test_running_totals(skewed):
    totals = {"rows": F.lit(1), "sum": F.col("v")}
    rows = K.running_totals(skewed, [F.col("v"), F.col("id")], totals).collect()
    rows = sorted(rows, key=lambda r: (r.v, r.id))
    assert [r["rows"] for r in rows] == list(range(1, 3001))
    assert [r["sum"] for r in rows] == list(np.cumsum([r.v for r in rows]))


def test_top_rows_of_a_group_spread_over_many_tasks(skewed, monkeypatch):
    monkeypatch.setattr(K, "LIMITED_TASKS", 8)
    rows = K.top_rows(skewed.repartition(40), ["g"], [F.col("v").desc(), F.col("id")], 5).collect()
    every = skewed.collect()
    for group in "a", "b", "hot":
        best = sorted((r for r in every if r.g == group), key=lambda r: (-r.v, r.id))[:5]
        own = sorted((r for r in rows if r.g == group), key=lambda r: r["rank"])
        assert [r.id for r in own] == [r.id for r in best]
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]


def test_limits_are_applied_before_the_shuffle_and_settings_stay(spark, skewed):
    setting = "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(setting, "1000")
    plan = K.top_rows(skewed, ["g"], [F.col("id")], 1000)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    top = K.top_rows(skewed, ["g"], [F.col("id")], 1500)
    counts = {r["g"]: r["count"] for r in skewed.groupBy("g").count().collect()}
    kept = {r["g"]: r["count"] for r in top.groupBy("g").count().collect()}
    assert kept == {g: min(n, 1500) for g, n in counts.items()}
    assert spark.conf.get(setting, "1000") == before


def test_average_ranks(spark, skewed):
    ranks = K.average_ranks(skewed.withColumn("w", F.lit(1)), "v", "w", "r").collect()
    values = np.array([r.v for r in skewed.collect()])
    for row in ranks:
        below, same = (values < row.v).sum(), (values == row.v).sum()
        assert row.r == below + (same + 1) / 2


@pytest.mark.parametrize("n, parts", [(154, 16), (10, 3), (3, 5), (12, 4), (1, 1)])
def test_chunks_are_near_equal_and_longer_first(spark, n, parts):
    rows = K.chunks(spark.range(n).repartition(3), [F.col("id")], parts).collect()
    base, extra = divmod(n, parts)
    sizes = [base + (1 if i < extra else 0) for i in range(parts)]
    expected = [i for i, size in enumerate(sizes) for _ in range(size)]
    assert [r.chunk for r in sorted(rows, key=lambda r: r.id)] == expected
