"""Pooling, norms and cosines against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.functions import vectors as V


@pytest.fixture
def states(spark, rng):
    hidden = rng.normal(size=(4, 10, 8))
    lengths = [7, 10, 5, 0]
    rows = [
        (i, [[float(x) for x in t] for t in h], [0] * (10 - n) + [1] * n)
        for i, (h, n) in enumerate(zip(hidden, lengths))
    ]
    frame = spark.createDataFrame(rows, "i int, hidden array<array<double>>, mask array<int>")
    return hidden, lengths, frame


def test_mean_pool_takes_the_last_positions(states):
    hidden, lengths, frame = states
    rows = frame.select("i", V.pool_mean(F.col("hidden"), F.col("mask")).alias("p")).collect()
    for r in rows:
        n = lengths[r.i]
        # no unmasked position averages all of them
        expected = hidden[r.i][-n:].mean(axis=0) if n else hidden[r.i].mean(axis=0)
        np.testing.assert_allclose(r.p, expected, atol=1e-12)


def test_cls_pool(states):
    hidden, lengths, frame = states
    plain = V.pool_cls(F.col("hidden"))
    token = V.pool_cls(F.col("hidden"), F.col("mask"), first_unmasked=True)
    for r in frame.select("i", plain.alias("c"), token.alias("t")).collect():
        np.testing.assert_allclose(r.c, hidden[r.i][0])
        first = 10 - lengths[r.i] if lengths[r.i] else 0
        np.testing.assert_allclose(r.t, hidden[r.i][first])


def test_normalize_and_cosine(spark, rng):
    a, b = rng.normal(size=(2, 6))
    row = spark.createDataFrame(
        [([float(x) for x in a], [float(x) for x in b], [0.0] * 6)],
        "a array<double>, b array<double>, z array<double>",
    ).select(
        V.l2_normalize(F.col("a")).alias("u"),
        V.l2_normalize(F.col("z")).alias("z"),
        V.cosine(F.col("a"), F.col("b")).alias("c"),
        V.cosine(F.col("a"), F.col("b"), normalize=False).alias("d"),
    ).first()
    np.testing.assert_allclose(row.u, a / np.linalg.norm(a))
    assert row.z == [0.0] * 6
    assert row.c == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    assert row.d == pytest.approx(a @ b)


def test_layer_index_is_shifted_and_checked(spark):
    states = F.lit([[0.0], [1.0], [2.0]])
    assert spark.range(1).select(V.hidden_state(states, F.lit(1))).first()[0] == [2.0]
    with pytest.raises(Exception, match="layer out of range: 2"):
        spark.range(1).select(V.hidden_state(states, F.lit(2))).collect()
