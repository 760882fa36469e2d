"""Task scores against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.operators import evaluate as E


def average_ranks(values):
    values = np.asarray(values)
    return np.array([(values < v).sum() + ((values == v).sum() + 1) / 2 for v in values])


def test_spearman_with_ties(spark, rng):
    x, y = rng.integers(0, 5, 300), rng.integers(0, 40, 300)
    rows = [(int(a), float(b)) for a, b in zip(x, y + x)]
    pairs = spark.createDataFrame(rows, "gold int, sim double").repartition(4)
    expected = np.corrcoef(average_ranks(x), average_ranks(y + x))[0, 1]
    row = E.spearman(pairs, "gold", "sim").first()
    assert row.n_pairs == 300 and row.main_score == pytest.approx(expected)


def test_average_precision_with_ties(spark, rng):
    sim, label = rng.integers(0, 30, 200) / 10, rng.integers(0, 2, 200)
    total, area = label.sum(), 0.0
    for cut in sorted(set(sim), reverse=True):
        at, above = sim == cut, sim >= cut
        area += label[at].sum() / total * label[above].sum() / above.sum()
    rows = [(int(a), float(b)) for a, b in zip(label, sim)]
    row = E.average_precision(spark.createDataFrame(rows, "label int, sim double"), "label", "sim")
    assert row.first().main_score == pytest.approx(area)


def test_reranking(spark, rng):
    rows, aps, rrs = [], [], []
    for query in range(40):
        n = 200 if query == 7 else int(rng.integers(1, 9))
        sims, rel = rng.integers(0, 6, n) / 3, rng.integers(0, 2, n)
        rows += [(query, i, float(s), int(r)) for i, (s, r) in enumerate(zip(sims, rel))]
        ranked = rel[np.lexsort((np.arange(n), -sims))]
        if ranked.any():
            hits = np.flatnonzero(ranked) + 1
            aps.append(np.mean(np.arange(1, len(hits) + 1) / hits))
            rrs.append(1 / hits[0])
    ddl = "query_id long, candidate_id long, similarity double, relevant int"
    row = E.reranking(spark.createDataFrame(rows, ddl).repartition(6)).first()
    assert row.n_queries == len(aps)
    assert (row.main_score, row.mrr) == pytest.approx((np.mean(aps), np.mean(rrs)))


def entropy(counts):
    p = np.asarray(list(counts), dtype=float)
    p = p[p > 0] / p.sum()
    return -(p * np.log(p)).sum()


def test_v_measure(spark, rng):
    cluster, label = rng.integers(0, 4, 500), rng.integers(0, 3, 500)
    table = np.histogram2d(cluster, label, bins=[range(5), range(4)])[0]
    joint = entropy(table.ravel())
    h_label, h_cluster = entropy(table.sum(axis=0)), entropy(table.sum(axis=1))
    h = 1 - (joint - h_cluster) / h_label
    c = 1 - (joint - h_label) / h_cluster
    rows = [(int(a), int(b)) for a, b in zip(cluster, label)]
    row = E.v_measure(spark.createDataFrame(rows, "cluster int, label int")).first()
    found = (row.homogeneity, row.completeness, row.main_score)
    assert found == pytest.approx((h, c, 2 * h * c / (h + c)))
    perfect = E.v_measure(spark.createDataFrame([(1, 2), (1, 2), (0, 5)], "cluster int, label int"))
    assert perfect.first().main_score == pytest.approx(1)


@pytest.fixture
def blobs(spark, rng):
    centres = rng.normal(size=(4, 6)) * 10
    rows = []
    for i in range(400):
        label = int(rng.integers(4))
        rows.append((i, [float(v) for v in centres[label] + rng.normal(size=6)], label))
    return spark.createDataFrame(rows, "row_id long, embedding array<float>, label int").repartition(4)


def test_kmeans_is_lloyd_from_the_first_rows_by_hash(spark, rng):
    """Step by step against numpy; a centre that no row is nearest to stays."""
    import hashlib

    x = rng.normal(size=(90, 4)).round(1)
    x[:30] = x[0]
    rows = [(i, v.tolist(), i) for i, v in enumerate(x)]
    rows += [(90, None, 90), (91, [float("nan")] * 4, 91)]
    frame = spark.createDataFrame(rows, "row_id long, embedding array<double>, label int").repartition(4)
    for steps in (0, 1, 6):
        order = sorted(range(90), key=lambda i: hashlib.md5(f"3:{i}".encode()).hexdigest())
        centres = x[order[:12]].copy()
        for step in range(steps + 1):
            place = ((x[:, None, :] - centres) ** 2).sum(axis=2).argmin(axis=1)
            if step < steps:
                for c in set(place.tolist()):
                    centres[c] = x[place == c].mean(axis=0)
        found = E.kmeans(frame, "label", 12, steps, seed=3).collect()
        assert {r.label: r.cluster for r in found} == dict(enumerate(place.tolist()))


def test_clustering_finds_separate_blobs(blobs):
    assert E.clustering(blobs, seed=3).first().main_score > 0.8


@pytest.mark.parametrize("limit", [1 << 30, 1], ids=["one block", "a block each"])
def test_centroid_accuracy(blobs, limit, rng):
    noisy = blobs.withColumn("label", F.when(F.col("row_id") % 10 == 3, 0).otherwise(F.col("label")))
    test = F.col("row_id") % 5 == 0
    rows = noisy.collect()
    train = [r for r in rows if r.row_id % 5]
    centres = {
        label: np.mean([r.embedding for r in train if r.label == label], axis=0) for label in range(4)
    }
    hits = [
        min(centres, key=lambda k: ((np.asarray(r.embedding) - centres[k]) ** 2).sum()) == r.label
        for r in rows
        if r.row_id % 5 == 0
    ]
    row = E.centroid_accuracy(noisy.where(~test), noisy.where(test), limit).first()
    assert row.n_rows == len(hits) and row.main_score == pytest.approx(np.mean(hits))


@pytest.mark.parametrize("limit", [1 << 30, 1], ids=["one block", "a block each"])
def test_centroids_far_out_and_close_together(spark, limit):
    ddl = "row_id long, embedding array<double>, label string"
    train = spark.createDataFrame([(0, [1e8], "b"), (1, [1e8 + 0.5], "a"), (2, None, "a"), (3, [0.0], None)], ddl)
    test = [(0, [1e8 + 0.4], "a"), (1, [1e8 + 0.1], "b"), (2, [1e8 + 0.25], "a"), (3, [1e8 + 0.2], "b"), (4, None, "a")]
    row = E.centroid_accuracy(train, spark.createDataFrame(test, ddl), limit).first()
    assert (row.n_rows, row.main_score) == (4, 1.0)  # the tie goes to the lower label


@pytest.mark.parametrize("normalize", [True, False])
def test_cosine_matrix_and_rows(spark, rng, monkeypatch, normalize):
    monkeypatch.setattr(E, "BLOCK_VECTORS", 4)
    a, b = rng.normal(size=(30, 5)), rng.normal(size=(13, 5))
    ddl = "row_id long, embedding array<double>"
    left = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(a)], ddl)
    right = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(b)], ddl)
    if normalize:
        a = a / np.linalg.norm(a, axis=1, keepdims=True)
        b = b / np.linalg.norm(b, axis=1, keepdims=True)
    expected = a @ b.T
    rows = E.cosine_matrix(left, right, normalize=normalize).collect()
    assert len(rows) == 30 * 13
    for r in rows:
        assert r.cosine == pytest.approx(expected[r.left_id, r.right_id])
    pairs = E.cosine_pairwise(left, right, normalize=normalize).collect()
    assert len(pairs) == 13
    for r in pairs:
        assert r.cosine == pytest.approx(expected[r.row_id, r.row_id])
