"""Matrix statistics against numpy, on matrices spread over several tasks."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.operators import matrix_stats as M
from stratalens.operators import moments as P

KEYS = ["arm"]


def centred(x):
    return x - x.mean(axis=0)


def histogram_entropy(values, bins=50):
    share = np.histogram(values, bins=bins)[0] + 1e-10
    share = share / share.sum()
    return -(share * np.log(share)).sum()


def effective_rank(x):
    s = np.linalg.svd(centred(x), compute_uv=False)
    p = s / (s.sum() + 1e-10)
    p = p[p > 1e-10]
    return np.exp(-(p * np.log(p + 1e-10)).sum())


@pytest.fixture
def arms(rng):
    return {
        "tall": rng.normal(size=(300, 20)) * np.linspace(2, 0.1, 20) + 5,
        "wide": rng.normal(size=(15, 90)),  # more than one block of scatter rows, n < d
        "far": rng.normal(size=(60, 8)) + 1e6,  # cancellation if centred late
    }


@pytest.fixture
def frame(arms, matrix_frame):
    return matrix_frame(**arms)


def by_arm(df, column):
    return {r.arm: r[column] for r in df.collect()}


def test_moments_match_numpy(frame, arms):
    rows = P.moments(frame, KEYS).collect()
    for name, x in arms.items():
        blocks = sorted((r for r in rows if r.arm == name), key=lambda r: r.block)
        d = x.shape[1]
        scatter = np.concatenate([np.reshape(r.scatter, (-1, d)) for r in blocks])
        np.testing.assert_allclose(blocks[0].mean, x.mean(axis=0), rtol=1e-12)
        np.testing.assert_allclose(scatter, centred(x).T @ centred(x), rtol=1e-7, atol=1e-7)
        assert {r.n for r in blocks} == {len(x)}


def test_many_arms_per_task_are_flushed(matrix_frame, rng):
    arms = {f"a{i:03d}": rng.normal(size=(7, 3)) for i in range(60)}
    rows = P.moments(matrix_frame(**arms).coalesce(2), KEYS).collect()
    assert len(rows) == 60
    for r in rows:
        x = arms[r.arm]
        np.testing.assert_allclose(r.scatter, (centred(x).T @ centred(x)).ravel(), atol=1e-9)


def test_interleaved_arms_are_gathered_first(matrix_frame, rng, monkeypatch):
    monkeypatch.setattr(P, "GATHERED_ROWS", 50)
    arms = {f"a{i:02d}": rng.normal(size=(200 if i == 3 else 9, 40)) for i in range(20)}
    frame = matrix_frame(**arms).repartition(12)
    assert P.gathered(frame, KEYS) is not frame
    assert P.gathered(frame.repartition(1), KEYS).count() == frame.count()
    for r in P.moments(frame, KEYS).collect():
        x = arms[r.arm]
        np.testing.assert_allclose(r.scatter, (centred(x).T @ centred(x)).ravel(), atol=1e-9)
        assert r.n == len(x)


def test_vector_sums(frame, arms):
    rows = P.vector_sums(frame, KEYS).collect()
    for r in rows:
        np.testing.assert_allclose(r.total, arms[r.arm].sum(axis=0), rtol=1e-12)
        assert r.n == len(arms[r.arm])


def test_spectral_statistics(frame, arms):
    rows = {r.arm: r for r in M.spectra(frame, KEYS).collect()}
    for name, x in arms.items():
        cov = np.cov(x.T)
        values = np.clip(np.linalg.eigvalsh(cov), 0, None)
        row = rows[name]
        assert row.effective_rank == pytest.approx(effective_rank(x), rel=1e-6)
        assert row.spectral_norm == pytest.approx(np.linalg.norm(cov, 2), rel=1e-6)
        assert row.anisotropy == pytest.approx(values.std() / (values.mean() + 1e-10), rel=1e-6)
        logdet = np.linalg.slogdet(cov + 1e-10 * np.eye(len(cov)))[1]
        assert row.logdet_covariance == pytest.approx(logdet, rel=1e-3 if name == "wide" else 1e-6)
        kept = values[values > 1e-10]
        if name != "wide":
            expected = kept.max() / (kept.min() + 1e-10)
            assert row.condition_number == pytest.approx(expected, rel=1e-5)


def test_summary_without_an_eigensolve(frame, arms):
    rank = by_arm(M.effective_rank_fro(frame, KEYS), "effective_rank_fro")
    spread = by_arm(M.anisotropy(frame, KEYS), "anisotropy")
    for name, x in arms.items():
        cov = np.cov(x.T)
        trace, fro = np.trace(cov), (cov**2).sum()
        values = np.linalg.svd(cov, compute_uv=False)
        assert rank[name] == pytest.approx(trace**2 / (fro + 1e-10), rel=1e-6)
        assert spread[name] == pytest.approx(values.std() / (values.mean() + 1e-10), rel=1e-5)


def test_prompt_entropy(frame, arms):
    found = by_arm(M.prompt_entropy(frame, KEYS), "prompt_entropy")
    for name, x in arms.items():
        u, s, _ = np.linalg.svd(centred(x), full_matrices=False)
        assert found[name] == pytest.approx(histogram_entropy(u[:, 0] * s[0]), abs=1e-6)


def test_projections(frame, arms, monkeypatch):
    spectra = M.spectra(frame, KEYS).cache()
    rows = {r.arm: r for r in spectra.collect()}
    sent = M.axis_scores(frame, spectra, KEYS)
    monkeypatch.setattr(M, "broadcast_if_small", lambda df: df)
    joined = M.axis_scores(frame, spectra, KEYS)
    for name, x in arms.items():
        a, b = (sorted(r.axis_score for r in f.where(F.col("arm") == name).collect()) for f in (sent, joined))
        assert a == b
        expected = (x - np.array(rows[name].mean)) @ np.array(rows[name].axis)
        np.testing.assert_allclose(a, sorted(expected), atol=1e-8)


def test_norm_entropy(frame, arms):
    found = by_arm(M.norm_entropy(frame, KEYS), "norm_entropy")
    for name, x in arms.items():
        norms = np.linalg.norm(x, axis=1)
        assert found[name] == pytest.approx(histogram_entropy(norms), abs=1e-6)


def test_dataset_entropy_and_mean_cosine(frame, arms):
    entropy = by_arm(M.dataset_entropy(frame, KEYS, None), "dataset_entropy")
    cosine = by_arm(M.mean_pairwise_cosine(frame, KEYS), "mean_pairwise_cosine")
    for name in "tall", "wide":
        x = arms[name]
        u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-10)
        pairs = (u @ u.T)[np.triu_indices(len(x), k=1)]
        assert entropy[name] == pytest.approx(histogram_entropy(1 - pairs), abs=1e-6)
        assert cosine[name] == pytest.approx(pairs.mean(), abs=1e-9)


def test_sample_is_bounded_and_stable(frame):
    first = {(r.arm, r.row_id) for r in M.sample_rows(frame, KEYS, 20).collect()}
    again = {(r.arm, r.row_id) for r in M.sample_rows(frame.repartition(2), KEYS, 20).collect()}
    other = {(r.arm, r.row_id) for r in M.sample_rows(frame, KEYS, 20, seed=1).collect()}
    assert first == again != other
    assert len(first) == 20 + 15 + 20
    for arm, n in ("tall", 300), ("wide", 15):
        ranked = sorted(range(n), key=lambda i: hashlib.md5(f"0:{i}".encode()).hexdigest())
        assert {row for name, row in first if name == arm} == set(ranked[:20])


def test_flat_and_tiny_arms(matrix_frame, rng):
    frame = matrix_frame(one=[[1.0, 2.0]], same=[[3.0, 4.0]] * 5, two=[[0.0, 1.0], [1.0, 0.0]])
    spectra = {r.arm: r for r in M.spectra(frame, KEYS).collect()}
    assert spectra["one"].effective_rank == 1.0 and spectra["one"].spectral_norm is None
    assert spectra["same"].effective_rank == 1.0
    entropy = by_arm(M.prompt_entropy(frame, KEYS), "prompt_entropy")
    assert entropy["one"] == 0.0 and entropy["same"] == pytest.approx(0, abs=1e-6)
    assert entropy["two"] == pytest.approx(np.log(2), abs=1e-6)
    pairs = by_arm(M.dataset_entropy(frame, KEYS, None), "dataset_entropy")
    assert pairs["one"] == 0.0
    fallback = by_arm(M.effective_rank_fro(frame, KEYS), "effective_rank_fro")
    assert fallback["one"] == 1.0 and fallback["same"] == 1.0


def test_invariance_to_rotation_and_scale(matrix_frame, rng):
    x = rng.normal(size=(80, 6)) * np.linspace(3, 1, 6)
    q, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    frame = matrix_frame(plain=x, turned=x @ q, scaled=100 * x, flipped=-x)
    rank = by_arm(M.spectral_statistic(frame, KEYS, "effective_rank"), "effective_rank")
    entropy = by_arm(M.prompt_entropy(frame, KEYS), "prompt_entropy")
    for other in "turned", "scaled", "flipped":
        assert rank[other] == pytest.approx(rank["plain"], rel=1e-9)
    for other in "turned", "scaled":
        assert entropy[other] == pytest.approx(entropy["plain"], abs=1e-6)


def test_all_metrics_in_one_row_per_arm(frame, arms):
    rows = {r.arm: r for r in M.representation_metrics(frame, KEYS).collect()}
    assert set(rows) == set(arms)
    assert rows["tall"].n == 300
    assert all(rows["tall"][name] is not None for name in M.METRICS)
    single = by_arm(M.spectral_statistic(frame, KEYS, "effective_rank"), "effective_rank")
    assert rows["wide"].effective_rank == pytest.approx(single["wide"])
    cosine = by_arm(M.mean_pairwise_cosine(frame, KEYS), "mean_pairwise_cosine")
    assert rows["tall"].mean_pairwise_cosine == pytest.approx(cosine["tall"])


def test_metrics_of_arms_without_structure_make_few_copies(spark, matrix_frame, rng, monkeypatch):
    """Rows without a vector beside them: in many cells the same statistics as in one, probes not copied for each."""
    from stratalens.operators import neighbors as B

    frame = matrix_frame(a=rng.normal(size=(300, 24)))
    missing = spark.createDataFrame([("a", 1000 + i, None) for i in range(5)], frame.schema)
    frame = frame.unionByName(missing)
    whole = M.representation_metrics(frame, KEYS).first()
    routed, route = [], B._routed

    def counted(*args):
        found = route(*args)
        routed.append(found.count())
        return found

    monkeypatch.setattr(B, "_routed", counted)
    monkeypatch.setattr(B, "CELL_ROWS", 50)
    cut = M.representation_metrics(frame, KEYS).first()
    assert cut[1:-1] == pytest.approx(whole[1:-1], rel=1e-9) and cut.n == 300 and cut.reason is None
    assert len(routed) == 1 and routed[0] <= B.FEW_CELLS * 300


def test_pair_blocks_give_what_all_pairs_give(frame, arms, monkeypatch):
    whole = by_arm(M.dataset_entropy(frame, KEYS, None), "dataset_entropy")
    for size in (7, 40):
        monkeypatch.setattr(M, "PAIR_ROWS", size)
        rows = M.dataset_entropy(frame, KEYS, None).collect()
        assert {r.arm: r.dataset_entropy for r in rows} == pytest.approx(whole, abs=1e-12)
    sample = {r.arm: (r.n_rows, r.n_used) for r in M.dataset_entropy(frame, KEYS, 20).collect()}
    assert sample == {"tall": (300, 20), "wide": (15, 15), "far": (60, 20)}


def test_pairs_copy_a_row_a_fixed_number_of_times(matrix_frame, rng, monkeypatch):
    """Many blocks in a few parts, also where a part is split for its bytes: all pairs, each once."""
    arms = {"a": rng.normal(size=(260, 6)), "few": rng.normal(size=(6, 6)), "one": rng.normal(size=(1, 6))}
    frame = matrix_frame(**arms)
    copies, blocks = [], M._pair_blocks

    def counted(*args):
        found = blocks(*args)
        copies.append({r.arm: r["count"] for r in found.groupBy("arm").count().collect()})
        return found

    monkeypatch.setattr(M, "_pair_blocks", counted)
    monkeypatch.setattr(M, "PAIR_ROWS", 7)
    for size in (M.PART_BYTES, 260 * 88 // 9):
        monkeypatch.setattr(M, "PART_BYTES", size)
        entropy = by_arm(M.dataset_entropy(frame, KEYS, None), "dataset_entropy")
        for name in "a", "few":
            u = arms[name] / (np.linalg.norm(arms[name], axis=1, keepdims=True) + 1e-10)
            pairs = (u @ u.T)[np.triu_indices(len(u), k=1)]
            assert entropy[name] == pytest.approx(histogram_entropy(1 - pairs), abs=1e-6)
        assert entropy["one"] == 0
    assert copies[0] == {"a": 260 * M.PAIR_PARTS, "few": 6, "one": 1} and copies[1]["a"] == 260 * 10


def test_pairs_are_shuffled_once(matrix_frame, rng, monkeypatch):
    """The range and the counts are taken from the same shuffle, with fewer copies of a row if arms are many."""
    arms = {f"a{i:02d}": rng.normal(size=(40, 6)) for i in range(12)}
    copies, blocks = [], M._pair_blocks
    monkeypatch.setattr(M, "_pair_blocks", lambda *args: copies.append(blocks(*args)) or copies[-1])
    monkeypatch.setattr(M, "PAIR_ROWS", 7)
    found = M.dataset_entropy(matrix_frame(**arms), KEYS, None)
    entropy = {r.arm: r.dataset_entropy for r in found.collect()}
    for name, x in arms.items():
        u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-10)
        pairs = (u @ u.T)[np.triu_indices(len(u), k=1)]
        assert entropy[name] == pytest.approx(histogram_entropy(1 - pairs), abs=1e-6)
    assert copies[0].count() == 12 * 40 * 2
    plan = found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    lines = [line for line in plan.splitlines() if "hashpartitioning(arm" in line]
    of_pairs = [line for line in lines if "_a#" in line and "_u#" in line]
    assert plan.count("ReusedExchange") >= 1, plan
    assert sum("ReusedExchange" in line for line in of_pairs) == 1 or len(of_pairs) == 1, of_pairs


def test_condition_number_does_not_change_with_the_scale(matrix_frame, rng):
    x = rng.normal(size=(15, 40))
    frame = matrix_frame(plain=x, large=1e3 * x)
    found = by_arm(M.spectral_statistic(frame, KEYS, "condition_number"), "condition_number")
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1][:14]
    assert found["plain"] == pytest.approx(values[0] / values[-1], rel=1e-6)
    assert found["large"] == pytest.approx(found["plain"], rel=1e-6)


def odd_frame(spark, rng):
    ddl = "arm string, row_id long, embedding array<double>"
    vectors = rng.normal(size=(30, 4))
    rows = [("good", i, [float(v) for v in x]) for i, x in enumerate(vectors)]
    rows += [("some", i, [float(v) for v in x]) for i, x in enumerate(vectors)]
    rows += [("some", 100 + i, None) for i in range(20)]
    rows += [("bad", i, [float(v) for v in x]) for i, x in enumerate(vectors)]
    rows += [("bad", 99, [1.0, float("nan"), 0.0, 0.0]), ("inf", 0, [float("inf"), 1.0]), ("inf", 1, [0.0, 1.0])]
    rows += [("none", 0, None)]
    return spark.createDataFrame(rows, ddl).repartition(4)


def test_null_vectors_and_vectors_that_are_not_finite(spark, rng):
    frame = odd_frame(spark, rng)
    rows = {r.arm: r for r in M.representation_metrics(frame, KEYS).collect()}
    assert set(rows) == {"good", "some", "bad", "inf"}
    assert rows["some"][1:-1] == pytest.approx(rows["good"][1:-1]) and rows["good"].reason is None
    for arm in "bad", "inf":
        assert rows[arm].reason == M.NOT_FINITE
        assert all(rows[arm][name] is None for name in M.METRICS)
    for measure, name in (
        (M.norm_entropy, "norm_entropy"),
        (M.prompt_entropy, "prompt_entropy"),
        (lambda f, k: M.dataset_entropy(f, k, None), "dataset_entropy"),
        (lambda f, k: M.dataset_entropy(f, k, 30), "dataset_entropy"),
    ):
        found = by_arm(measure(frame, KEYS), name)
        assert found["some"] == pytest.approx(found["good"]) and found.get("bad") is None
    sampled = M.mean_pairwise_cosine(frame, KEYS, sample=30)
    assert {r.arm: r.n_used for r in sampled.collect()}["some"] == 30


def test_thin_arms_move_beside_a_hot_one(matrix_frame, rng):
    arms = {f"a{i:02d}": rng.normal(size=(4, 30)) for i in range(30)} | {"hot": rng.normal(size=(900, 30))}
    frame = matrix_frame(**arms)
    laid = P.gathered(frame, KEYS)
    seen = laid.groupBy(F.spark_partition_id().alias("p"), "arm").count().groupBy("arm").count().collect()
    assert all(r["count"] == 1 for r in seen if r.arm != "hot")
    assert laid.count() == frame.count()


def test_null_vectors_are_left_out(spark):
    ddl = "arm string, row_id long, embedding array<float>"
    rows = [("a", 0, [1.0, 0.0]), ("a", 1, None), ("a", 2, [0.0, 1.0]), ("a", 3, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, ddl)
    assert M.spectra(frame, KEYS).select(F.max("n")).first()[0] == 3


def test_copies_of_one_vector_are_spread(spark, matrix_frame, rng, monkeypatch):
    """Interleaved arms, a third of the rows one vector: no task gets most of its copies."""
    from pyspark.sql import functions as F

    from stratalens.operators import moments as O

    monkeypatch.setattr(O, "GATHERED_ROWS", 40)
    for name, value in (("adaptive.coalescePartitions.enabled", "false"), ("shuffle.partitions", "8")):
        spark.conf.set(f"spark.sql.{name}", value)
    try:
        rows = rng.normal(size=(600, 32))
        rows[:200] = rows[0]
        frame = matrix_frame(**{f"a{i}": rows for i in range(2)}).repartition(120, "row_id")
        copies = O.gathered(frame, ["arm"]).where(F.col("embedding")[0] == float(rows[0][0]))
        counts = [r["count"] for r in copies.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(counts) == 400 and max(counts) < 160
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
