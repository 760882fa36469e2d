"""Nearest neighbours and curvature against brute force, in chunks and blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.operators import neighbors as B

KEYS = ["arm"]


@pytest.fixture
def arms(rng):
    hot = rng.normal(size=(400, 5)).round(1)  # rounding makes equal distances
    hot[50:60] = hot[0]  # exact copies of a probe
    return {"hot": hot, "small": rng.normal(size=(7, 5)), "two": rng.normal(size=(2, 5))}


def brute(x, probe, k):
    distance = ((x - x[probe]) ** 2).sum(axis=1)
    order = [i for i in np.lexsort((np.arange(len(x)), distance)) if i != probe]
    return order[:k]


@pytest.mark.parametrize("cell", [10_000, 20])
def test_knn(arms, matrix_frame, monkeypatch, cell):
    """In one cell an arm, and in some twenty."""
    monkeypatch.setattr(B, "CHUNK_ROWS", 64)
    monkeypatch.setattr(B, "PROBE_ROWS", 12)
    monkeypatch.setattr(B, "CELL_ROWS", cell)
    frame = matrix_frame(**arms)
    rows = B.knn(frame, frame.where("row_id < 30"), KEYS, k=6).collect()
    for name, x in arms.items():
        for probe in range(min(30, len(x))):
            own = sorted((r for r in rows if r.arm == name and r.probe_id == probe), key=lambda r: r.rank)
            expected = brute(x, probe, 6)
            assert [r.neighbor_id for r in own] == expected
            assert probe not in [r.neighbor_id for r in own]
            for r in own:
                np.testing.assert_allclose(r.neighbor, x[r.neighbor_id])
                assert r.distance == pytest.approx(np.linalg.norm(x[probe] - x[r.neighbor_id]))


def test_cells_of_all_rows_are_skipped_by_bounds(matrix_frame, rng, monkeypatch):
    """Forty groups of rows far from the origin: the same as brute force, from a part of the pairs."""
    monkeypatch.setattr(B, "CELL_ROWS", 50)
    x = np.repeat(rng.normal(size=(40, 6)) * 20, 20, axis=0) + rng.normal(size=(800, 6)) + 1e6
    frame = matrix_frame(only=x)
    met, search = [], B._cogrouped

    def counted(df, probes, keys, *rest):
        rows, asked = (d.groupBy(*keys).count() for d in (df, probes))
        both = rows.withColumnRenamed("count", "n").join(asked.withColumnRenamed("count", "m"), keys)
        met.append(sum(r.n * r.m for r in both.collect()))
        return search(df, probes, keys, *rest)

    monkeypatch.setattr(B, "_cogrouped", counted)
    rows = B.knn(frame, None, KEYS, k=5).collect()
    found = {p: [] for p in range(800)}
    for r in sorted(rows, key=lambda r: r.rank):
        found[r.probe_id].append(r.neighbor_id)
    assert all(found[p] == brute(x, p, 5) for p in range(800))
    assert len(met) == 2 and sum(met) < 800 * 800 / 4


def test_rows_without_structure_are_copied_a_fixed_number_of_times(matrix_frame, rng, monkeypatch):
    """No cell is ruled out for any probe: the same as brute force, without a copy of a probe for each cell."""
    monkeypatch.setattr(B, "CELL_ROWS", 50)
    x = rng.normal(size=(600, 24))
    x[500:520] = x[0]  # more copies than neighbours
    frame = matrix_frame(only=x, small=x[:40])
    routed, route = [], B._routed

    def counted(*args):
        found = route(*args)
        routed.append(found.count())
        return found

    monkeypatch.setattr(B, "_routed", counted)
    rows = B.knn(frame, None, KEYS, k=5, vectors=False).collect()
    found = {(r.arm, r.probe_id, r.rank): r.neighbor_id for r in rows}
    for name, own in ("only", x), ("small", x[:40]):
        for probe in range(len(own)):
            assert [found[name, probe, i + 1] for i in range(5)] == brute(own, probe, 5)
    assert "neighbor" not in rows[0] and sum(routed) <= B.FEW_CELLS * 640


def test_probes_of_a_large_cell_make_a_fixed_number_of_parts(matrix_frame, rng, monkeypatch):
    """However many probes there are, a row meets them in as many groups as an arm has parts."""
    monkeypatch.setattr(B, "PROBE_ROWS", 10)
    x = rng.normal(size=(300, 3)).round(2)
    frame = matrix_frame(only=x).withColumn("_at", F.monotonically_increasing_id())
    parts, small = [], B.broadcast_if_small
    monkeypatch.setattr(B, "broadcast_if_small", lambda df: parts.extend(df.collect()) or small(df))
    found = B._cogrouped(frame, frame, KEYS, "row_id", "embedding", 4, B.key_fields(frame, KEYS))
    assert [(r["_m"], r["_b"]) for r in parts] == [(1, B.SWEEPS)]
    seen = {(r.probe_id, r.neighbor_id) for r in found.collect()}
    assert seen == {(p, i) for p in range(300) for i in brute(x, p, 4)}


@pytest.mark.parametrize("far", [0.0, 1e6])
def test_search_within_bounds_and_other_cells(rng, monkeypatch, far):
    monkeypatch.setattr(B, "BLOCK_PROBES", 16)
    monkeypatch.setattr(B, "BLOCK_ROWS", 32)
    centres = rng.normal(size=(6, 4)) * 30
    cells = rng.integers(0, 6, 300)
    x = centres[cells] + rng.normal(size=(300, 4)).round(1) + far
    ids = np.arange(300)[::-1].copy()
    ids[7] = ids[3]  # an id that two rows have
    squared = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    for bound in np.full(300, np.inf), rng.uniform(5, 60, 300), np.sqrt(np.sort(squared, axis=1)[:, 60]):
        probe, place, found = B._search(ids, x, ids, x, 6, bound, cells, cells)
        for i in range(300):
            allowed = (ids != ids[i]) & (cells != cells[i]) & (squared[i] <= bound[i] ** 2 * (1 + 1e-12))
            rows = [j for j in np.lexsort((ids, squared[i])) if allowed[j]][:6]
            own = place[probe == i]
            assert list(ids[own]) == list(ids[rows])
            np.testing.assert_array_equal(found[probe == i], squared[i, own])


def test_rows_without_a_finite_vector_are_no_neighbours(spark):
    rows = [("a", i, [float(i), v]) for i, v in enumerate([0.0, float("nan"), 1.0, float("inf"), 2.0])]
    rows += [("a", 9, None), ("b", 1, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "arm string, row_id long, embedding array<double>")
    found = B.knn(frame, None, KEYS, k=3).collect()
    assert sorted((r.arm, r.probe_id, r.neighbor_id) for r in found) == [
        ("a", p, n) for p in (0, 2, 4) for n in (0, 2, 4) if p != n
    ]


def test_curvature(arms, matrix_frame):
    frame = matrix_frame(**arms)
    found = {r.arm: r.curvature for r in B.curvature(frame, KEYS, None).collect()}
    some = {r.arm: (r.n_rows, r.n_probes) for r in B.curvature(frame, KEYS, 5).collect()}
    assert some == {"hot": (400, 5), "small": (7, 5), "two": (2, 2)}
    for name, x in arms.items():
        conditions = []
        for probe in range(len(x)):
            near = x[brute(x, probe, 10)]
            if len(x) < 3 or len(near) < 2:
                continue
            values = np.linalg.eigvalsh(np.cov(near.T))[::-1][: min(len(near) - 1, x.shape[1])]
            values = values[values > 1e-10]
            if len(values) > 1:
                conditions.append(values.max() / (values.min() + 1e-10))
        expected = np.mean(conditions) if conditions else 0.0
        assert found[name] == pytest.approx(expected, rel=1e-6)


def test_curvature_does_not_change_with_the_scale(matrix_frame, rng):
    x = rng.normal(size=(60, 20))  # more dimensions than neighbours
    frame = matrix_frame(plain=x, large=1024 * x)
    found = {r.arm: r.curvature for r in B.curvature(frame, KEYS, None).collect()}
    assert found["large"] == pytest.approx(found["plain"], rel=1e-6) and found["plain"] < 1e4


def test_arms_of_one_cell_are_not_dealt_out_first(arms, matrix_frame, monkeypatch):
    """Many arms share the tasks: a row of each is copied less often than that of a lone arm."""
    monkeypatch.setattr(B, "PROBE_ROWS", 10)
    parts, small = [], B.broadcast_if_small
    monkeypatch.setattr(B, "broadcast_if_small", lambda df: parts.extend(df.collect()) or small(df))

    def dealt(*_):
        raise AssertionError("rows of one cell need not meet their pivot")

    monkeypatch.setattr(B, "_with_table", dealt)
    x = arms["hot"][:40]
    frame = matrix_frame(**{f"a{i:02d}": x for i in range(12)})
    found = {(r.arm, r.probe_id, r["rank"]): r.neighbor_id for r in B.knn(frame, None, KEYS, k=4).collect()}
    assert all(found[f"a{i:02d}", p, n + 1] == brute(x, p, 4)[n] for i in (0, 11) for p in range(40) for n in range(4))
    blocks = [(r["_m"], r["_b"]) for r in parts if "_m" in r and "_b" in r]
    assert blocks == [(1, 2)] * 12


@pytest.mark.parametrize("far", [0.0, 1e6])
def test_groups_of_many_rows_make_cells_of_their_own(rng, monkeypatch, far):
    x = rng.normal(size=(8, 4))[rng.integers(0, 8, 400)] * 30 + rng.normal(size=(400, 4)).round(1) + far
    x[300:340] = x[0]  # a cell of equal rows
    ids = np.arange(400)[::-1].copy()
    asked = rng.permutation(400)[:150]
    plain = B._search(ids[asked], x[asked], ids, x, 6)
    searched, search = [], B._search
    monkeypatch.setattr(B, "GROUP_ROWS", 100)
    monkeypatch.setattr(B, "_search", lambda *args: searched.append(len(args)) or search(*args))
    probe, place, squared = B._split_search(ids[asked], x[asked], ids, x, 6)
    assert len(searched) > 2
    for i in range(150):
        assert list(ids[place[probe == i]]) == list(ids[plain[1][plain[0] == i]])
        np.testing.assert_array_equal(squared[probe == i], plain[2][plain[0] == i])


def test_curvature_of_arms_in_parts_moves_no_vectors_of_neighbours(arms, matrix_frame, monkeypatch):
    frame = matrix_frame(**arms)
    whole = {r.arm: r.curvature for r in B.curvature(frame, KEYS, None).collect()}
    some = {r.arm: r.curvature for r in B.curvature(frame, KEYS, 50).collect()}
    monkeypatch.setattr(B, "CHUNK_ROWS", 64)
    monkeypatch.setattr(B, "PROBE_ROWS", 12)
    cut = B.curvature(frame, KEYS, None)
    plan = cut._jdf.queryExecution().analyzed().toString()
    assert "neighbor#" not in plan and "_near#" in plan
    assert {r.arm: r.curvature for r in cut.collect()} == pytest.approx(whole, rel=1e-9)
    cut = {r.arm: r.curvature for r in B.curvature(frame, KEYS, 50).collect()}
    assert cut == pytest.approx(some, rel=1e-9)
    again = frame.unionByName(frame.where("row_id % 3 = 0"))  # ids that several rows have
    cut = {r.arm: r.curvature for r in B.curvature(again, KEYS, None).collect()}
    monkeypatch.undo()
    assert cut == pytest.approx({r.arm: r.curvature for r in B.curvature(again, KEYS, None).collect()}, rel=1e-9)


def test_wide_arms_of_many_parts_are_cut_into_cells(matrix_frame, rng, monkeypatch):
    """One cell only where its rows make few parts, as each part of probes meets each part of rows."""
    monkeypatch.setattr(B, "GROUP_ROWS", 50)
    monkeypatch.setattr(B, "CHUNK_ROWS", 20)
    x = np.repeat(rng.normal(size=(10, 6)) * 20, 12, axis=0) + rng.normal(size=(120, 6))
    frame = matrix_frame(wide=x, small=x[:40])
    pivots = {r.arm: r["count"] for r in B._pivots(frame, KEYS, "row_id", "embedding").groupBy("arm").count().collect()}
    assert pivots["wide"] > 1 and pivots["small"] == 1
    rows = B.knn(frame, None, KEYS, k=4).collect()
    found = {(r.arm, r.probe_id, r["rank"]): r.neighbor_id for r in rows}
    for name, own in ("wide", x), ("small", x[:40]):
        assert all([found[name, p, i + 1] for i in range(4)] == brute(own, p, 4) for p in range(len(own)))
