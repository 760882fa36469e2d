"""Whitening and product codes against plain numpy on whole small tables."""

import hashlib

import numpy as np
import pytest

from stratalens.llm import vector_codes, whitening

SCHEMA = "vec_id long, embedding array<double>, label int, x array<int>, code string, width int, n int"


def rows_of(matrix, first=0, labels=3):
    return [
        (first + i, [float(v) for v in row], i % labels if i % 5 else None, [1], "c", 7, 8)
        for i, row in enumerate(matrix)
    ]


def odd_rows(rng):
    """Rows that count, and rows that do not: null, empty, null or infinite entries, other lengths."""
    good = rows_of(rng.normal(size=(60, 24)) * np.linspace(2, 0.3, 24))
    good += good[:5] + [(None, *good[7][1:]), (None, *good[8][1:]), (100, *good[9][1:])]
    bad = [None, [], [None] * 24, [float("nan")] * 24, [float("inf")] + [0.0] * 23, [1.0] * 23, [2.0]]
    return good, good + [(200 + i, v, 1, [2], "d", 9, 9) for i, v in enumerate(bad)]


def plain_whitening(matrix):
    x = np.floor(1024 * matrix).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    deviation = ((n * x.astype(object) - sums) ** 2).sum(axis=1)
    return n, deviation, centred @ vectors / np.sqrt(np.abs(values)), values / values.sum()


@pytest.mark.parametrize("spread", [1.0, 0.02])
def test_whitening_is_that_of_all_eigenvectors(spark, rng, spread):
    """Also where the spectrum is nearly flat, and where it falls steeply."""
    matrix = rng.normal(size=(700, 48)) * np.linspace(1, spread, 48) + 3
    frame = spark.createDataFrame(rows_of(matrix), SCHEMA).repartition(5)
    got = whitening.whitening_digest(frame).toPandas().sort_values(["vec_id", "component"])
    n, deviation, whole, explained = plain_whitening(matrix)
    assert len(got) == 700 * 8 and set(got.n) == {n}
    assert got.deviation[got.component == 1].tolist() == deviation.tolist()
    ours = got.whitened.to_numpy().reshape(700, 8)
    sign = np.sign((ours * whole[:, :8]).sum(axis=0))
    assert np.abs(ours - whole[:, :8] * sign).max() < 1e-9
    assert got.explained[:8].tolist() == pytest.approx(explained[:8].tolist(), rel=1e-12)
    assert got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-10


def test_whitening_of_odd_rows(spark, rng):
    good, everything = odd_rows(rng)
    got = whitening.whitening_digest(spark.createDataFrame(everything, SCHEMA).repartition(3)).collect()
    n, deviation, whole, _ = plain_whitening(np.array([r[1] for r in good]))
    assert {r.n for r in got} == {n} and len(got) == 8 * len(good)
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == sorted(
        (r[0] is None, r[0] or 0) for r in good for _ in range(8)
    )
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviation.tolist())
    ours = sorted(abs(r.whitened) for r in got if r.component == 3)
    assert ours == pytest.approx(sorted(np.abs(whole[:, 2]).tolist()), abs=1e-9)


def test_no_component_without_variance(spark):
    one = [(1, [0.5, 0.25], 0, [1], "c", 1, 1)]
    for rows in ([], one, one * 4, [(1, None, 0, [1], "c", 1, 1)]):
        assert whitening.whitening_digest(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_only_components_of_some_variance(spark, rng):
    """Two directions of 24 vary, and one vector fills a third of the rows."""
    matrix = np.outer(rng.normal(size=90), np.arange(24) % 2) + np.outer(rng.normal(size=90), np.arange(24) < 3)
    matrix[:30] = matrix[0]
    frame = spark.createDataFrame([(v.tolist(),) for v in matrix], "v array<double>")
    found = whitening.principal_components(frame, "v")
    assert len(found.values) == 2 and found.n == 90
    values = np.linalg.eigvalsh(np.cov(matrix.T, bias=True))[::-1]
    assert found.values == pytest.approx(values[:2], rel=1e-12)
    rows = whitening.whitened(frame, "v", found, []).collect()
    assert {len(r.whitened) for r in rows} == {2}
    assert whitening.identity_error(whitening.counting(frame, "v"), found) < 1e-10


def test_a_deviation_beyond_a_long_is_null(spark):
    rows = [(i, [float(v), 0.0], 0, [1], "c", 1, 1) for i, v in enumerate([0, 2.0**27, 2.0**31, 1, 5])]
    got = {r.vec_id: r.deviation for r in whitening.whitening_digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    x = [1024 * int(r[1][0]) + 100_000 for r in rows]
    exact = [(5 * v - sum(x)) ** 2 for v in x]
    assert got == {i: e if e < 1 << 63 else None for i, e in enumerate(exact)}


def plain_codes(rows):
    """The contract, row by row. ``rows`` as (vec_id, vector, label)."""
    width = len(rows[0][1])
    sizes = [width // 8 + (p < width % 8) for p in range(8)]
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    x = np.array([[int(np.floor(4096 * c)) for c in r[1]] for r in rows], dtype=object)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, x[i].tolist()))
    books = [[x[i][a:b].tolist() for i in order[:16]] for a, b in zip(cuts, cuts[1:])]

    def nearest():
        out = []
        for book, a, b in zip(books, cuts, cuts[1:]):
            off = [[sum((u - w) ** 2 for u, w in zip(row[a:b], e)) for e in book] for row in x]
            out.append([(min(o), o.index(min(o))) for o in off])
        return out

    for _ in range(6):
        for book, found, a, b in zip(books, nearest(), cuts, cuts[1:]):
            for e in range(len(book)):
                own = [x[i][a:b] for i, (_, k) in enumerate(found) if k == e]
                if own:
                    book[e] = [sum(c) // len(own) for c in zip(*own)]
    found = nearest()
    codes = ["".join(f"{part[i][1]:02x}" for part in found) for i in range(len(rows))]
    errors = [sum(part[i][0] for part in found) for i in range(len(rows))]
    total = {}
    for r, e in zip(rows, errors):
        total[r[2]] = total.get(r[2], 0) + e
    text = ",".join(str(v) for book in books for entry in book for v in entry)
    digest = hashlib.sha256(text.encode()).hexdigest()
    key = lambda t: tuple((v is None, v if v is not None else 0) for v in t)
    return sorted(((r[0], c, e, total[r[2]], digest) for r, c, e in zip(rows, codes, errors)), key=key)


def coded(frame):
    rows = vector_codes.product_codes(frame)
    key = lambda t: tuple((v is None, v if v is not None else 0) for v in t)
    columns = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in rows.select(*columns).collect()), key=key)


def test_codes_of_odd_rows(spark, rng, monkeypatch):
    """In blocks of a few rows as in one block."""
    good, everything = odd_rows(rng)
    want = plain_codes([r[:3] for r in good])
    frame = spark.createDataFrame(everything, SCHEMA).repartition(3)
    assert coded(frame) == want
    monkeypatch.setattr(vector_codes, "BLOCK", 7 * 24)
    assert coded(frame) == want


@pytest.mark.parametrize("n, width", [(9, 16), (50, 11), (40, 5)])
def test_codes_of_few_rows_and_uneven_parts(spark, rng, n, width):
    rows = rows_of(rng.normal(size=(n, width)))
    rows[3:6] = [(r[0], rows[0][1], *r[2:]) for r in rows[3:6]]
    assert coded(spark.createDataFrame(rows, SCHEMA)) == plain_codes([r[:3] for r in rows])


def test_codes_of_nothing(spark):
    assert coded(spark.createDataFrame([], SCHEMA)) == []
    assert coded(spark.createDataFrame([(1, None, 1, [1], "c", 1, 1)], SCHEMA)) == []


def test_entries_beyond_the_limit_count_as_the_limit(spark):
    limit = 2**30 // 4
    rows = [(i, [3e30 * s] + [0.0] * 15, 0, [1], "c", 1, 1) for i, s in enumerate([1, -1, 1])]
    got = coded(spark.createDataFrame(rows, SCHEMA))
    small = [(r[0], [np.sign(r[1][0]) * limit / 4096, *r[1][1:]], 0) for r in rows]
    assert got == plain_codes(small)


def test_totals_of_a_frequent_key(spark, monkeypatch):
    """Met by shuffle, in shares."""
    monkeypatch.setattr(vector_codes, "broadcast_if_small", lambda df: df)
    rows = [(i, None if i % 3 == 0 else i % 7, i) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, error long")
    want = {}
    for _, label, error in rows:
        want[label] = want.get(label, 0) + error
    got = vector_codes.with_total(frame, "label", "error", "total").collect()
    assert len(got) == 300 and all(r.total == want[r.label] for r in got)
    huge = spark.createDataFrame([(1, 1, 2**62), (2, 1, 2**62)], frame.schema)
    assert {r.total for r in vector_codes.with_total(huge, "label", "error", "total").collect()} == {None}
