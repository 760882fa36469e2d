"""The field on sums over all labellings, on held-out documents and on odd tables."""

import itertools
import zlib

import numpy as np
import pytest

from stratalens.llm import line_crf

from .conftest import odd_rows


def test_forward_backward_is_the_sum_over_labellings():
    rng = np.random.default_rng(3)
    counts = np.array([1, 4, 2, 3])
    score, link = rng.normal(size=10), rng.normal(size=(2, 2))
    good, pairs, log_z = line_crf.forward_backward(score, counts, link)
    at, total, every = 0, 0.0, np.zeros((2, 2))
    for n in counts:
        weights, marginal, moves = 0.0, np.zeros(n), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=int(n)):
            value = sum(score[at + i] for i, y in enumerate(labels) if y)
            value += sum(link[a, b] for a, b in zip(labels, labels[1:]))
            w = np.exp(value)
            weights += w
            marginal += w * np.array(labels)
            for a, b in zip(labels, labels[1:]):
                moves[a, b] += w
        assert good[at : at + n] == pytest.approx(marginal / weights)
        every += moves / weights
        total += np.log(weights)
        at += n
    assert pairs == pytest.approx(every)
    assert log_z == pytest.approx(total)


def test_measures_by_hand():
    texts = ["Ab cd cd.\n\n## 1 #\nAb cd cd.", ""]
    measures, chars, counts = line_crf.line_measures(texts)
    assert counts.tolist() == [4, 1] and chars.tolist() == [9, 0, 6, 9, 0]
    m = {n: measures[:, i] for i, n in enumerate(line_crf.MEASURES)}
    assert np.expm1(m["words"]).round().tolist() == [3, 0, 3, 3, 0]
    assert m["upper"][0] == pytest.approx(1 / 6)
    assert m["symbols"][2] == pytest.approx(3 / 6)
    assert m["distinct_words"].tolist() == pytest.approx([1.0, 0, 1.0, 1.0, 0])
    assert line_crf.line_measures(["a b a b"])[0][0, line_crf.MEASURES.index("distinct_words")] == 0.5
    assert m["repeated_line"].tolist() == [1, 0, 0, 1, 0]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = line_crf.quality_scores(docs, labels).collect()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert len(rows) == docs.count()
    for r in rows[:200]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 80
    assert np.mean([a == b for a, b in held]) > 0.95


def test_odd_rows_and_labels(spark, odd, nothing):
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 0, 0), (4, None, 0), (None, 1, 0), (9, 1, 0), (7, 0, 0), (14, 0, 0), (99, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    rows = line_crf.quality_scores(odd, labels).collect()
    assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(str(r[0]) for r in odd_rows())
    assert all(0 <= r["score"] <= 1 for r in rows)
    same = {r["score"] for r in rows if r["doc_id"] in (1, 2)}
    assert len(same) == 1
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert line_crf.quality_scores(nothing, labels).count() == 0
    none = line_crf.quality_scores(odd, labels.where("false")).collect()
    assert {r["score"] for r in none} == {0.5}


def test_accepted_keeps_columns(odd, spark):
    kept = line_crf.accepted(odd, None)
    assert kept.schema == odd.schema and kept.count() == odd.count()


def test_training_rows_are_bounded(spark, monkeypatch):
    """A labelled id that a third of the rows share, copies of one text, and a text of very many lines."""
    rows = [(0, f"some text {i}\nand more of it") for i in range(3000)] + [(0, "a copy")] * 1500
    rows += [(i, f"text {i}") for i in range(1, 3000)] + [(1, "x\n" * 50_000), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(3000)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(line_crf, "fit", lambda measures, chars, counts, truth: seen.append((counts, truth)))
    line_crf.train(docs, labels, 500, 800)
    line_crf.train(docs, labels, 100_000, 1_000_000)
    (few, truth), (every, _) = seen
    assert len(few) == len(truth) <= 500 and few.sum() <= 800
    known = {(d, t or "") for d, t in rows if zlib.crc32(str(d).encode()) % 3 != 1}
    assert len(every) == len(known) and every.sum() == sum(t.count("\n") + 1 for _, t in known)
