"""The stages one by one, each against what it should do with its input."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratalens.llm import line_crf, secret_scan
from stratalens.llm.common import stored

from .test_similar import brute, contained, shingles
from .test_secrets import spans

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    # the smallest table holds no secret in a document that is kept
    leaked = docs.where("lang = 'en' AND n_chars BETWEEN 2000 AND 4000").orderBy("doc_id").limit(3)
    backwards = F.concat_ws(" ", F.reverse(F.split("text", " ")))
    leaked = leaked.withColumns(
        {"text": F.concat(backwards, F.lit(" password = hunter2222")), "doc_id": F.col("doc_id") + 10_000}
    ).withColumn("n_chars", F.length("text").cast("long"))
    out = [stored(docs.unionByName(leaked), "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], FOLDER), name))
    return out


def rows(frame):
    return Counter(map(tuple, frame.collect()))


def test_columns_stay(results):
    for frame in results[1:-1]:
        assert frame.schema == results[0].schema


def test_quality_stage(spark, results):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    field = line_crf.train(results[0], labels)
    good = {r["doc_id"] for r in line_crf.score(results[0].select("doc_id", "text"), field).collect() if r["score"] >= 0.5}
    assert rows(results[1]) == rows(results[0].where(results[0].doc_id.isin(good)))
    assert 0 < len(good) < results[0].count()


def test_near_duplicate_stage(results):
    before = [(r["doc_id"], r["text"]) for r in results[1].collect()]
    some = [b for b in before if shingles(b[1])]
    least = {d: c for d, c, _ in brute(some)}
    kept = {r["doc_id"] for r in results[2].collect()}
    assert kept == {d for d, _ in before if least.get(d, d) == d} and len(kept) < len(before)


def test_decontamination_stage(spark, results):
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    before = [(r["doc_id"], r["text"]) for r in results[2].collect()]
    bad = {k[0] for k in contained(before, items)}
    assert {r["doc_id"] for r in results[3].collect()} == {d for d, _ in before} - bad and bad


def test_secret_stage(results):
    before = {r["doc_id"]: r["text"] for r in results[3].collect()}
    changed = 0
    for r in results[4].collect():
        assert not spans(r["text"]) or secret_scan.MASK in r["text"]
        found = spans(before[r["doc_id"]])
        changed += bool(found)
        assert (r["text"] == before[r["doc_id"]]) == (not found)
        assert r["n_chars"] == len(r["text"])
    assert results[4].count() == len(before) and changed


def test_packing_stage(results):
    docs = {r["doc_id"] for r in results[4].collect()}
    pieces = results[5].collect()
    assert {r["doc_id"] for r in pieces} == docs
    ends = {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096
    assert re.fullmatch(r"[a-z_]+", corpus_pipeline.STAGES[0][0])


def test_odd_rows_pass_all_stages(spark, odd, nothing):
    for frame in (odd, nothing):
        docs = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stored(stage(spark, docs, FOLDER), f"odd-{name}")
            assert docs.schema == frame.schema
        corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count()
