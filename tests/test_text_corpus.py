"""Text records and the representation corpus."""

import pytest
from pyspark.sql import functions as F

from stratalens.functions import text as X
from stratalens.operators import corpus as C
from stratalens.operators.encode import encode_texts, hashed_tokens

RECORD = "id int, text string, sentence string, sentences string, query string, document string, positive array<string>"


def test_record_text_precedence(spark):
    rows = [
        (0, "t", "s", None, "q", None, None),
        (1, None, "s", "x", None, None, None),
        (2, None, None, "many", "q", None, None),
        (3, None, None, None, "q", "d ", ["p"]),
        (4, None, None, None, " q", None, ["p1", "p2"]),
        (5, None, None, None, "only", None, None),
        (6, None, None, None, "q", None, []),
    ]
    columns = ["text", "sentence", "sentences", "query", "document", "positive"]
    found = spark.createDataFrame(rows, RECORD).select("id", X.record_text(columns).alias("t"))
    texts = [r.t for r in found.orderBy("id").collect()]
    assert texts == ["t", "s", "many", "q d", "q p1", "only", "q"]


def test_record_without_text_is_an_error(spark):
    row = spark.createDataFrame([(0,) + (None,) * 6], RECORD)
    with pytest.raises(Exception, match="no text in record"):
        row.select(X.record_text(["text", "query"])).collect()


def test_batches_and_pairs(spark):
    ddl = "id int, sentences array<string>, text array<string>, query array<string>, document array<string>"
    rows = [
        (0, ["a", "b"], ["x"], None, None),
        (1, None, ["x"], None, None),
        (2, None, None, ["q1", "q2"], ["d1", "d2"]),
        (3, None, None, ["q1"], None),
        (4, [], None, None, None),
    ]
    texts = X.batch_texts(["sentences", "text", "query", "document"])
    found = spark.createDataFrame(rows, ddl).select("id", texts.alias("t")).orderBy("id").collect()
    assert [r.t for r in found] == [["a", "b"], ["x"], ["q1 d1", "q2 d2"], ["q1"], []]
    # one text per pair, not the two halves of the first pair
    pairs = spark.createDataFrame([("q", "d "), ("r", "e")], "q string, d string")
    joined = pairs.select(X.pair_text(F.col("q"), F.col("d")).alias("t")).collect()
    assert [r.t for r in joined] == ["q d", "r e"]


SOURCE = "task string, subset string, split string, pos long, text string, sentence1 string, sentence2 string, query string"


@pytest.fixture
def sources(spark):
    def row(task, subset, split, pos, **texts):
        return (task, subset, split, pos, *[texts.get(c) for c in ("text", "sentence1", "sentence2", "query")])

    rows = [
        row("mono", None, "train", 0, text="a"),
        row("mono", None, "train", 1, text=" \t "),
        row("mono", None, "train", 2, text=" a "),
        row("mono", None, "train", 3, text="a"),
        row("mono", None, "test", 4, text="no"),
        row("multi", "fr", "train", 0, sentence1="fr1", sentence2="fr2"),
        row("multi", "de", "train", 1, sentence1="de1", sentence2="de2"),
        row("multi", "aa", "test", 2, sentence1="no"),
        row("testonly", None, "test", 0, query="q"),
        row("subtest", "en", "test", 0, query="e"),
        row("subtest", "en", "dev", 1, query="no"),
        row("neither", None, "dev", 0, text="no"),
        row("both", None, "test", 0, text="top"),
        row("both", "en", "train", 1, text="nested train"),
    ]
    return spark.createDataFrame(rows, SOURCE).repartition(3)


def test_split_choice(sources):
    chosen = {r.task: (r.subset, r.split) for r in C.choose_split(sources).collect()}
    assert chosen == {
        "mono": (None, "train"),
        "multi": ("de", "train"),
        "testonly": (None, "test"),
        "subtest": ("en", "test"),
        "both": ("en", "train"),
    }


def test_corpus_keeps_texts_as_they_are(sources):
    corpus = C.build_corpus(sources)
    ordered = C.in_task_order(corpus, ["multi", "mono", "testonly", "subtest", "both"])
    found = [(r.task, r.text) for r in ordered.collect()]
    assert found == [
        ("multi", "de1"), ("mono", "a"), ("mono", " a "), ("mono", "a"),
        ("testonly", "q"), ("subtest", "e"), ("both", "nested train"),
    ]


def test_corpus_limit_counts_non_blank_texts(sources):
    rows = C.build_corpus(sources, max_per_task=2).where("task = 'mono'").orderBy("pos").collect()
    assert [r.pos for r in rows] == [0, 2]


def test_one_column_per_task_not_per_row(spark):
    ddl = "task string, subset string, split string, pos long, text string, query string"
    rows = [("t", None, "train", 0, "a", "q0"), ("t", None, "train", 1, None, "q1")]
    found = C.build_corpus(spark.createDataFrame(rows, ddl)).collect()
    assert [r.text for r in found] == ["a"]


def test_record_corpus_appends_every_text(spark):
    ddl = "task string, subset string, split string, pos long, title string, text string, sentences array<string>"
    rows = [
        ("t", None, "train", 0, "T", "x", ["s1", " ", "s2"]),
        ("t", None, "train", 1, None, "y", None),
    ]
    found = C.build_record_corpus(spark.createDataFrame(rows, ddl)).orderBy("pos", "part").collect()
    assert [r.text for r in found] == ["x", "s1", "s2", "T x", "y"]


def test_corpus_cache_is_rebuilt_when_it_has_the_wrong_type(spark, sources, tmp_path):
    path = str(tmp_path / "corpus")
    calls = []

    def build():
        calls.append(1)
        return C.build_corpus(sources)

    first = C.cached_corpus(spark, path, build).count()
    assert C.cached_corpus(spark, path, build).count() == first and len(calls) == 1
    spark.range(3).write.mode("overwrite").parquet(path)
    assert C.load_corpus(spark, path) is None
    assert C.load_corpus(spark, str(tmp_path / "none")) is None


def test_encoder_counts_tokens_in_batches(spark):
    texts = ["a b a", "", None, "c\n\nd", "x " * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = encode_texts(rows, ["id"], load=lambda: hashed_tokens(16), batch_size=2)
    sums = {r.id: sum(r.embedding) for r in found.collect()}
    assert sums == {0: 3.0, 1: 0.0, 2: 0.0, 3: 2.0, 4: 5000.0}
    assert encode_texts(rows.limit(0), ["id"]).count() == 0


def test_encoder_is_loaded_once_per_task(spark):
    def load():
        loaded = []

        def encode(texts):
            import numpy as np

            loaded.append(1)
            return np.full((len(texts), 2), len(loaded), dtype=float)

        return encode

    rows = spark.range(10).selectExpr("id", "'t' AS text").coalesce(1)
    found = encode_texts(rows, ["id"], load=load, batch_size=3).collect()
    assert max(r.embedding[0] for r in found) == 4
