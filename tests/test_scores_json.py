"""Scores and metrics out of result JSON."""

import json
import random

import pytest
from pyspark.sql import functions as F

from stratalens.functions import scores as S
from stratalens.operators import metric_tables as M
from stratalens.operators.score_search import search_scores


def column(spark, texts, expression):
    rows = [(i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "i int, content string")
    picked = frame.select("i", expression.alias("x")).orderBy("i")
    return [r.x for r in picked.collect()]


def doc(**splits):
    return json.dumps({"scores": splits})


DOCUMENTS = {
    doc(dev=[{"main_score": 0.1}], test=[{"main_score": 0.2}]): 0.2,
    doc(dev=[{"main_score": 0.1}], validation=[{"main_score": 0.3}]): 0.3,
    # any split is tried, not only the first in document order
    doc(aux=[], other=[{"main_score": 4}]): 4.0,
    doc(test=[{"main_score": "0.7"}]): None,
    doc(test=[{"main_score": True}]): 1.0,
    doc(test=[{"main_score": None}], dev=[{"main_score": 0.5}]): 0.5,
    doc(test=[]): None,
    doc(test="x", odd={"main_score": 1}): None,
    doc(test=[[1, 2]]): None,
    "{}": None,
    '{"scores": 3}': None,
    "{bad": None,
    "[]": None,
    '{"scores":{"test":[{"main_score":NaN}]}}': None,
    json.dumps({"task_results": [{"scores": {"test": [{"main_score": 0.9}]}}]}): 0.9,
}


def test_main_score_of_many_shapes(spark):
    found = column(spark, list(DOCUMENTS), S.main_score(F.col("content")))
    assert found == list(DOCUMENTS.values())


def test_split_preferences(spark):
    text = doc(
        first=[{"main_score": 1.0}], default=[{"main_score": 2.0}], dev=[{"main_score": 3.0}]
    )
    expected = {S.DEFAULT_SPLITS: 3.0, S.AVERAGE_SPLITS: 2.0, S.DOCUMENT_ORDER: 1.0}
    for preferred, score in expected.items():
        assert column(spark, [text], S.main_score(F.col("content"), preferred)) == [score]


SEARCHED = [
    ({"score": 0.4, "main_score": 0.5}, 0.5),
    ({"a": {"b": {"c": {"d": {"accuracy": 0.25}}}}}, 0.25),
    ([{"note": "n"}, [{"spearman": 3}]], 3.0),
    ({"a": {"scores": {"odd": [{"main_score": 0.75}]}}}, 0.75),
    ({"score": "0.5", "x": [True, {"cos_sim": True}]}, 1.0),
    ({"a": [1, 2, "x"]}, None),
    (None, None),
]


def test_search_walks_any_depth(spark):
    want = {i: score for i, (_, score) in enumerate(SEARCHED) if score is not None}
    assert searched(spark, [json.dumps(document) for document, _ in SEARCHED]) == want
    assert [walked(document) for document, _ in SEARCHED] == [score for _, score in SEARCHED]


def searched(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    return {r.i: r.score for r in search_scores(frame, "i").collect()}


def walked(document):
    """Depth first, in document order."""
    number = lambda v: isinstance(v, (int, float))
    pending = [document]
    while pending:
        node = pending.pop()
        if isinstance(node, list):
            pending += node[::-1]
        if not isinstance(node, dict):
            continue
        splits = node["scores"] if isinstance(node.get("scores"), dict) else {}
        order = [splits[n] for n in S.DEFAULT_SPLITS if n in splits] + list(splits.values())
        heads = [x[0] for x in order if isinstance(x, list) and x and isinstance(x[0], dict)]
        own = [h.get("main_score") for h in heads] + [node.get(k) for k in S.SCORE_KEYS]
        own = [float(v) for v in own if number(v)]
        if own:
            return own[0]
        pending += list(node.values())[::-1]
    return None


def test_search_skips_null_and_bad_text(spark):
    assert searched(spark, [None, "{bad", "", "3", '"score"']) == {}


def test_search_walks_random_documents_in_order(spark):
    pick = random.Random(5)
    names = ["zz", "b", "score", "accuracy", "scores", "test", "main_score", "dev"]

    def made(depth):
        kind = pick.randrange(6 if depth else 3)
        if kind < 3:
            return pick.choice([1, 0.5, "0.5", '{"score": 9}', None, True, "t"]) if pick.random() < 0.3 else "s"
        if kind == 3:
            return [made(depth - 1) for _ in range(pick.randrange(4))]
        return {n: made(depth - 1) for n in pick.sample(names, pick.randrange(5))}

    documents = [made(pick.randrange(2, 9)) for _ in range(700)]
    want = {i: s for i, d in enumerate(documents) if (s := walked(d)) is not None}
    assert searched(spark, [json.dumps(d) for d in documents]) == want and len(want) > 40


def test_search_goes_as_deep_as_the_reader(spark):
    deep = [f'{{"a":{"[" * n}{{"score": {n}}}{"]" * n}}}' for n in (3, 8, 20)]
    far = "[" * 100_000 + "]" * 100_000
    assert searched(spark, [*deep, far]) == {0: 3.0, 1: 8.0, 2: 20.0}


def test_all_scores_keeps_first_objects_in_order(spark):
    text = doc(zz=[{"b": 1, "a": 0.5}, {"b": 2}], bad=[1], test=[{"main_score": 0.2}], none=[])
    found = column(spark, [text, doc(test=[])], S.all_scores(F.col("content")))
    assert json.loads(found[0]) == {"zz": {"a": 0.5, "b": 1}, "test": {"main_score": 0.2}}
    assert list(json.loads(found[0])) == ["zz", "test"]
    assert found[1] is None


@pytest.fixture
def scores(spark):
    texts = [
        {"test": {"acc": 0.5, "flag": True, "hits": [1, 2, "x", 3], "score_f1": 1, "s": "t"}},
        {"zz": {"acc_mean": 0.25, "gone": None}, "aa": {"acc": 9}},
        {"zz": 3, "validation": {"words": ["a"], "deep": {"x": 1}}},
    ]
    rows = [("r", i, f"t{i}", json.dumps(t)) for i, t in enumerate(texts)]
    rows += [("r", 3, "t3", "{bad"), ("r", 4, "t4", None)]
    return spark.createDataFrame(rows, "revision string, layer int, task string, all_scores string")


def test_metrics_long(scores):
    rows = M.metrics_long(scores).orderBy("layer", "metric_name").collect()
    assert [(r.layer, r.metric_name, r.metric_value) for r in rows] == [
        (0, "acc", 0.5),
        (0, "flag", 1.0),
        (0, "hits_mean", 2.0),
        (0, "score_f1", 1.0),
        (1, "acc_mean", 0.25),
    ]
    plain = M.metrics_long(scores, lists=False)
    assert plain.where("metric_name = 'hits_mean'").count() == 0


def test_metrics_wide_has_a_column_per_numeric_metric(scores):
    wide = M.metrics_wide(scores)
    added = [c for c in wide.columns if c not in scores.columns]
    assert added == [
        "score_acc", "score_acc_mean", "score_flag", "score_gone", "score_hits_mean", "score_f1",
    ]
    rows = wide.orderBy("layer").collect()
    assert len(rows) == 5
    assert rows[0].score_hits_mean == 2.0 and rows[0].score_f1 == 1.0
    # a metric whose own name ends in _mean is found under its own name
    assert rows[1].score_acc_mean == 0.25 and rows[1].score_acc is None
    assert all(rows[4][c] is None for c in added)


def test_metric_availability_keeps_tasks_without_metrics(scores):
    rows = M.metric_availability(scores, M.metrics_long(scores)).orderBy("task").collect()
    assert [(r.task, r.n_metrics) for r in rows] == [
        ("t0", 4), ("t1", 1), ("t2", 0), ("t3", 0), ("t4", 0),
    ]
    assert rows[0].available_metrics == "acc, flag, hits_mean, score_f1"
