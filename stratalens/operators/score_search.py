"""The first score anywhere in a JSON document, level by level over all documents at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import DEFAULT_SPLITS, SCORE_KEYS, is_list, is_object, number_of, split_score
from ..session import written

#: Levels that are walked in one stage before what is still open is written.
LEVELS = 2

_CHILDREN = "array<struct<path:array<int>,text:string>>"


def _starts(text: Column, sign: str) -> Column:
    return F.ltrim(text).startswith(sign)


def _node_score(text: Column, fields: Column) -> Column:
    """The score that an object itself carries: of its splits, else under one of the score keys."""
    direct = [number_of(F.try_element_at(fields, F.lit(key))) for key in SCORE_KEYS]
    splits = F.from_json(text, "scores map<string,variant>")["scores"]
    split = F.when(F.map_contains_key(fields, F.lit("scores")), split_score(splits, DEFAULT_SPLITS))
    return F.coalesce(split, *direct)


def _children(path: Column, text: Column, fields: Column) -> Column:
    """The objects and lists directly inside, in document order, each with its place."""

    def listed(values: Column, kinds: Column) -> Column:
        both = F.transform(
            F.arrays_zip(values.alias("v"), kinds.alias("k")),
            lambda x, i: F.struct(
                F.concat(path, F.array(i)).alias("path"),
                F.when((is_object(x["k"]) | is_list(x["k"])) & _may_hold(x["v"]), x["v"]).alias("text"),
            ),
        )
        return F.filter(both, lambda c: c["text"].isNotNull())

    named = listed(F.map_values(F.from_json(text, "map<string,string>")), F.map_values(fields))
    items = listed(F.from_json(text, "array<string>"), F.from_json(text, "array<variant>"))
    none = F.array().cast(_CHILDREN)
    found = F.when(fields.isNotNull(), named).when(_starts(text, "["), items)
    return F.coalesce(found.cast(_CHILDREN), none)


def _may_hold(text: Column) -> Column:
    """Texts in which no score key is spelt hold no score; an escape may spell anything."""
    return F.contains(text, F.lit("\\")) | text.rlike("|".join(f'"{key}"' for key in SCORE_KEYS))


class _Walk:
    """The expressions of a level, built once: they name columns, so every level takes the same ones."""

    def __init__(self) -> None:
        text, fields = F.col("text"), F.col("_fields")
        alone = F.array(F.struct("path", F.lit(None).cast("string").alias("text")))
        open_node = F.when(text.isNotNull(), _children(F.col("path"), text, fields))
        self.following = F.explode(open_node.otherwise(alone.cast(_CHILDREN))).alias("c")
        self.fields = F.when(_starts(text, "{"), F.from_json(text, "map<string,variant>"))
        self.score = F.coalesce("score", _node_score(text, fields))
        self.closed = F.when(F.col("score").isNull(), text)

    def scored(self, nodes: DataFrame) -> DataFrame:
        """What lies inside a node with a score comes after it, so it is not looked at."""
        nodes = nodes.withColumn("_fields", self.fields)
        return nodes.withColumn("score", self.score).withColumn("text", self.closed)

    def step(self, nodes: DataFrame) -> DataFrame:
        """Open nodes become their children, of which those with a score are found; others stay."""
        moved = nodes.select("_key", "score", self.following)
        return self.scored(moved.select("_key", "score", "c.path", "c.text"))


def search_scores(documents: DataFrame, key: str, content: str = "content") -> DataFrame:
    """``(key, score)`` of the documents that hold a score anywhere; ``key`` tells them apart.

    The first score in document order counts, an object before what it contains: the hit whose path of
    positions is the least. A stage walks several levels without a shuffle; objects and lists that are
    still open are written and walked on, until there are none. Texts that Spark's reader does not take
    for JSON (also those nested beyond its 1,000 levels) hold no score.
    """
    text = F.col(content)
    root = documents.where(text.isNotNull() & _may_hold(text)).select(
        F.col(key).alias("_key"),
        F.lit(None).cast("double").alias("score"),
        F.array().cast("array<int>").alias("path"),
        text.alias("text"),
    )
    walk, hits = _Walk(), []
    nodes = walk.scored(root)
    while True:
        for _ in range(LEVELS):
            nodes = walk.step(nodes)
        nodes = written(nodes.drop("_fields"), "score-search")
        hits.append(nodes.where("score IS NOT NULL").select("_key", "path", "score"))
        nodes = nodes.where("text IS NOT NULL")
        if nodes.isEmpty():
            break
        nodes = walk.scored(nodes)
    found = reduce(DataFrame.unionByName, hits)
    return found.groupBy(F.col("_key").alias(key)).agg(F.min_by("score", "path").alias("score"))
