"""The representation corpus: texts of every task's chosen split, in task order.

Source rows are ``task, subset, split, pos`` and any text columns; ``subset`` is NULL for tasks
without language subsets. ``pos`` orders the rows of a task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CORPUS_COLUMNS, RECORD_KEYS
from ..functions.text import joined, not_blank
from ..session import broadcast_if_small
from .ranking import positions, top_rows

CACHE_COLUMNS = {"task": "string", "pos": "bigint", "text": "string"}


def _preference(split: str, order: Column) -> Column:
    return F.struct(
        (F.col("split") != split).alias("other"),
        F.col("subset").isNotNull().alias("nested"),
        order.alias("ord"),
        "subset",
        "split",
    )


def _choices(sources: DataFrame, split: str, columns: Sequence[str]) -> DataFrame:
    """Per task the split to read and the first of ``columns`` that has a value in it."""
    order = F.col("subset_ord") if "subset_ord" in sources.columns else F.col("subset")
    filled = [F.when(F.col(c).isNotNull(), i) for i, c in enumerate(columns)]
    column = F.min(F.coalesce(*filled) if filled else F.lit(None).cast("int"))
    splits = (
        sources.where(F.col("split").isin(split, "test"))
        .groupBy("task", "subset", "split", order.alias("_ord"))
        .agg(column.alias("column"))
    )
    best = F.min_by(
        F.struct("subset", "split", "column"), _preference(split, F.col("_ord"))
    ).alias("c")
    return splits.groupBy("task").agg(best).select("task", "c.*")


def choose_split(sources: DataFrame, split: str = "train") -> DataFrame:
    """``(task, subset, split)`` to read per task: the wanted split, then its first language
    subset, then ``test`` likewise. Tasks with neither are left out."""
    return _choices(sources, split, []).drop("column")


def split_rows(sources: DataFrame, split: str, columns: Sequence[str] = ()) -> DataFrame:
    """Source rows of each task's chosen split, with the index of its text column. The choices,
    one row per task, go to the texts so that these are not shuffled."""
    chosen = _choices(sources, split, columns).toDF("_task", "_subset", "_split", "_column")
    same = (
        (F.col("task") == F.col("_task"))
        & F.col("subset").eqNullSafe(F.col("_subset"))
        & (F.col("split") == F.col("_split"))
    )
    return sources.join(broadcast_if_small(chosen), same).drop("_task", "_subset", "_split")


def _limited(texts: DataFrame, limit: int | None, order: Sequence[str]) -> DataFrame:
    if limit is None:
        return texts
    return top_rows(texts, ["task"], [F.col(c) for c in order], limit, "_n").drop("_n")


def build_corpus(
    sources: DataFrame, split: str = "train", max_per_task: int | None = None
) -> DataFrame:
    """``(task, pos, text)``: non-blank texts of the first text column each task has.

    A column counts as there when any row of the task's split has a value in it. Texts are kept as
    they are, duplicates too.
    """
    columns = [name for name in CORPUS_COLUMNS if name in sources.columns]
    rows = split_rows(sources, split, columns)
    text = F.coalesce(*[F.when(F.col("_column") == i, F.col(c)) for i, c in enumerate(columns)])
    texts = rows.select("task", "pos", text.alias("text"))
    return _limited(texts.where(not_blank(F.col("text"))), max_per_task, ["pos"])


def build_record_corpus(
    sources: DataFrame, split: str = "train", max_per_task: int | None = None
) -> DataFrame:
    """``(task, pos, part, text)`` from records: every text field of a record counts, lists are
    flattened, and a record with title and text adds both joined."""
    rows = split_rows(sources, split)
    kinds = dict(rows.dtypes)
    parts = []
    for name in RECORD_KEYS:
        if kinds.get(name) == "string":
            parts.append(F.array(F.col(name)))
        elif name in kinds:
            parts.append(F.coalesce(F.col(name), F.array().cast("array<string>")))
    if {"title", "text"} <= set(kinds):
        title_and_text = F.when(
            F.col("title").isNotNull() & F.col("text").isNotNull(), joined(F.col("title"), F.col("text"))
        )
        parts.append(F.array(title_and_text))
    texts = rows.select("task", "pos", F.posexplode_outer(F.concat(*parts)).alias("part", "text"))
    return _limited(texts.where(not_blank(F.col("text"))), max_per_task, ["pos", "part"])


def in_task_order(corpus: DataFrame, tasks: Sequence[str], place: str | None = None) -> DataFrame:
    """The corpus as one sequence: tasks as listed, then position; as ``place`` where each text stands
    in it, from 1."""
    order = F.array_position(F.lit(list(tasks)), F.col("task"))
    inner = [F.col(c) for c in ("pos", "part") if c in corpus.columns]
    listed = corpus.where(order > 0)
    return positions(listed, [order, *inner], name=place) if place else listed.orderBy(order, *inner)


def load_corpus(spark: SparkSession, path: str) -> DataFrame | None:
    """The cached corpus, or None if it is absent or of another type."""
    try:
        cached = spark.read.parquet(path)
    except AnalysisException:
        return None
    return cached if CACHE_COLUMNS.items() <= dict(cached.dtypes).items() else None


def cached_corpus(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the corpus from its cache, or build it and cache it."""
    cached = load_corpus(spark, path)
    if cached is None:
        build().write.mode("overwrite").parquet(path)
        cached = spark.read.parquet(path)
    return cached

