"""Helpers of the training-data operators: tables, scratch folders, words, state of a worker."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder

#: White space of the word rule ``[^\x20\x09-\x0D]+``, without the space itself.
BREAKS = "\t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of a few small files over all cores; larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut, columns are still pruned."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def worker_state(key: str, make):
    """What a Python worker keeps from task to task, one thing at a time: what an earlier stage left
    goes when the next one needs another. Task functions are sent by value, so their module's globals
    would be new in every task."""
    module = sys.modules.setdefault("_stratalens_worker", types.ModuleType("_stratalens_worker"))
    kept = module.__dict__.setdefault("kept", {})
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


def words(text: str) -> list[str]:
    """The matches of ``[^\x20\x09-\x0D]+``."""
    for c in BREAKS:
        if c in text:
            text = text.replace(c, " ")
    found = text.split(" ")
    return [w for w in found if w] if "" in found else found


def groups_of(texts: list[str], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Consecutive texts of about ``chars`` characters together, as (first, end)."""
    first = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= chars:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def texts_of(column: pa.Array) -> list[str]:
    """Null becomes the empty text."""
    return [t or "" for t in column.to_pylist()]


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)],
        schema=schema,
    )


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all given runs, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def by_group(df: DataFrame, key: str, run, kinds: str, rows: int = 20_000) -> DataFrame:
    """``run(chunk, starts)`` for whole groups of equal ``key``: ``chunk`` holds the rows of some
    groups, one after the other, ``starts`` where each begins and where the last ends. Yields batches.

    For bounded groups only. Rows are shuffled and sorted by key and pass in batches, so small groups
    cost no call each.
    """
    at = df.columns.index(key)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cut(whole: pa.Table, last: bool):
            keys = whole.column(at).combine_chunks()
            new = np.flatnonzero(np.asarray(pa.compute.not_equal(keys[1:], keys[:-1]))) + 1
            starts = np.concatenate(([0], new, [len(keys)] if last else []))
            done = whole.slice(0, int(starts[-1]))
            return done, starts.astype(np.int64), whole.slice(int(starts[-1]))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= rows:
                done, starts, rest = cut(pa.Table.from_batches(held), False)
                if done.num_rows:
                    yield from run(done.combine_chunks(), starts)
                held = rest.combine_chunks().to_batches()
        if held:
            done, starts, _ = cut(pa.Table.from_batches(held), True)
            yield from run(done.combine_chunks(), starts)

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(apply, kinds)
