"""A corpus cache that knows what it was built from.

The rows lie in a folder of their own name; a manifest, written last, names that folder, its columns and
number of rows, and the fingerprint of the sources. A cache is good if the manifest can be read, its
fingerprint is that of the sources, and the folder holds the rows it tells of. Any other is built anew
beside the old one, and the new manifest takes its place; readers of the old rows are not disturbed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "folder string, columns string, n_rows long, fingerprint string, made long"


def fingerprint(sources: DataFrame) -> str:
    """Of all rows in any order: their number and the sum of their hashes, in one pass."""
    wide = F.xxhash64(*[F.col(f"`{c}`") for c in sources.columns]).cast("decimal(38, 0)")
    row = sources.agg(F.count(F.lit(1)).alias("n"), F.sum(wide).alias("sum")).first()
    return f"{','.join(f'{n}:{t}' for n, t in sources.dtypes)}|{row['n']}|{row['sum']}"


def _manifest(spark: SparkSession, path: str):
    try:
        rows = spark.read.schema(MANIFEST).json(f"{path}/manifest")
        return rows.where("folder IS NOT NULL").orderBy(F.desc("made")).first()
    except AnalysisException:
        return None


def _columns(df: DataFrame) -> str:
    return ",".join(f"{n}:{t}" for n, t in df.dtypes)


def rows_folder(spark: SparkSession, path: str) -> str | None:
    """Where the rows of the cache lie, good or not."""
    found = _manifest(spark, path)
    return None if found is None else f"{path}/{found['folder']}"


def read_cache(spark: SparkSession, path: str, print_: str) -> DataFrame | None:
    """The cached rows, or None if there are none, of other sources, or not all of them."""
    found = _manifest(spark, path)
    if found is None or found["fingerprint"] != print_:
        return None
    try:
        rows = spark.read.parquet(rows_folder(spark, path))
        good = _columns(rows) == found["columns"] and rows.count() == found["n_rows"]
    except PySparkException:
        return None
    return rows if good else None


def validated_corpus(
    spark: SparkSession, path: str, sources: DataFrame, build: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, bool]:
    """``build(sources)`` from a good cache at ``path``, or built and cached; and whether it was built."""
    print_ = fingerprint(sources)
    cached = read_cache(spark, path, print_)
    if cached is not None:
        return cached, False
    folder = f"rows-{uuid.uuid4().hex}"
    build(sources).write.parquet(f"{path}/{folder}")
    rows = spark.read.parquet(f"{path}/{folder}")
    before = _manifest(spark, path)
    made = before["made"] + 1 if before is not None else 0
    entry = [(folder, _columns(rows), rows.count(), print_, made)]
    # an added file appears as a whole, and the last one counts
    spark.createDataFrame(entry, MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifest")
    return rows, True
