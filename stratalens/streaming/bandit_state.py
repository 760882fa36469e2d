"""The bandit's state over batches of a log stream: each pull counts once, also after a restart.

A folder holds versions of the state, the pulls that each version took up, and the versions that are
complete. A batch is merged in three writes: its new pulls, the next version of the state, and last the
version's number. What is not numbered was not written to the end; it is never read and written over by
the next merge. A pull is told by its arm and ``seq``, so batches that come again, by a restart
or as copies of files, add nothing, even if the stream's own checkpoint is lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import bandit as B
from ..operators import rewards as RW


def _numbered(spark: SparkSession, root: str) -> list[int]:
    return sorted(r["version"] for r in spark.read.schema("version long").parquet(f"{root}/versions").collect())


def start_state(spark: SparkSession, root: str) -> None:
    """Make the folder of a state, or leave the one there is."""
    spark.createDataFrame([], "version long").write.mode("append").parquet(f"{root}/versions")


def read_state(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """The state ``(arm…, a, b, n)`` of a version, the last one if none is given; None before the first."""
    found = _numbered(spark, root)
    if version is not None and version not in found:
        raise ValueError(f"no version {version} of the state in {root}")
    return spark.read.parquet(f"{root}/state/{version or found[-1]}") if found else None


def merge_pulls(pulls: DataFrame, root: str, dim: int, keys: Sequence[str] | None = None) -> None:
    """Add the pulls ``(arm…, seq, reward, context)`` that no earlier version has, as the next version.

    Of several pulls with one arm and ``seq`` any one counts. Of earlier pulls only arm and ``seq`` are
    read; without new pulls there is no new version.
    """
    spark = pulls.sparkSession
    keys = list(keys or RW.arm_keys(pulls))
    one = [*keys, "seq"]
    found = _numbered(spark, root)
    version = found[-1] + 1 if found else 1
    new = pulls.select(*one, "reward", "context").dropDuplicates(one)
    if found:
        seen = spark.read.schema(new.schema).parquet(*[f"{root}/pulls/{v}" for v in found])
        new = new.join(seen.select(*one), one, "left_anti")
    new.write.mode("overwrite").parquet(f"{root}/pulls/{version}")
    new = spark.read.schema(new.schema).parquet(f"{root}/pulls/{version}")
    if new.isEmpty():
        return
    prior = read_state(spark, root)
    B.linucb_state(new, dim, keys, prior).write.mode("overwrite").parquet(f"{root}/state/{version}")
    spark.createDataFrame([(version,)], "version long").write.mode("append").parquet(f"{root}/versions")


def follow_pulls(
    spark: SparkSession, log_dir: str, schema: T.StructType, root: str, checkpoint: str, dim: int
) -> StreamingQuery:
    """Merge what is new in a folder of Parquet pulls into the state and stop. Run again to go on."""
    start_state(spark, root)

    def merge(batch: DataFrame, number: int) -> None:
        merge_pulls(batch, root, dim)

    return (
        spark.readStream.schema(schema)
        .parquet(log_dir)
        .writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
