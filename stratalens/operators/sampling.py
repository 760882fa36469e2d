"""Bounded samples of arms, the same on every run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .ranking import top_rows

_HASH_LEVELS = 48


def sample_rows(
    df: DataFrame, keys: Sequence[str], n: int, seed: int = 0, row: str = "row_id"
) -> DataFrame:
    """Up to ``n`` rows per arm, the same ones on every run: the first by a seeded hash of the row
    id.

    Counts by the hash's magnitude, from the key columns alone, tell how small a hash has to be;
    the vectors are then read only up to there.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row).cast("string")))
    share = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)
    level = F.least(F.floor(-F.log2(F.greatest(share, F.lit(2.0**-52)))), F.lit(_HASH_LEVELS))
    counts = df.select(*keys, level.alias("_level")).groupBy(*keys, "_level").agg(
        F.count(F.lit(1)).alias("_c")
    )
    # a few dozen levels per arm
    arm = Window.partitionBy(*keys)
    so_far = F.sum("_c").over(arm.orderBy(F.desc("_level")))
    enough = so_far >= F.least(F.sum("_c").over(arm), F.lit(n))
    bounds = counts.withColumn("_enough", enough).where("_enough").groupBy(*keys).agg(
        F.max("_level").alias("_bound")
    )
    near = df.join(broadcast_if_small(bounds), list(keys)).where(level >= F.col("_bound"))
    hashed = near.withColumn("_d", digest).drop("_bound")
    return top_rows(hashed, keys, [F.col("_d"), F.col(row)], n, "_n").drop("_d", "_n")
