"""Session set-up and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def get_session(app: str = "stratalens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; cluster settings win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it; without one only a local master gets a
    temporary folder, as elsewhere other machines would not see it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="stratalens-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from there.

    Used where a result is read more than once and recomputing it would mean another pass over
    the embeddings, or where row ids must not change between two reads.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder. It is computed once, where a checkpoint computes
    it twice; but the rows' partitions are those of the files, and the table stays until the folder is
    cleared."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_BYTES = 64 << 20


def _bytes(name: str, kind: T.DataType):
    """The bytes a value takes, of strings and arrays by their contents."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType) and not isinstance(
        kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)
    ):
        return F.greatest(F.size(name), F.lit(0)) * 8 + 24
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.coalesce(F.octet_length(F.to_json(name)), F.lit(0)) + 24
    return F.lit(8)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, written once, marked for broadcast if its rows' measured bytes fit the limit.

    Otherwise the written frame as it is, to be joined by shuffle. The join is the same either way.
    """
    kept = durable(df)
    size = sum((_bytes(f.name, f.dataType) for f in df.schema.fields), F.lit(16))
    return F.broadcast(kept) if (kept.agg(F.sum(size)).first()[0] or 0) <= limit else kept
