"""The append-only progress log as a stream: new rows are taken up as files appear."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import SWEEP_PROGRESS
from ..sources.tables import CSV_OPTIONS


def progress_stream(spark: SparkSession, log_dir: str) -> DataFrame:
    """Rows of every progress file in the log folder, each file read once."""
    reader = spark.readStream.schema(SWEEP_PROGRESS).options(**CSV_OPTIONS)
    return reader.option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(log_dir)


def follow(spark: SparkSession, log_dir: str, out: str, checkpoint: str) -> StreamingQuery:
    """Copy what is new in the log to a Parquet table and stop. Run again to go on from there."""
    rows = progress_stream(spark, log_dir).withColumn(
        "elapsed_sec", F.bround("elapsed_sec", 3)
    )
    return (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
