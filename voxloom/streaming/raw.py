"""The raw build as a stream: files come in, outcomes and written rows go out, with a checkpoint to resume from."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxloom.operators.build import transcript_disposition


def transcripts(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream; a single local file is read as the one of its name in its folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if os.path.isfile(path):
        return reader.option("pathGlobFilter", os.path.basename(path)).parquet(os.path.dirname(path))
    return reader.parquet(path)


def with_outcomes(rows: DataFrame, text: str, seconds: str, key: str) -> DataFrame:
    """Each row with its outcome; stateless, so the same for a stream and a table."""
    return rows.withColumn("disposition", transcript_disposition(F.col(text), F.col(seconds), F.lit(True), F.col(key)))


def write_written(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The rows whose outcome is written, appended as they come; ends when all present files are read."""
    out = rows.filter(F.col("disposition") == "written")
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def count_outcomes(rows: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Running counts by outcome in a memory table: a handful of rows of state."""
    counts = rows.groupBy("disposition").agg(F.count("*").alias("rows"))
    return counts.writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
