"""Unbounded sources over folders, and a runner that drains what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def stream_parquet(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def stream_text(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Lines of files that match, as they arrive."""
    return spark.readStream.option("lineSep", "\n").option("pathGlobFilter", glob).text(folder)


def run_available(df: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a streaming query until it has read what is there; return what it wrote.

    The checkpoint folder must be shared by all executors; a second run goes on where
    the first ended.
    """
    query = (
        df.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start(folder)
    )
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(folder)
