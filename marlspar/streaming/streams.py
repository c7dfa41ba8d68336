"""Incremental forms of the batch operators, on file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspar.sources import tables


def postings(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """New JSON files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("multiLine", True).json(folder)


def events(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def without_repeats(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark; state of older keys is dropped."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def accumulate(stream: DataFrame, path: str, checkpoint: str):
    """Append every batch to a table; exactly once by the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert(stream: DataFrame, path: str, checkpoint: str, key: str = "chat_id"):
    """Replace the rows of each batch's keys in a table of ``sources.tables``; a batch that is run again changes nothing."""
    return (
        stream.writeStream.foreachBatch(lambda df, batch: tables.upsert(df, path, key, writer=checkpoint, batch=batch))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run to the end of what is there, into a table of files, and read that back."""
    accumulate(stream, path, checkpoint).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
