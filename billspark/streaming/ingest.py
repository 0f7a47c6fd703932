"""Ingest of arriving records as a stream: each key once, and counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_arrivals(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once_per_key(stream: DataFrame, key: str, time: str, late: str = "7 days") -> DataFrame:
    """The first delivery of each key; deliveries later than the watermark are dropped by its state, not by key."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def append_batches(stream: DataFrame, target: str, checkpoint: str, key: str) -> StreamingQuery:
    """Writes every key once over all batches, also after a restart, whatever the watermark dropped or not."""
    from billspark.sources.files import append_new

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: append_new(df, target, key)).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, by: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count("*").alias("n"))
