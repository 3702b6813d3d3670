"""Audit records as a stream: folders of JSON lines to running counts by route and source. An extension; batch covers all else."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def audit_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def counts(stream: DataFrame, by: list[str]) -> DataFrame:
    return stream.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("fallback_reason").isNotNull().cast("long")).alias("fallbacks"))


def windowed(stream: DataFrame, time: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts of a route in tumbling windows; records later than the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), "route").agg(F.count("*").alias("n"))


def ingest(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends the records to a Parquet folder once each, as far as there are any."""
    return stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
