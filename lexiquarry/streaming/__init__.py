"""Structured Streaming over event tables. An extension: the surveyed system has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "events.parquet*").parquet(path)


def windowed_counts(events: DataFrame, *, time: str = "ts", by: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and means per tumbling window; a window closes when the watermark passes it. The same on a batch."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark(time, late)
    g = events.groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 4).alias("mean"))
    return g.select(F.col("w.start").alias("window_start"), by, "n", "mean")


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what is there now into a memory table of all results."""
    q = stream.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return stream.sparkSession.table(name)
