"""Structured Streaming: sliding request counts and incremental mention counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sliding_counts(events: DataFrame, length: str = "60 seconds", step: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n): events of each window; rows later than `late` are not waited for."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length, step), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str, transform) -> None:
    """Read all new files of a folder, transform each batch and append it to a table, exactly once by batch number."""
    def put(batch: DataFrame, n: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={n}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
