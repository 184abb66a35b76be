"""Folds over a stream of events: tumbling windows with a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mortar.functions.lineage import shared_folder


def fold_events(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count, sum and extremes by window and type; a streaming or a static frame."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    grouped = rows.groupBy(F.window("ts", window), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.max("value").alias("high"), F.min("value").alias("low")).select(F.col("window.start").alias("start"), "event_type", "n", "high", "low")


def run_to_end(spark: SparkSession, path: str) -> DataFrame:
    """Streams the Parquet files of ``path`` through the fold until all are read; the complete table.

    Every batch appends the windows that it changed to a table in the shared folder, and a window's last row counts; the
    watermark frees the state of windows that are over."""
    schema = spark.read.parquet(path).schema
    place = f"{shared_folder(spark)}/folds-{uuid.uuid4().hex}"
    pattern = f"{path[:-1]}[{path[-1]}]"  # a pattern may name a single file; a plain path must be a folder
    stream = fold_events(spark.readStream.schema(schema).parquet(pattern))

    def put(batch: DataFrame, number: int) -> None:
        # a batch that is run again writes its own folder again
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{place}/rows/b={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{place}/rows")
    last = F.max_by(F.struct("n", "high", "low"), "batch").alias("x")
    return rows.groupBy("start", "event_type").agg(last).select("start", "event_type", "x.*")
