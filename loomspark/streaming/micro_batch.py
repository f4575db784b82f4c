"""Structured Streaming: beyond batch, an ingest that applies the same contract to micro-batches, and windowed measures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from loomspark.operators.ingest import accepted, quarantined


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; a batch and a stream give the same."""
    stream = events.withWatermark("ts", late) if events.isStreaming else events
    return stream.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def first_seen(events: DataFrame, key: str, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def ingest(stream: DataFrame, check: Callable[[DataFrame], DataFrame], rows: str, errors: str, checkpoint: str, source_ref: str) -> DataStreamWriter:
    """Each micro-batch is checked; good rows and quarantined ones are written under the batch's number, so a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        checked = check(batch)
        for df, path in ((accepted(checked), rows), (quarantined(checked, F.col(source_ref).cast("string"), F.to_json(F.struct(*batch.columns))), errors)):
            df.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
