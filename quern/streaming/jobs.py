"""Structured Streaming forms: event counts in windows, feedback without repeats, index segments by micro-batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.runtime import ensure_checkpoint_dir


def read_stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    path = f"{d}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path + "*")


def run_available(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there, in the shared folder, and read the result. In complete mode each micro-batch replaces the result; in
    append mode a batch writes under its number, so that a repeated batch overwrites itself."""
    spark = stream.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out") if mode == "complete" else spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")


def event_counts(events: DataFrame, minutes: int = 60) -> DataFrame:
    """(window_start, event_type, n, total): tumbling windows."""
    e = events.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", "10 minutes")
    return e.groupBy(F.window("t", f"{minutes} minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def first_feedback(feedback: DataFrame) -> DataFrame:
    """feedback_ids once each: state is kept by id; arrivals later than the watermark of 30 days on received_at are dropped by the engine."""
    return feedback.withWatermark("received_at", "30 days").dropDuplicatesWithinWatermark(["feedback_id"]).select("feedback_id")
