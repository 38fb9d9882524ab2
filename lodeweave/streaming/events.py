"""Structured Streaming forms of the batch rules (an extension: the source material has no streams)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Events as a stream of the parquet files of a folder, or of one file."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        reader, path = reader.option("pathGlobFilter", place.getName()), place.getParent().toString()
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def bursts(events: DataFrame, window: str = "3 days", late: str = "1 day") -> DataFrame:
    """ST1: events and their value per type and window; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """ST1: sessions of a user by a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def enriched(events: DataFrame, users: DataFrame) -> DataFrame:
    """ST4: a stream joined with a static table."""
    return events.join(users, "user_id", "left")


def append_new(stream: DataFrame, path: str, key: str, checkpoint: str) -> None:
    """ST2, ST3: every key once, whatever repeats and restarts: each batch adds the keys the output lacks."""
    from lodeweave.sources.records import append_missing

    def add(batch: DataFrame, _: int) -> None:
        append_missing(batch, path, key)

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """All results of a stream over what its source holds now."""
    name = f"drained_{uuid.uuid4().hex}"
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)
