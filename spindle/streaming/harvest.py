"""Incremental harvest of record files as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def records(spark: SparkSession, path: str) -> DataFrame:
    """A stream of ``id, at, body`` from JSON-lines files; lines that are no JSON objects or have no id go."""
    lines = spark.readStream.format("text").load(path)
    body = F.try_parse_json("value")
    key = F.coalesce(F.nullif(F.try_variant_get(body, "$.identifier", "string"), F.lit("")), F.try_variant_get(body, "$._id", "string"))
    at = F.try_to_timestamp(F.try_variant_get(body, "$.date", "string"))
    return lines.select(key.alias("id"), at.alias("at"), F.col("value").alias("body")).where("id is not null")


def first_seen(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each id once; state is kept for ``delay`` of event time, so that it stays bounded. Records without a time go."""
    return stream.where("at is not null").withWatermark("at", delay).dropDuplicatesWithinWatermark(["id"])


def harvest(stream: DataFrame, target: str, checkpoint: str, once: bool = True):
    """Append the stream to a Parquet table; a restart goes on where the checkpoint ends."""
    writer = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Records by tumbling window of event time, with late ones up to ``delay``."""
    return stream.withWatermark("at", delay).groupBy(F.window("at", width)).agg(F.count("*").alias("n"))
