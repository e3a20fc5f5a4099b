"""Extensions, not part of the photo tool: a folder of photos as a stream, and outcomes per window of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.sources.photos import PATTERN

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def photo_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New photos of a folder; run with ``trigger(availableNow=True)`` or a processing time."""
    return spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", PATTERN).option("maxFilesPerTrigger", files_per_trigger).load(folder)


def rates(events: DataFrame, late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Events of each type per window; rows later than ``late`` are dropped. Works on a stream and on a table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
