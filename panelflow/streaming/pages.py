"""Pages as a stream: content seen before is dropped within the watermark, counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_content(stream: DataFrame, content: str, time: str, late: str = "1 hour") -> DataFrame:
    """Rows whose content was not seen within the watermark."""
    keyed = stream.withColumn(time, F.col(time).cast("timestamp")).withColumn("content_key", F.sha2(F.col(content).cast("binary"), 256))
    return keyed.withWatermark(time, late).dropDuplicatesWithinWatermark(["content_key"])


def counts(stream: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))
