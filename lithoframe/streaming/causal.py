"""An extension: counts and means of a stream of rows in tumbling windows of time, late rows up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, value: str = "value", key: str = "event_type", time: str = "ts", width: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Per window and key: ``start, key, n, mean``. Runs on a stream or a table; only a stream has late rows to drop."""
    source = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if stream.isStreaming else stream
    grouped = source.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return grouped.select(F.col("w.start").alias("start"), key, "n", "mean")
