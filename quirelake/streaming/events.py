"""Event time on streams: sliding windows and sessions under a watermark, kept in the state store and appended once they are over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sliding(events: DataFrame, size: str, slide: str, late: str, keys: list[str], value: str, ts: str = "ts") -> DataFrame:
    """window_start, keys, n and total of each window of ``size`` every ``slide``.

    A row that comes when the watermark (the greatest time of earlier batches, less ``late``) has reached the end of a window isn't counted
    there any more. Rows without a time are in no window.
    """
    found = events.where(F.col(ts).isNotNull()).withWatermark(ts, late).groupBy(F.window(ts, size, slide).alias("w"), *keys).agg(
        F.count("*").alias("n"), F.sum(value).alias("total")
    )
    return found.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, late: str, keys: list[str], ts: str = "ts") -> DataFrame:
    """keys, session_start, session_end (the last row's time and ``gap``) and n. A row that comes after its own session would be over isn't counted."""
    found = events.where(F.col(ts).isNotNull()).withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return found.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def fold(spark: SparkSession, source: str, schema, through, out: str, checkpoint: str, files_per_batch: int | None = None) -> None:
    """Run ``through`` over the files of ``source`` that are new since the last call, and append what is over to ``out``.

    All of them are one batch, or as many as ``files_per_batch`` makes. The checkpoint carries the watermark and what isn't over yet.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    through(reader.parquet(source)).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", out).trigger(
        availableNow=True
    ).start().awaitTermination()
