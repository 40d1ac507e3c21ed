"""Micro-batches of requests: what waits together is embedded together, a bounded number at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST = 32


def batches(requests: DataFrame, most: int = MOST, window: str = "1 second") -> DataFrame:
    """(window_start, batch, n) of requests(event_id, ts): arrivals of a window, cut into batches of `most` in order.

    Windows are independent, so each is numbered by itself.
    """
    start = F.window("ts", window).getField("start").alias("window_start")
    order = Window.partitionBy("window_start").orderBy("ts", "event_id")
    numbered = requests.select(start, "ts", "event_id").withColumn("batch", F.floor((F.row_number().over(order) - 1) / most).cast("long"))
    return numbered.groupBy("window_start", "batch").agg(F.count("*").alias("n"))


def mean_batch(batched: DataFrame) -> DataFrame:
    """Texts, batches and their mean; the mean is null while there is none."""
    return batched.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("texts"), F.count("*").alias("batches"), F.round(F.sum("n") / F.nullif(F.count("*"), F.lit(0)), 2).alias("mean_batch"))


def windowed_stream(stream: DataFrame, window: str = "1 second", delay: str = "10 seconds") -> DataFrame:
    """Arrivals a window of a stream, with a watermark that bounds the state: rows later than `delay` are dropped by Spark."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", window)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "n")
