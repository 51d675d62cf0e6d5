"""Edges that arrive as a stream. An extension: batch operators take what it writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_edges(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """A Parquet folder as a stream of rows."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def windowed_pairs(stream: DataFrame, *, time_col: str = "ts", window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """``(start, src, dst, weight, n)``: undirected pairs summed by time window; rows later than the watermark are dropped by Spark."""
    return (
        stream.withWatermark(time_col, watermark)
        .where("src != dst")
        .groupBy(F.window(time_col, window).alias("w"), F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), "src", "dst", "weight", "n")
    )


def write_pairs(pairs: DataFrame, path: str, checkpoint: str, *, available_now: bool = True):
    """Append finished windows to a Parquet table, exactly once."""
    w = pairs.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return w.trigger(availableNow=True).start() if available_now else w.start()
