"""Axis reductions over event time, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str | None = None, ts: str = "ts", value: str = "value", *by: str) -> DataFrame:
    """Sum, mean, least and largest value per window and key; late rows are dropped beyond ``late``."""
    t = events.withColumn("_t", F.col(ts).cast("timestamp"))
    t = t.withWatermark("_t", late) if late and events.isStreaming else t
    w = F.window("_t", width, slide) if slide else F.window("_t", width)
    out = t.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total", "mean", "low", "high")


def to_memory(df: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    """Run over what is there and stop: for tests."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
