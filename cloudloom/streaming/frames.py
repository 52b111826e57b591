"""Frames that arrive one after another: the batch operators on each micro-batch, and running sums with bounded state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def frame_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """New Parquet files of points as they come."""
    return spark.readStream.schema(schema).parquet(folder)


def running_planes(points: DataFrame) -> DataFrame:
    """Count, means and scatter sums of each frame: all that an incremental plane needs, in constant state."""
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias("s" + c) for c in "xyz"]]
    sums += [F.sum(F.col(a) * F.col(b)).alias("s" + a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    return points.groupBy("frame_id").agg(*sums)


def each_batch(stream: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs a batch plan on each micro-batch; a batch that is repeated has the same number."""
    return stream.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per window and type with a watermark: state of windows that are over is dropped."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
