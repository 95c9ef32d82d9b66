"""Streaming: a monitor over run records, and windowed bars from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "step long, at timestamp, condition int, loss double, seconds double, valid boolean"


def watch(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a folder of JSON lines as they are added."""
    return spark.readStream.schema(RECORD).json(path)


def status(records: DataFrame, slow: float = 60.0) -> DataFrame:
    """The latest step of each condition, its loss, and alerts; on a stream or a table."""
    latest = records.groupBy("condition").agg(F.max_by(F.struct("step", "loss", "seconds"), "step").alias("r"), F.count(F.lit(1)).alias("n"), F.avg(F.col("valid").cast("double")).alias("valid_share"))
    alert = F.when(F.isnan("r.loss") | F.col("r.loss").isNull(), "loss").when(F.col("r.seconds") > slow, "slow").when(F.col("valid_share") < 0.5, "invalid")
    return latest.select("condition", "n", F.col("r.step").alias("step"), F.col("r.loss").alias("loss"), "valid_share", alert.alias("alert"))


def bars(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events (ts, user_id, value) as bars by window and user; rows later than the watermark are left out on a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    k = F.struct("ts", "event_id")
    out = rows.groupBy(F.window("ts", width).alias("w"), "user_id").agg(F.min_by("value", k).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", k).alias("close"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), "user_id", "open", "high", "low", "close", "n")
