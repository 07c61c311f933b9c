"""Incremental ingest and live session activity."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomtrace.schema import EVENTS


def event_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """New files of the canonical event table as they land, at most `files_per_trigger` at once."""
    new = spark.readStream if files_per_trigger is None else spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    return new.schema(", ".join(f"{k} {v}" for k, v in EVENTS.items())).parquet(path)


def append_available(events: DataFrame, target: str, checkpoint: str) -> None:
    """Append everything that is available now, exactly once, then stop."""
    q = (events.withColumn("month", F.date_format("ts", "yyyy-MM")).writeStream.format("parquet").option("path", target)
         .option("checkpointLocation", checkpoint).partitionBy("source", "month").trigger(availableNow=True).start())
    q.awaitTermination()


def session_bursts(events: DataFrame, gap: str = "1800 seconds", late: str = "1 hour") -> DataFrame:
    """Runs of activity per session: a run ends after a silent gap; late events within the
    watermark still join their run."""
    return (events.filter("session_id is not null and not synth_ts").withWatermark("ts", late)
            .groupBy("tenant_id", "source", "session_id", F.session_window("ts", gap).alias("w"))
            .agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
            .select("tenant_id", "source", "session_id", "events", "first_ts", "last_ts",
                    (F.unix_micros("last_ts") / 1e6 - F.unix_micros("first_ts") / 1e6).alias("active_s")))
