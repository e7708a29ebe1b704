"""Logged queries as a stream: late and repeated rows are dealt with by a watermark, use is counted by window and object.

The scan itself stays batch: it reads the table that ``keep`` maintains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "query_id long, ts timestamp, user string, object_id string, report string"


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Uses of objects out of Parquet files that land in a folder."""
    return spark.readStream.schema(EVENT).parquet(folder)


def distinct_uses(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each use once: repeats within the time that rows may be late are dropped."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["query_id", "object_id"])


def use_by_window(stream: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """start, object_id, uses, last_seen by window, written when the window is over."""
    rows = distinct_uses(stream, late).groupBy(F.window("ts", size).alias("w"), "object_id").agg(F.count("*").alias("uses"), F.max("ts").alias("last_seen"))
    return rows.select(F.col("w.start").alias("start"), "object_id", "uses", "last_seen")


def keep(windows: DataFrame, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append finished windows to a Parquet folder; a restart goes on where the checkpoint stands."""
    out = windows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if available_now else out).start()


def queried(spark: SparkSession, table: str) -> DataFrame:
    """id, uses, last_seen over all finished windows: seeds of a scan."""
    return spark.read.schema("start timestamp, object_id string, uses long, last_seen timestamp").parquet(table).groupBy(F.col("object_id").alias("id")).agg(F.sum("uses").alias("uses"), F.max("last_seen").alias("last_seen"))
