"""Streams: a landing folder of release records into the warehouse, and rolling counts with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.labels import parse_releases
from ..sources.readers import Warehouse
from ..sources.sinks import insert_new

RAW = "title string, body string, date string, url string, topic array<struct<uuid:string>>"


def land_releases(spark: SparkSession, landing: str, wh: Warehouse, checkpoint: str) -> StreamingQuery:
    """Every file of JSON lines in the folder, parsed and inserted if new, once; stops when all is read.

    A batch that is repeated after a failure adds nothing, as rows are inserted by key.
    """

    def batch(df: DataFrame, _: int) -> None:
        insert_new(wh, "press_releases", parse_releases(df))

    raw = spark.readStream.schema(RAW).json(landing)
    return raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rolling_counts(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) by sliding event-time windows; works on a stream (with a watermark) and on a table."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", size, slide) if slide else F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
