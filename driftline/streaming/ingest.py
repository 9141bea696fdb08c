"""Documents as a stream: late copies within the watermark are dropped, batches go through the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftline.functions.text import content_hash


def deduplicated(stream: DataFrame, watermark: str = "30 days") -> DataFrame:
    """stream: source, text, event_at (timestamp)."""
    return stream.withColumn("content_hash", content_hash(F.col("text"))).withWatermark("event_at", watermark).dropDuplicatesWithinWatermark(["source", "content_hash"])


def bucket_counts(stream: DataFrame, bucket: str = "7 days", start: str = "0 days", watermark: str = "7 days") -> DataFrame:
    """Counts by tumbling bucket and source."""
    return stream.withWatermark("event_at", watermark).groupBy(F.window("event_at", bucket, bucket, start), "source").agg(F.count(F.lit(1)).alias("n"))


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return deduplicated(stream).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
