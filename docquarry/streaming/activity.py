"""Live activity counts over event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def activity_windows(events: DataFrame, *, time: str = "ts", size: str = "1 hour", late: str = "1 day",
                     by: str = "event_type") -> DataFrame:
    """Counts per window and kind; works on batch tables and on streams alike."""
    marked = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        marked = marked.withWatermark(time, late)
    return marked.groupBy(F.window(time, size), by).agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"),
    ).select(F.col("window.start").alias("window_start"), by, "n", "value")


def start_activity(events: DataFrame, out: str, checkpoint: str, *, trigger: dict | None = None, **options) -> StreamingQuery:
    """Write updated windows of every micro-batch under its number; see :func:`latest_windows`."""

    def run(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return (
        activity_windows(events, **options).writeStream.outputMode("update").foreachBatch(run)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"})).start())


def latest_windows(updates: DataFrame, by: str = "event_type") -> DataFrame:
    """The newest state of each window from the written updates."""
    return updates.groupBy("window_start", by).agg(F.max_by(F.struct("n", "value"), "epoch").alias("s")).select(
        "window_start", by, "s.n", "s.value")
