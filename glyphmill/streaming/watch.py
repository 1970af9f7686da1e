"""Watch mode as Structured Streaming (ST1-ST6): bursts of changes per project become one scan each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def bursts(events: DataFrame, time: str = "ts", project: str = "project", gap: str = "500 milliseconds", late: str = "10 minutes", ignored: Column | None = None) -> DataFrame:
    """One row per burst: project, start, end, changes (ST2).

    Events closer than ``gap`` belong together; ignored paths do not count (ST4; a null
    condition passes). On a stream, a burst is emitted once the watermark passes it and
    events later than ``late`` are dropped.
    """
    if ignored is not None:
        events = events.where(~F.coalesce(ignored, F.lit(False)))
    if events.isStreaming:
        events = events.withWatermark(time, late)
    grouped = events.groupBy(F.session_window(time, gap).alias("w"), F.col(project).alias("project")).agg(F.count(F.lit(1)).alias("changes"))
    return grouped.select("project", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "changes")


def watch(events: DataFrame, scan: Callable[[DataFrame], None], checkpoint: str, interval: str = "500 milliseconds", once: bool = False) -> StreamingQuery:
    """Runs ``scan`` for each micro-batch of changes: batches never overlap and waiting changes coalesce (ST1, ST3, ST6).

    ``scan`` must be idempotent for its projects, because a failed batch runs again.
    """
    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: scan(batch))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
