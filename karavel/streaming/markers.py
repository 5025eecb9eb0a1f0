"""Marker rows of a source waited for in the target, as two joined streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def _clock(seconds: str) -> Column:
    """One second on, since a stream begins with second 0 as its watermark and takes what is not after it for late."""
    return F.timestamp_seconds(F.col(seconds) + 1)


def marker_stream(source: DataFrame, target: DataFrame, timeout: int = 60, lateness: str = "0 seconds") -> DataFrame:
    """Per marker row ``(ts, status)`` one row as soon as it is known: arrived after how many seconds, or timed out.

    ``source`` has ``ts, status`` and ``target`` ``ts, status, arrived_at`` (seconds). The clock is the watermark, that is the latest time seen on
    both sides less ``lateness``; heartbeat rows move it on if nothing else does, so nobody has to poll. A marker whose
    time is over without an arrival comes out as timed out, once; what comes for it later is passed over. A marker
    that still may come is kept as state and is in no row yet.
    """
    sent = source.select("ts", "status", _clock("ts").alias("sent_at")).withWatermark("sent_at", lateness)
    came = target.select(F.col("ts").alias("__ts"), F.col("status").alias("__status"), "arrived_at", _clock("arrived_at").alias("came_at"))
    came = came.withWatermark("came_at", lateness)
    in_time = F.expr(f"came_at >= sent_at and came_at <= sent_at + interval {int(timeout)} seconds")
    both = sent.join(came, (F.col("ts") == F.col("__ts")) & (F.col("status") == F.col("__status")) & in_time, "leftOuter")
    arrived = F.col("arrived_at").isNotNull()
    return both.select("ts", "status", arrived.alias("arrived"), (F.col("arrived_at") - F.col("ts")).alias("delay"), (~arrived).alias("timed_out"))


def follow_markers(source: DataFrame, target: DataFrame, dest: str, checkpoint: str, timeout: int = 60, lateness: str = "0 seconds", interval: str | None = None) -> StreamingQuery:
    """Write ``marker_stream`` to a folder: all files that are there, or every ``interval`` for ever."""
    writer = marker_stream(source, target, timeout, lateness).writeStream.format("parquet").option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.outputMode("append").trigger(**trigger).start(dest)
