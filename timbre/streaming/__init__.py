"""First-seen duplicate detection over an unbounded stream of manifest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame


def first_seen(stream: DataFrame, key: str, event_time: str, horizon: str = "7 days") -> DataFrame:
    """Rows whose ``key`` was not seen within ``horizon``; state older than the watermark is dropped."""
    return stream.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark([key])
