"""Extension: tumbling windows over a stream of events, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, ts: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, key, n, total) by window and key; works on a stream (append mode) and on a table."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(F.window(ts, width).alias("w"), F.col(key)).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), key, "n", "total")
