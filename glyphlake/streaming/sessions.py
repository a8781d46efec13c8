"""Islands on a stream: session windows under a watermark (an extra beside the batch operator)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """key, start, end, n of each session; events later than `late` are dropped by the watermark."""
    rows = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return rows.groupBy(F.session_window("__ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
