"""Streams: votes counted as they arrive, late ones dropped by watermark, repeated deliveries folded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vote_counts(stream: DataFrame, time: str = "submitted_at", late: str = "7 days", window: str = "1 day", id_col: str = "ann_id", label: str = "label", by: str = "task") -> DataFrame:
    """(window, by, label, n) of a stream of labels: each id once within the watermark, tumbling windows.

    Works on batch tables too, where nothing is late.
    """
    once = stream.withWatermark(time, late).dropDuplicatesWithinWatermark([id_col]) if stream.isStreaming else stream.dropDuplicates([id_col])
    return once.groupBy(F.window(time, window).alias("window"), by, label).agg(F.count(F.lit(1)).alias("n"))
