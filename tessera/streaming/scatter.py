"""Scatter-add over a stream: sums by destination, with a watermark on late contributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scatter_add_stream(contributions: DataFrame, keys: list[str], time: str = "ts", window: str = "10 minutes", late: str = "5 minutes", val: str = "val") -> DataFrame:
    """(window, keys, val): sums of each window of event time; rows later than `late` are dropped by the watermark.

    Works on a stream (append or update mode) and on a table alike. State is one
    running sum for each open window and key.
    """
    w = F.window(time, window).alias("window")
    return contributions.withWatermark(time, late).groupBy(w, *keys).agg(F.sum(val).alias(val))
