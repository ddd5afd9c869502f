"""Coordinates as a stream: the batch measures of a frame over frames that arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def centers_of_arriving_frames(coords: DataFrame, time: str = "time", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Centre of geometry of each frame in event-time windows; rows later than ``late`` are dropped by the watermark.

    State holds one row an open (window, frame), whatever the number of atoms.
    """
    held = coords.withWatermark(time, late)
    return held.groupBy(F.window(time, window), "frame_index").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in "xyz"))
