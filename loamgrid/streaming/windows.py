"""Structured Streaming over events: windows, sessions and tiles, with watermarks.

Each function takes a frame, streaming or not, and returns one; late rows beyond the watermark are dropped by
a streaming query and counted by a batch one.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.functions import tiles
from loamgrid.functions.index import tile_id


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", time: str = "ts", value: str = "value") -> DataFrame:
    """(window_start, event_type, n, total): counts and sums by window and type."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    grouped = timed.groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    timed = events.withWatermark(time, late) if events.isStreaming else events
    return timed.groupBy(F.window(time, width, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", time: str = "ts", user: str = "user_id") -> DataFrame:
    """(user_id, session_start, session_end, n): runs of events without a gap."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    grouped = timed.groupBy(user, F.session_window(time, gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(user, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def tile_counts(points: DataFrame, z: int = 6, width: str = "1 hour", late: str = "10 minutes", time: str = "ts", lng: str = "lng", lat: str = "lat") -> DataFrame:
    """(window_start, tile_id, n): points by window and tile."""
    timed = points.withWatermark(time, late) if points.isStreaming else points
    x, y = tiles.tile_of(F.col(lng), F.col(lat), F.lit(z))
    keyed = timed.withColumn("tile_id", tile_id(z, x, y))
    return keyed.groupBy(F.window(time, width).alias("w"), "tile_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "tile_id", "n")


def distinct_events(events: DataFrame, late: str = "1 hour", time: str = "ts", key: str = "event_id") -> DataFrame:
    """Each event once; state is dropped behind the watermark."""
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])
