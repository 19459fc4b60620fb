"""The activity log as a stream: windows, sessions and repeated views, each bounded by a watermark.

State is kept per window, session or (user, bucket) only until the watermark passes it, so it does not grow with the log.
Rows that come later than `delay` behind the newest one are left out. All functions but first_views also take a batch
frame, where the watermark does nothing. Columns: event_id, user_id, event_type, ts.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, delay: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def windowed_counts(events: DataFrame, length: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """start, event_type, n: events per tumbling window, or sliding one if slide is given."""
    found = timed(events, delay).groupBy(F.window("ts", length, slide), "event_type").agg(F.count("*").alias("n"))
    return found.select(F.col("window.start").alias("start"), "event_type", "n")


def session_counts(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """user_id, start, end, n: runs of a user's events with pauses below gap. Append or complete mode."""
    found = timed(events, delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_views(events: DataFrame, seconds: int = 5, delay: str = "10 minutes") -> DataFrame:
    """event_id, user_id, bucket: of each user's views in one bucket of time, the first to come."""
    views = timed(events.where("event_type = 'view'"), delay).withColumn("bucket", F.floor(F.unix_timestamp("ts") / seconds))
    return views.dropDuplicatesWithinWatermark(["user_id", "bucket"]).select("event_id", "user_id", "bucket")
