"""Joins of two streams within a span of event time.

Both sides have a watermark and the join is bounded in time, so Spark keeps a
row only until nothing can meet it any more. Keys are cut by time as well: the
side that is kept whole lies in one piece of time, the other is sent to each piece
its span touches, so one zone or camera spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.streaming.processors import _timed

#: Event times are whole microseconds, ``ts`` is exact: rows meet by ``ts``, state goes a little later.
SLACK_SECONDS = 0.001


def _seconds(n: float) -> Column:
    return F.expr(f"interval '{n:.6f}' second")


def _spread(ts: Column, back: float, ahead: float, piece: float) -> Column:
    """The pieces of time between ``ts - back`` and ``ts + ahead``."""
    return F.explode(F.sequence(
        F.floor((ts - F.lit(back + SLACK_SECONDS)) / F.lit(piece)), F.floor((ts + F.lit(ahead + SLACK_SECONDS)) / F.lit(piece))))


def stream_unmatched_crossings(
    crossings: DataFrame, scans: DataFrame, window: float, delay: str = "10 seconds", piece_seconds: float = 60.0
) -> DataFrame:
    """``unmatched_crossings`` on streams of crossing records and scans.

    A crossing comes out when the watermark has passed the last scan that could
    have met it. A crossing with a null zone or time meets nothing and comes out as well.
    """
    if window <= 0:
        raise ValueError("window must be > 0")
    w = float(window)
    piece = max(float(piece_seconds), 4.0 * w)
    left = _timed(crossings, delay).withColumn("__piece", F.floor(F.col("ts") / F.lit(piece)))
    right = _timed(scans, delay).select(
        F.col("event_time").alias("__at"), F.col("zone_id").alias("__zone"), F.col("ts").alias("__scan"),
        _spread(F.col("ts"), w, w, piece).alias("__in"))
    near = (
        (F.col("zone_id") == F.col("__zone")) & (F.col("__piece") == F.col("__in"))
        & (F.col("__scan") >= F.col("ts") - F.lit(w)) & (F.col("__scan") <= F.col("ts") + F.lit(w))
        & (F.col("__at") >= F.col("event_time") - _seconds(w + SLACK_SECONDS))
        & (F.col("__at") <= F.col("event_time") + _seconds(w + SLACK_SECONDS))
    )
    return left.join(right, near, "left_outer").filter("__scan is null").drop("__piece", "__at", "__zone", "__scan", "__in")


def stream_evidence_window(
    alerts: DataFrame, frames: DataFrame, pre_seconds: float, post_seconds: float, delay: str = "10 seconds",
    piece_seconds: float = 60.0, keep_empty: bool = False,
) -> DataFrame:
    """``evidence_window`` on streams of alerts (id, stream_id, timestamp) and frames.

    A frame that belongs to an alert comes out as soon as both are there. With
    ``keep_empty`` an alert comes out with null ``frame_idx`` and ``ts`` once the
    watermark has passed its window and no frame was in it.
    """
    if pre_seconds < 0 or post_seconds < 0:
        raise ValueError("pre_seconds and post_seconds must be >= 0")
    pre, post = float(pre_seconds), float(post_seconds)
    piece = max(float(piece_seconds), 2.0 * (pre + post))
    timed = alerts if "event_time" in alerts.columns else _timed(alerts.withColumn("ts", F.col("timestamp")), delay)
    left = timed.select(
        "event_time", "id", "stream_id", F.col("timestamp").alias("alert_ts"),
        F.floor(F.col("timestamp") / F.lit(piece)).alias("__piece"))
    # a frame is within reach of alerts from ``post`` before it to ``pre`` after it
    right = _timed(frames, delay).select(
        F.col("event_time").alias("__at"), F.col("stream_id").alias("__stream"), "frame_idx", "ts",
        _spread(F.col("ts"), post, pre, piece).alias("__in"))
    near = (
        (F.col("stream_id") == F.col("__stream")) & (F.col("__piece") == F.col("__in"))
        & (F.col("ts") >= F.col("alert_ts") - F.lit(pre)) & (F.col("ts") <= F.col("alert_ts") + F.lit(post))
        & (F.col("__at") >= F.col("event_time") - _seconds(pre + SLACK_SECONDS))
        & (F.col("__at") <= F.col("event_time") + _seconds(post + SLACK_SECONDS))
    )
    return left.join(right, near, "left_outer" if keep_empty else "inner").select(
        "event_time", "id", "stream_id", "alert_ts", "frame_idx", "ts")
