"""Evidence around an alert: which frames belong to its clip, and where the clip is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.functions.text import clip_path, clip_url
from paceline.operators import stretches as S


def evidence_window(alerts: DataFrame, frames: DataFrame, pre_seconds: float, post_seconds: float) -> DataFrame:
    """Frames of the alert's camera in ``[timestamp - pre, timestamp + post]``, each with its alert ``id``.

    Joined on camera and time bucket: an alert is sent to the few buckets its
    window touches, a frame has one. An alert without any frame has no rows.
    """
    if pre_seconds < 0 or post_seconds < 0:
        raise ValueError("pre_seconds and post_seconds must be >= 0")
    width = F.lit(max(float(pre_seconds) + float(post_seconds), 1.0))
    lo, hi = F.col("timestamp") - F.lit(float(pre_seconds)), F.col("timestamp") + F.lit(float(post_seconds))
    windows = alerts.select(
        "id", "stream_id", F.col("timestamp").alias("alert_ts"), lo.alias("__lo"), hi.alias("__hi"),
        F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))).alias("__bucket"),
    )
    return (
        frames.withColumn("__bucket", F.floor(F.col("ts") / width))
        .join(windows, ["stream_id", "__bucket"])
        .filter((F.col("ts") >= F.col("__lo")) & (F.col("ts") <= F.col("__hi")))
        .select("id", "stream_id", "alert_ts", "frame_idx", "ts")
    )


def window_counts(
    alerts: DataFrame, frames: DataFrame, pre_seconds: float, post_seconds: float,
    seconds_per_stretch: float = S.SECONDS_PER_STRETCH,
) -> DataFrame:
    """Per alert with frames: ``n_frames, first_ts, last_ts`` of its window, and ``n_post`` after the alert itself.

    Three marks per alert and all frames lie on one time line, which carries the
    number of frames so far and the frame before; the first frame at or after the
    window's start is the frame before on the line walked backwards. No pair of
    alert and frame is formed.
    """
    if pre_seconds < 0 or post_seconds < 0:
        raise ValueError("pre_seconds and post_seconds must be >= 0")
    none = F.lit(None)
    # where times are equal: the window's start before frames, the alert and the window's end after them
    marks = alerts.select("id", "stream_id", F.col("timestamp").alias("alert_ts"), F.inline(F.array(
        F.struct((F.col("timestamp") - F.lit(float(pre_seconds))).alias("__at"), F.lit(0).alias("__kind")),
        F.struct(F.col("timestamp").alias("__at"), F.lit(2).alias("__kind")),
        F.struct((F.col("timestamp") + F.lit(float(post_seconds))).alias("__at"), F.lit(3).alias("__kind")))))
    seen = frames.select(
        none.cast(alerts.schema["id"].dataType).alias("id"), "stream_id", none.cast("double").alias("alert_ts"),
        F.col("ts").alias("__at"), F.lit(1).alias("__kind"))
    line = marks.unionByName(seen)
    frame = F.col("__kind") == 1
    stretch = S.by_seconds(F.col("__at"), seconds_per_stretch)
    counted = S.running_total(
        line, ["stream_id"], ["__at", "__kind"], F.when(frame, 1).otherwise(0), stretch, "__upto")
    before = S.last_known(
        counted, ["stream_id"], ["__at", "__kind"], F.when(frame, F.col("__at")), stretch, "__before")
    back = before.withColumn("__neg", -F.col("__at")).withColumn("__neg_kind", -F.col("__kind"))
    both = S.last_known(
        back, ["stream_id"], ["__neg", "__neg_kind"], F.when(frame, F.col("__at")), -stretch, "__after")
    at_mark = lambda kind, c: F.max(F.when(F.col("__kind") == kind, F.col(c)))
    return both.filter(~frame).groupBy("id", "stream_id", "alert_ts").agg(
        (at_mark(3, "__upto") - at_mark(0, "__upto")).alias("n_frames"), at_mark(0, "__after").alias("first_ts"),
        at_mark(3, "__before").alias("last_ts"), (at_mark(3, "__upto") - at_mark(2, "__upto")).alias("n_post"),
    ).filter("n_frames > 0")


def evidence_manifest(
    alerts: DataFrame, frames: DataFrame, base_dir: str, pre_seconds: float = 5.0, post_seconds: float = 5.0,
    fps: float = 30.0, backend: str = "local", seconds_per_stretch: float = S.SECONDS_PER_STRETCH,
) -> DataFrame:
    """One row per alert that has frames: how many, from when to when, whether all expected ones are there, and where the clip goes."""
    if backend not in ("local", "noop"):
        raise ValueError("backend must be 'local' or 'noop'")
    expected = int(fps * pre_seconds) + int(fps * post_seconds)
    stats = window_counts(alerts, frames, pre_seconds, post_seconds, seconds_per_stretch)
    path = clip_path(base_dir, F.col("stream_id"), F.col("alert_ts"), F.col("id"))
    return stats.select(
        F.col("id").alias("violation_id"), "stream_id", "n_frames", "first_ts", "last_ts",
        F.lit(expected).cast("long").alias("expected_frames"), (F.col("n_frames") >= expected).alias("complete"),
        (path if backend == "local" else F.lit("")).alias("clip_path"),
        clip_url(base_dir, F.col("stream_id"), F.col("alert_ts"), F.col("id"), backend).alias("clip_url"),
        F.lit(backend).alias("clip_backend"),
        F.when(F.col("n_post") == 0, F.lit(f"no post-event frames captured within {float(post_seconds)}s window"))
        .otherwise(F.lit("")).alias("notes"),
    )


def clip_join(alert_log: DataFrame, manifest: DataFrame) -> DataFrame:
    """The log with what is known of each clip; alerts without one keep nulls."""
    clips = manifest.select(
        F.col("violation_id").alias("id"), "n_frames", "complete",
        F.col("clip_path").alias("clip_path"), F.col("clip_url").alias("clip_url"), "clip_backend",
    )
    return alert_log.drop("clip_path", "clip_url").join(clips, "id", "left")


def expired_clips(index: DataFrame, now: float, days: float) -> DataFrame:
    """Clips last written strictly more than ``days`` before ``now``; ``index`` has path and modified_ts."""
    if days <= 0:
        raise ValueError("days must be > 0")
    return index.filter(F.col("modified_ts") < F.lit(float(now) - float(days) * 86400.0))
