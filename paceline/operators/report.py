"""Per-camera reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_report(
    cameras: DataFrame, frames: DataFrame, displayed: DataFrame, crossings: DataFrame, alerts: DataFrame
) -> DataFrame:
    """One row of figures per camera. ``displayed`` are the tracks shown; crossings and alerts are of all tracks.

    The lists of a report can be as long as the recording, so they are tables
    of their own: ``report_items``.
    """
    n = lambda df, name: df.groupBy("stream_id").agg(F.count(F.lit(1)).alias(name))
    elapsed = F.max("ts") - F.min("ts")
    base = frames.groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("total_frames_processed"),
        F.round(elapsed, 2).alias("processing_duration_seconds"),
        F.round(F.count(F.lit(1)) / (elapsed + F.lit(1e-6)), 2).alias("pipeline_fps"),
    )
    people = displayed.groupBy("stream_id").agg(F.count_distinct("track_id").alias("unique_persons_tracked"))
    parts = [base, people, n(crossings, "total_tripwire_crossings"), n(alerts, "total_high_density_alerts")]
    joined = reduce(lambda a, b: a.join(b, "stream_id", "left"), parts, cameras.select("stream_id", "source"))
    return joined.withColumn("report_id", F.concat(F.lit("rep_"), F.col("stream_id"))).na.fill(0)


def report_items(displayed: DataFrame, crossings: DataFrame, alerts: DataFrame, latencies: DataFrame) -> DataFrame:
    """The lists of all reports as rows (stream_id, section, sort_ts, sort_id, body), ``body`` being JSON.

    Written partitioned by camera and sorted by section, time and id, these are
    the reports' lists line by line.
    """
    at = F.lit(None).cast("double")
    ids = displayed.select("stream_id", "track_id").distinct().select(
        "stream_id", F.lit("person_track_ids").alias("section"), at.alias("sort_ts"), F.col("track_id").alias("sort_id"),
        F.col("track_id").cast("string").alias("body"),
    )
    lines = crossings.select(
        "stream_id", F.lit("tripwire_crossings").alias("section"), F.col("ts").alias("sort_ts"),
        F.col("track_id").alias("sort_id"),
        F.to_json(F.struct(
            F.round("ts", 2).alias("timestamp"), "track_id", "tripwire_id", "direction",
            F.array(F.round("cx", 1), F.round("cy", 1)).alias("centroid"),
        )).alias("body"),
    )
    crowd = alerts.select(
        "stream_id", F.lit("high_density_alerts").alias("section"), F.col("timestamp").alias("sort_ts"),
        F.lit(None).cast("long").alias("sort_id"),
        F.to_json(F.struct(F.round("timestamp", 2).alias("timestamp"), "zone_id", "density_count", "threshold")).alias("body"),
    )
    stages = latencies.select(
        "stream_id", F.lit("stage_latencies").alias("section"), at.alias("sort_ts"), F.lit(None).cast("long").alias("sort_id"),
        F.to_json(F.struct("stage", F.col("n").alias("count"), "avg_ms")).alias("body"),
    )
    return ids.unionByName(lines).unionByName(crowd).unionByName(stages)


def list_streams(cameras: DataFrame, frames: DataFrame, displayed: DataFrame, crossings: DataFrame) -> DataFrame:
    """One row per camera; ``status`` is ``active`` if it has frames, else ``idle``."""
    parts = [
        frames.groupBy("stream_id").agg(F.count(F.lit(1)).alias("processed_frames")),
        displayed.groupBy("stream_id").agg(F.count_distinct("track_id").alias("unique_persons_tracked")),
        crossings.groupBy("stream_id").agg(F.count(F.lit(1)).alias("crossings_count")),
    ]
    joined = reduce(lambda a, b: a.join(b, "stream_id", "left"), parts, cameras.select("stream_id", "source"))
    return joined.na.fill(0).withColumn(
        "status", F.when(F.col("processed_frames") > 0, F.lit("active")).otherwise(F.lit("idle")))
