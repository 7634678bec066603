"""Line crossings, with a guard against counting one person twice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.functions import geometry as G
from paceline.operators import stretches as S

TRACK_KEYS = ["stream_id", "track_id"]
WIRE_KEYS = ["stream_id", "tripwire_id", "track_id"]


def prev_centroid(points: DataFrame, frames_per_stretch: int = S.FRAMES_PER_STRETCH) -> DataFrame:
    """Add struct ``prev`` (cx, cy): where the track was last seen, however long ago."""
    return S.previous_row(
        points, TRACK_KEYS, ["frame_idx", "track_ord"], ["cx", "cy"],
        S.by_frames(F.col("frame_idx"), frames_per_stretch), "prev",
    )


def crossing_candidates(moves: DataFrame, tripwires: DataFrame, clip_to_segment: bool = False) -> DataFrame:
    """Moves (``prev`` to ``cx, cy``) that change sides of a tripwire of their camera.

    A tripwire is an endless line. With ``clip_to_segment`` a move must also
    pass between the end points.
    """
    known = moves.filter(F.col("prev").isNotNull())
    p1, p2 = F.col("p1"), F.col("p2")
    px, py, cx, cy = F.col("prev.cx"), F.col("prev.cy"), F.col("cx"), F.col("cy")
    side = [G.signed_area(p1["x"], p1["y"], p2["x"], p2["y"], x, y) for x, y in ((px, py), (cx, cy))]
    raw = G.classify_direction(*side)
    out = known.join(tripwires, "stream_id").withColumn("raw_direction", raw).filter("raw_direction is not null")
    if clip_to_segment:
        ends = [G.signed_area(px, py, cx, cy, p["x"], p["y"]) for p in (p1, p2)]
        out = out.filter(ends[0] * ends[1] <= 0)
    return out.withColumn("direction", G.map_in_out(F.col("raw_direction"), F.col("direction_in")))


def _may_count(last, row, m):
    moved = m.hypot(row["cx"] - last["cx"], row["cy"] - last["cy"])
    return (row["frame_idx"] - last["frame_idx"] >= row["recycle_after_frames"]) | (
        moved >= row["recycle_distance_px"]
    )


def tripwire_crossings(candidates: DataFrame, frames_per_stretch: int = S.FRAMES_PER_STRETCH) -> DataFrame:
    """Candidates that count.

    After a counted crossing the same id counts again on the same wire only
    ``recycle_after_frames`` later or ``recycle_distance_px`` away, whatever the
    direction. A stretch holds at most one candidate of a track per frame.
    """
    counted = S.accepted_rows(
        candidates, WIRE_KEYS, ["frame_idx", "track_ord"],
        ["ts", "direction", "cx", "cy", "recycle_after_frames", "recycle_distance_px"],
        S.by_frames(F.col("frame_idx"), frames_per_stretch), _may_count,
    )
    return counted.drop("recycle_after_frames", "recycle_distance_px")


def crossings_of(
    points: DataFrame, tripwires: DataFrame, clip_to_segment: bool = False,
    frames_per_stretch: int = S.FRAMES_PER_STRETCH,
) -> DataFrame:
    """All steps from track points to counted crossings."""
    moves = prev_centroid(
        points.select("stream_id", "track_id", "frame_idx", "track_ord", "ts", "cx", "cy"), frames_per_stretch
    )
    return tripwire_crossings(crossing_candidates(moves, tripwires, clip_to_segment), frames_per_stretch)


def all_crossings(*sources: DataFrame) -> DataFrame:
    """Crossings of separate sources as one table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def crossing_totals(crossings: DataFrame) -> DataFrame:
    """In and out per tripwire; a row with a null tripwire is the camera's total."""
    return (
        crossings.rollup("stream_id", "tripwire_id")
        .agg(
            F.count_if(F.col("direction") == "in").alias("n_in"),
            F.count_if(F.col("direction") == "out").alias("n_out"),
            F.count(F.lit(1)).alias("n_total"),
        )
        .filter("stream_id is not null")
    )
