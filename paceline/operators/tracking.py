"""Track tables: what is shown, histories, lifetimes, and the arrays trackers exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.functions import geometry as G
from paceline.operators import stretches as S

TRACK = ["stream_id", "track_id"]
TRACK_ORDER = ["frame_idx", "track_ord"]
HISTORY = 30


def display_tracks(tracks: DataFrame, cameras: DataFrame) -> DataFrame:
    """Tracks a camera shows: confidence at or above its limit. For output only, all other work uses every track."""
    limits = cameras.select("stream_id", F.col("display_conf").alias("__limit"))
    return tracks.join(limits, "stream_id").filter(F.col("conf") >= F.col("__limit")).drop("__limit")


def sanitized(tracks: DataFrame) -> DataFrame:
    """Boxes with a coordinate that is not finite become zero boxes."""
    box = G.sanitize_bbox(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    out = tracks.withColumn("__box", box)
    for c in ("x1", "y1", "x2", "y2"):
        out = out.withColumn(c, F.col(f"__box.{c}"))
    return out.drop("__box")


def detections_matrix(detections: DataFrame) -> DataFrame:
    """Per frame: rows ``[x1, y1, x2, y2, conf, cls]`` in detection order."""
    row = F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2", "conf", "cls")])
    return detections.groupBy("stream_id", "frame_idx").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("det_ord", row.alias("row")))), lambda r: r["row"]
        ).alias("matrix")
    )


def tracks_from_matrix(matrices: DataFrame) -> DataFrame:
    """Tracker output rows ``[x1, y1, x2, y2, id, conf, cls, det_ind]`` back to track rows.

    ``embeddable`` tells whether the box has an area, without which no
    appearance vector is computed.
    """
    flat = matrices.select("*", F.posexplode("matrix").alias("track_ord", "__row")).drop("matrix")
    at = lambda i: F.col("__row").getItem(i)
    rows = flat.select(
        *[c for c in flat.columns if c != "__row"],
        at(4).cast("long").alias("track_id"), at(0).alias("x1"), at(1).alias("y1"), at(2).alias("x2"),
        at(3).alias("y2"), at(5).alias("conf"), at(6).cast("int").alias("cls"), at(7).cast("long").alias("det_ind"),
        ((at(2) > at(0)) & (at(3) > at(1))).alias("embeddable"),
    )
    return sanitized(rows)


def centroid_history(
    tracks: DataFrame, length: int = HISTORY, frames_per_stretch: int = S.FRAMES_PER_STRETCH,
) -> DataFrame:
    """Add ``history``: the last ``length`` centres ``(x, y, ts)`` of the track, oldest first."""
    centre = G.geometric_center(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    item = F.struct(centre["x"].alias("x"), centre["y"].alias("y"), F.col("ts"))
    return S.trailing_rows(
        tracks, TRACK, TRACK_ORDER, item, length, S.by_frames(F.col("frame_idx"), frames_per_stretch), "history",
    )


def carry_embedding(
    tracks: DataFrame, column: str = "embedding", frames_per_stretch: int = S.FRAMES_PER_STRETCH
) -> DataFrame:
    """Fill ``column`` with the track's latest known value."""
    carried = S.last_known(
        tracks, TRACK, TRACK_ORDER, F.col(column), S.by_frames(F.col("frame_idx"), frames_per_stretch), "__carried",
    )
    return carried.withColumn(column, F.col("__carried")).drop("__carried")


def track_lifetimes(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy(*TRACK).agg(
        F.min("ts").alias("first_seen_ts"), F.max("ts").alias("last_seen_ts"),
        (F.max("ts") - F.min("ts")).alias("age_seconds"), F.count(F.lit(1)).alias("observations"),
    )


def latest_track_state(tracks: DataFrame, embedding: str | None = None) -> DataFrame:
    """The newest row of every track; its embedding is the newest known one."""
    rest = [c for c in tracks.columns if c not in TRACK and c != embedding]
    aggs = [F.max_by(c, S.at(TRACK_ORDER)).alias(c) for c in rest]
    if embedding:
        aggs.append(F.max_by(embedding, F.when(F.col(embedding).isNotNull(), S.at(TRACK_ORDER))).alias(embedding))
    return tracks.groupBy(*TRACK).agg(*aggs)


def latest_frame(frames: DataFrame) -> DataFrame:
    return frames.groupBy("stream_id").agg(
        F.max("frame_idx").alias("frame_idx"), F.max_by("ts", "frame_idx").alias("ts")
    )


def surviving_track_ids(tracks: DataFrame, before_frame: int, after_frame: int) -> DataFrame:
    """Ids seen both before a gap (frames up to ``before_frame``) and after it (from ``after_frame``)."""
    seen = lambda cond: tracks.filter(cond).select(*TRACK)
    return seen(F.col("frame_idx") <= before_frame).intersect(seen(F.col("frame_idx") >= after_frame))


def id_switch_pairs(
    tracks: DataFrame, seconds: float = G.SWITCH_SECONDS, px: float = G.SWITCH_PX,
    frames_per_stretch: int = S.FRAMES_PER_STRETCH, bucket_seconds: float = 0.5, cell_px: float = 160.0,
) -> DataFrame:
    """A track and every other id whose last sighting is at most ``seconds`` old and ``px`` away.

    An observation stands for its id until the id is seen again, so it is only
    sent to the time buckets of that span (one or two as a rule) and to the grid
    cells it can reach; current rows have one bucket and one cell.
    """
    centre = G.geometric_center(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    seen = tracks.select(*TRACK, *TRACK_ORDER, "ts", centre["x"].alias("x"), centre["y"].alias("y"))
    # the next sighting, found by walking the track backwards
    backwards = seen.withColumn("__neg", -F.col("frame_idx")).withColumn("__neg_ord", -F.col("track_ord"))
    known = S.previous_row(
        backwards, TRACK, ["__neg", "__neg_ord"], ["frame_idx", "ts"],
        -S.by_frames(F.col("frame_idx"), frames_per_stretch), "__next",
    ).drop("__neg", "__neg_ord")
    cell = lambda c, shift=0.0: F.floor((c + F.lit(float(shift))) / F.lit(float(cell_px)))
    bucket = lambda t: F.floor(t / F.lit(float(bucket_seconds)))
    until = F.least(F.coalesce(F.col("__next.ts"), F.lit(float("inf"))), F.col("ts") + F.lit(seconds + 0.001))
    margin = px + 0.001
    earlier = (
        known.withColumn("__bucket", F.explode(F.sequence(bucket(F.col("ts")), bucket(until))))
        .withColumn("__gx", F.explode(F.sequence(cell(F.col("x"), -margin), cell(F.col("x"), margin))))
        .withColumn("__gy", F.explode(F.sequence(cell(F.col("y"), -margin), cell(F.col("y"), margin))))
        .select(
            "stream_id", "__bucket", "__gx", "__gy", F.col("track_id").alias("from_track_id"),
            F.col("frame_idx").alias("__frame"), F.col("__next.frame_idx").alias("__next_frame"),
            F.col("ts").alias("__ts"), F.col("x").alias("__x"), F.col("y").alias("__y"),
        )
    )
    now = (
        seen.withColumnRenamed("track_id", "to_track_id").withColumn("__bucket", bucket(F.col("ts")))
        .withColumn("__gx", cell(F.col("x"))).withColumn("__gy", cell(F.col("y")))
    )
    dx, dy, dt = F.col("x") - F.col("__x"), F.col("y") - F.col("__y"), F.col("ts") - F.col("__ts")
    return (
        now.join(earlier, ["stream_id", "__bucket", "__gx", "__gy"])
        .filter(
            (F.col("to_track_id") != F.col("from_track_id"))
            & (F.col("frame_idx") > F.col("__frame"))
            & (F.col("__next_frame").isNull() | (F.col("frame_idx") <= F.col("__next_frame")))
            & (dt <= F.lit(float(seconds))) & (dx * dx + dy * dy <= F.lit(float(px) * float(px)))
        )
        .select(
            "stream_id", "frame_idx", "ts", "from_track_id", "to_track_id",
            dx.alias("dx"), dy.alias("dy"), dt.alias("dt"),
        )
    )
