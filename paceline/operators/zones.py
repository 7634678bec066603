"""Who is in which zone, frame by frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.functions import geometry as G


def with_centroid(tracks: DataFrame, cameras: DataFrame | None = None, mode: str = "bottom_center") -> DataFrame:
    """Add ``cx, cy``: the point that stands for the person, by the camera's mode (or one mode for all)."""
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    if cameras is None:
        point = G.camera_centroid(F.lit(mode), *box)
        return tracks.withColumn("cx", point["x"]).withColumn("cy", point["y"])
    modes = cameras.select("stream_id", F.col("centroid_mode").alias("__mode"))
    point = G.camera_centroid(F.col("__mode"), *box)
    return (
        tracks.join(modes, "stream_id")
        .withColumn("cx", point["x"]).withColumn("cy", point["y"]).drop("__mode")
    )


def _prepared(zones: DataFrame) -> DataFrame:
    """Zones with their edges and the box around them."""
    xs, ys = F.transform("polygon", lambda p: p["x"]), F.transform("polygon", lambda p: p["y"])
    return zones.select(
        F.col("stream_id").alias("__stream"), "zone_id", G.polygon_edges(F.col("polygon")).alias("__edges"),
        F.array_min(xs).alias("__x_lo"), F.array_max(xs).alias("__x_hi"),
        F.array_min(ys).alias("__y_lo"), F.array_max(ys).alias("__y_hi"),
    )


def zone_membership(points: DataFrame, zones: DataFrame) -> DataFrame:
    """Each row of ``points`` (stream_id, cx, cy, ...) with each zone of its camera that holds it.

    The box around a zone is part of the join, so the polygon test only sees
    the pairs that can match. There is no broadcast hint: the planner knows the
    size of the zone table and decides by that.
    """
    eps = F.lit(G.EDGE_EPS)
    x, y = F.col("cx"), F.col("cy")
    near = (
        (F.col("stream_id") == F.col("__stream"))
        & (x >= F.col("__x_lo") - eps) & (x <= F.col("__x_hi") + eps)
        & (y >= F.col("__y_lo") - eps) & (y <= F.col("__y_hi") + eps)
    )
    inside = G.point_in_edges(x, y, F.col("__edges"))
    return points.join(_prepared(zones), near).filter(inside).select(*points.columns, "zone_id")


#: A zone is covered by at most so many cells along its longer side, and two more at its ends.
RASTER_CELLS = 8


def zone_raster(zones: DataFrame) -> DataFrame:
    """Zones cut into grid cells, for cameras with thousands of them: an index that ``raster_membership`` joins by cell.

    The side of a zone's cells is the power of two that covers it with about
    ``RASTER_CELLS`` of them, so a zone has a hundred rows at most, however large
    it is. A cell that no edge comes near lies wholly inside (``__whole``, no edges
    kept) or outside (no row). Zones without corners or with corners that are not
    finite hold nothing.
    """
    eps = F.lit(G.EDGE_EPS)
    extent = F.greatest(F.col("__x_hi") - F.col("__x_lo"), F.col("__y_hi") - F.col("__y_lo"), F.lit(1.0))
    side = F.pow(F.lit(2.0), F.ceil(F.log2(extent / F.lit(float(RASTER_CELLS)))))
    bounds = [F.col(c) for c in ("__x_lo", "__x_hi", "__y_lo", "__y_hi")]
    finite = bounds[0].isNotNull() & ~F.exists(F.array(*bounds), lambda b: ~G.is_finite(b))
    cells = lambda lo, hi: F.explode(F.sequence(
        F.floor((F.col(lo) - eps) / F.col("__side")), F.floor((F.col(hi) + eps) / F.col("__side"))))
    cut = (
        _prepared(zones).filter(finite).withColumn("__side", side)
        .withColumn("__ix", cells("__x_lo", "__x_hi")).withColumn("__iy", cells("__y_lo", "__y_hi"))
    )
    x, y, s = F.col("__ix") * F.col("__side"), F.col("__iy") * F.col("__side"), F.col("__side")
    scale = F.abs(bounds[0]) + F.abs(bounds[1]) + F.abs(bounds[2]) + F.abs(bounds[3])
    near = F.exists("__edges", lambda e: G.edge_meets_box(e, x, y, x + s, y + s, scale))
    inside = G.point_in_edges(x + s / 2, y + s / 2, F.col("__edges"))
    return (
        cut.withColumn("__near", near).withColumn("__whole", ~F.col("__near") & inside)
        .filter(F.col("__near") | F.col("__whole"))
        .withColumn("__edges", F.when(F.col("__near"), F.col("__edges"))).drop("__near")
    )


def raster_membership(points: DataFrame, raster: DataFrame) -> DataFrame:
    """``zone_membership`` by the index of ``zone_raster``.

    A point looks up one cell for each size of cell its camera has, by equality,
    so it only meets zones that reach into its cells, and is tested against edges
    only where an edge is near.
    """
    eps = F.lit(G.EDGE_EPS)
    x, y = F.col("cx"), F.col("cy")
    sides = raster.groupBy(F.col("__stream").alias("__of")).agg(F.collect_set("__side").alias("__sides"))
    probes = (
        points.join(sides, F.col("stream_id") == F.col("__of")).withColumn("__probe", F.explode("__sides"))
        .withColumn("__px", F.floor(x / F.col("__probe"))).withColumn("__py", F.floor(y / F.col("__probe")))
    )
    cell = (
        (F.col("stream_id") == F.col("__stream")) & (F.col("__probe") == F.col("__side"))
        & (F.col("__px") == F.col("__ix")) & (F.col("__py") == F.col("__iy"))
        & (x >= F.col("__x_lo") - eps) & (x <= F.col("__x_hi") + eps)
        & (y >= F.col("__y_lo") - eps) & (y <= F.col("__y_hi") + eps)
    )
    inside = F.col("__whole") | G.point_in_edges(x, y, F.col("__edges"))
    return probes.join(raster, cell).filter(inside).select(*points.columns, "zone_id")


def zone_occupancy(frames: DataFrame, points: DataFrame, zones: DataFrame) -> DataFrame:
    """Per frame and zone: how many people and which track ids (in list order), empty zones included.

    Every track counts, however low its confidence. Empty rows and memberships
    are put together and grouped once, so there is one shuffle and no join of
    frames with memberships.
    """
    inside = zone_membership(points.select("stream_id", "frame_idx", "track_ord", "track_id", "cx", "cy"), zones)
    people = inside.select(
        "stream_id", "frame_idx", "zone_id", F.lit(None).cast("double").alias("ts"),
        F.struct("track_ord", "track_id").alias("who"),
    )
    blank = frames.join(zones.select("stream_id", "zone_id"), "stream_id").select(
        "stream_id", "frame_idx", "zone_id", "ts",
        F.lit(None).cast(people.schema["who"].dataType).alias("who"),
    )
    return (
        blank.unionByName(people)
        .groupBy("stream_id", "frame_idx", "zone_id")
        .agg(
            F.max("ts").alias("ts"),
            F.count("who").alias("count"),
            F.sort_array(F.collect_list("who")).alias("__who"),
        )
        # a track row without its frame is not a processed frame
        .filter("ts is not null")
        .select(
            "stream_id", "frame_idx", "ts", "zone_id", "count",
            F.transform("__who", lambda w: w["track_id"]).alias("track_ids"),
        )
    )


def zone_counts(frames: DataFrame, points: DataFrame, zones: DataFrame) -> DataFrame:
    """``zone_occupancy`` without the id lists: only counters cross the shuffle."""
    inside = zone_membership(points.select("stream_id", "frame_idx", "cx", "cy"), zones)
    people = inside.select(
        "stream_id", "frame_idx", "zone_id", F.lit(None).cast("double").alias("ts"), F.lit(1).alias("one")
    )
    blank = frames.join(zones.select("stream_id", "zone_id"), "stream_id").select(
        "stream_id", "frame_idx", "zone_id", "ts", F.lit(None).cast("int").alias("one")
    )
    return (
        blank.unionByName(people)
        .groupBy("stream_id", "frame_idx", "zone_id")
        .agg(F.max("ts").alias("ts"), F.count("one").alias("count"))
        .filter("ts is not null")
        .select("stream_id", "frame_idx", "ts", "zone_id", "count")
    )


def zone_occupancy_history(occupancy: DataFrame) -> DataFrame:
    """Per frame: a map from zone to count."""
    return occupancy.groupBy("stream_id", "frame_idx").agg(
        F.max("ts").alias("ts"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("zone_id", "count")))).alias("zone_counts"),
    )
