"""Configuration checks: one row (stream_id, object_id, rule) per breach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.functions import geometry as G
from paceline.sources.config import load_cameras, load_tripwires, load_zones


def _breaches(rows: DataFrame, object_id: Column, rules: dict[str, Column]) -> DataFrame:
    found = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()])
    return rows.select(
        "stream_id", object_id.alias("object_id"), F.explode(F.filter(found, lambda r: r.isNotNull())).alias("rule"))


def duplicate_ids(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def _duplicates(rows: DataFrame, object_id: str, rule: str) -> DataFrame:
    keys = ["stream_id"] if object_id == "stream_id" else ["stream_id", object_id]
    return duplicate_ids(rows, keys).select(
        "stream_id", F.col(object_id).alias("object_id"), F.lit(rule).alias("rule"))


def validate_cameras(config: DataFrame) -> DataFrame:
    c = F.col
    cams = load_cameras(config)
    sizes = config.select(F.coalesce("id", F.lit("")).alias("stream_id"), "frame_size")
    rules = {
        "id_required": c("stream_id") == "",
        "source_required": c("source") == "",
        "tracker_type_known": ~c("tracker_type").isin("bytetrack", "botsort"),
        "appearance_needs_botsort": c("use_appearance") & (c("tracker_type") != "botsort"),
        "buffer_seconds_positive": c("buffer_seconds") <= 0,
        "fps_fallback_positive": c("fps_fallback") <= 0,
        "display_conf_in_0_1": ~c("display_conf").between(0.0, 1.0) | F.isnan("display_conf"),
        "centroid_mode_known": ~c("centroid_mode").isin("bottom_center", "geometric_center"),
        "max_density_threshold_positive": c("max_density_threshold") <= 0,
        "density_dwell_not_negative": c("density_dwell_seconds") < 0,
        "density_cooldown_not_negative": c("density_cooldown_seconds") < 0,
    }
    size = F.transform("frame_size", lambda v: v.cast("int"))
    frame = {"frame_size_pair_of_positive": (F.size("frame_size") != 2) | F.exists(size, lambda v: v.isNull() | (v <= 0))}
    none = config.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(
        F.lit(None).cast("string").alias("stream_id"), F.lit(None).cast("string").alias("object_id"),
        F.lit("at_least_one_stream").alias("rule"))
    return (
        _breaches(cams, c("stream_id"), rules)
        .unionByName(_breaches(sizes.filter("frame_size is not null"), c("stream_id"), frame))
        .unionByName(_duplicates(cams, "stream_id", "stream_id_unique"))
        .unionByName(none)
    )


def polygon_self_intersects(polygon: Column) -> Column:
    """True where two edges that do not follow one another cross."""
    n = F.size(polygon)
    # the edges are made once for a polygon: a lambda's variable is a value, any other expression in it is worked out at every turn
    numbered = F.transform(G.polygon_edges(polygon), lambda e, i: F.struct(i.alias("i"), e.alias("e")))

    def crossing(a: Column, b: Column, last: Column) -> Column:
        closing = (a["i"] == 0) & (b["i"] == last)
        e, f = a["e"], b["e"]
        return ~closing & G.segments_intersect(e["x1"], e["y1"], e["x2"], e["y2"], f["x1"], f["y1"], f["x2"], f["y2"])

    def any_crossing(edges: Column, last: Column) -> Column:
        later = lambda a: F.slice(edges, a["i"] + 3, F.greatest(last - a["i"], F.lit(0)))
        return F.exists(edges, lambda a: F.exists(later(a), lambda b: crossing(a, b, last)))

    made = F.array(F.struct(numbered.alias("edges"), (n - 1).alias("last")))
    return F.when(n < 4, F.lit(False)).otherwise(F.get(F.transform(made, lambda m: any_crossing(m["edges"], m["last"])), F.lit(0)))


def validate_zones(config: DataFrame) -> DataFrame:
    zones = load_zones(config)
    rules = {
        "id_required": F.col("zone_id") == "",
        "at_least_3_points": F.coalesce(F.size("polygon"), F.lit(0)) < 3,
        "points_are_pairs": F.col("bad_points"),
        "not_self_intersecting": ~F.col("bad_points") & polygon_self_intersects(F.col("polygon")),
    }
    return _breaches(zones, F.col("zone_id"), rules).unionByName(_duplicates(zones, "zone_id", "zone_id_unique"))


def validate_tripwires(config: DataFrame) -> DataFrame:
    c = F.col
    wires = load_tripwires(config)
    ends = [c("p1.x"), c("p1.y"), c("p2.x"), c("p2.y")]
    finite = G.is_finite(ends[0]) & G.is_finite(ends[1]) & G.is_finite(ends[2]) & G.is_finite(ends[3])
    inside = (
        ends[0].between(0, c("frame_w")) & ends[1].between(0, c("frame_h"))
        & ends[2].between(0, c("frame_w")) & ends[3].between(0, c("frame_h"))
    )
    sized = c("frame_w").isNotNull() & c("frame_h").isNotNull()
    rules = {
        "id_required": c("tripwire_id") == "",
        "points_are_pairs": c("bad_points"),
        "ends_differ": ~c("bad_points") & (ends[0] == ends[2]) & (ends[1] == ends[3]),
        "ends_finite": ~c("bad_points") & ~finite,
        "inside_frame": ~c("bad_points") & finite & sized & ~inside,
        "recycle_after_frames_not_negative": c("recycle_after_frames") < 0,
        "recycle_distance_px_not_negative": c("recycle_distance_px") < 0,
        "direction_in_known": ~c("direction_in").isin("left_to_right", "right_to_left"),
    }
    return _breaches(wires, c("tripwire_id"), rules).unionByName(
        _duplicates(wires, "tripwire_id", "tripwire_id_unique"))
