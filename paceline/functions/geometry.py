"""Geometry on pixel coordinates: Column in, Column out. y grows downwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tolerances and limits that decide results (fixed values).
LINE_EPS = 1e-3
EDGE_EPS = 1e-7
IOU_EPS = 1e-6
SWITCH_SECONDS = 2.0
SWITCH_PX = 40.0
SWITCH_MEMORY_SECONDS = 5.0


def _zero() -> Column:
    return F.lit(0.0)


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def sanitize_bbox(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The box as a struct, or a zero box at the origin if any coordinate is not finite."""
    usable = is_finite(x1) & is_finite(y1) & is_finite(x2) & is_finite(y2)
    return F.struct(
        *[F.when(usable, c).otherwise(_zero()).alias(n)
          for n, c in (("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2))]
    )


def bottom_center(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(((x1 + x2) / F.lit(2.0)).alias("x"), y2.alias("y"))


def geometric_center(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(((x1 + x2) / F.lit(2.0)).alias("x"), ((y1 + y2) / F.lit(2.0)).alias("y"))


def camera_centroid(mode: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The point a camera's mode stands for; an unknown mode fails the query."""
    mid_x = (x1 + x2) / F.lit(2.0)
    y = (
        F.when(mode == "bottom_center", y2)
        .when(mode == "geometric_center", (y1 + y2) / F.lit(2.0))
        .otherwise(
            F.raise_error(F.concat(F.lit("unknown centroid_mode: "), F.coalesce(mode, F.lit("null")))).cast("double")
        )
    )
    return F.struct(mid_x.alias("x"), y.alias("y"))


def signed_area(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Twice the area of (a, b, p): its sign tells the side of the line a-b that p lies on."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def classify_direction(prev_sign: Column, cur_sign: Column) -> Column:
    """Side change between two positions, null if none.

    The two directions are not mirror images: coming from the negative side or
    from the line counts as soon as the positive side is reached, but the other
    way needs a start clearly on the positive side and an end clearly beyond.
    """
    eps = F.lit(LINE_EPS)
    return F.when((prev_sign <= eps) & (cur_sign > eps), F.lit("left_to_right")).when(
        (prev_sign > eps) & (cur_sign <= -eps), F.lit("right_to_left")
    )


def map_in_out(raw_direction: Column, direction_in: Column) -> Column:
    return F.when(raw_direction.isNull(), F.lit(None)).otherwise(
        F.when(raw_direction == direction_in, F.lit("in")).otherwise(F.lit("out"))
    )


def point_on_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    eps = F.lit(EDGE_EPS)
    return (
        (F.abs((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)) <= eps)
        & (px >= F.least(x1, x2) - eps) & (px <= F.greatest(x1, x2) + eps)
        & (py >= F.least(y1, y2) - eps) & (py <= F.greatest(y1, y2) + eps)
    )


def polygon_edges(polygon: Column) -> Column:
    """Array of edges (x1, y1, x2, y2), the closing edge last."""
    following = F.concat(F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))), F.slice(polygon, 1, 1))
    return F.zip_with(
        polygon, following,
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
    )


def _ray_hit(px: Column, py: Column, e: Column) -> Column:
    straddles = (e["y2"] > py) != (e["y1"] > py)
    at = F.try_divide((e["x1"] - e["x2"]) * (py - e["y2"]), e["y1"] - e["y2"]) + e["x2"]
    return straddles & F.coalesce(at > px, F.lit(False))


def point_in_edges(px: Column, py: Column, edges: Column) -> Column:
    """Even-odd test against an array of edges; the boundary belongs to the polygon."""
    odd = F.pmod(F.size(F.filter(edges, lambda e: _ray_hit(px, py, e))), F.lit(2)) == 1
    touching = F.exists(
        edges, lambda e: point_on_segment(px, py, e["x1"], e["y1"], e["x2"], e["y2"])
    )
    return (F.size(edges) >= 3) & (odd | touching)


def point_in_polygon(px: Column, py: Column, polygon: Column) -> Column:
    return point_in_edges(px, py, polygon_edges(polygon))


def edge_meets_box(e: Column, x_lo: Column, y_lo: Column, x_hi: Column, y_hi: Column, scale: Column) -> Column:
    """False only where an edge stays clear of a box, tolerances and rounding at coordinates up to ``scale`` included."""
    eps = F.lit(LINE_EPS)
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    side = [dx * (y - e["y1"]) - dy * (x - e["x1"]) for x in (x_lo, x_hi) for y in (y_lo, y_hi)]
    clear = eps + F.lit(1e-9) * (F.abs(dx) + F.abs(dy)) * scale
    return (
        (F.least(e["x1"], e["x2"]) - eps <= x_hi) & (F.greatest(e["x1"], e["x2"]) + eps >= x_lo)
        & (F.least(e["y1"], e["y2"]) - eps <= y_hi) & (F.greatest(e["y1"], e["y2"]) + eps >= y_lo)
        & (F.least(*side) <= clear) & (F.greatest(*side) >= -clear)
    )


def segments_intersect(
    ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column
) -> Column:
    """True where a-b and c-d cross properly; touching and collinear overlap do not count."""
    def opposite(u: Column, v: Column) -> Column:
        return ((u > 0) & (v < 0)) | ((u < 0) & (v > 0))

    return opposite(
        signed_area(cx, cy, dx, dy, ax, ay), signed_area(cx, cy, dx, dy, bx, by)
    ) & opposite(signed_area(ax, ay, bx, by, cx, cy), signed_area(ax, ay, bx, by, dx, dy))


def iou(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    zero = _zero()
    w = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    inter = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.try_divide(inter, union + F.lit(IOU_EPS))


def centroid_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def centroid_distance_sq(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, _zero(), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def l2_normalize(vector: Column) -> Column:
    """The vector over its length; a zero vector stays as it is."""
    norm = l2_norm(vector)
    return F.when(norm > 0, F.transform(vector, lambda v: v.cast("double") / norm)).otherwise(
        F.transform(vector, lambda v: v.cast("double"))
    )
