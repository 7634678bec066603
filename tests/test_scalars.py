import time

import pytest
from pyspark.sql import functions as F

from paceline.functions import geometry as G
from paceline.functions import text as X
from paceline.operators import validate


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lits(*values):
    return [F.lit(float(v)) for v in values]


def test_centroids(spark):
    assert tuple(one(spark, G.bottom_center(*lits(10, 20, 30, 50)))) == (20.0, 50.0)
    assert tuple(one(spark, G.geometric_center(*lits(10, 20, 30, 50)))) == (20.0, 35.0)
    with pytest.raises(Exception, match="unknown centroid_mode"):
        one(spark, G.camera_centroid(F.concat(F.lit("to"), F.lit("p")), *lits(0, 0, 1, 1)))


@pytest.mark.parametrize("prev,cur,expected", [
    (-10, 10, "left_to_right"), (10, -10, "right_to_left"), (-10, -5, None), (5, 10, None), (0, 0, None),
    (0, 5, "left_to_right"), (-5e-4, 5e-4, None), (10, 0, None), (0, -10, None), (10, -5e-4, None),
])
def test_direction_is_not_symmetric(spark, prev, cur, expected):
    assert one(spark, G.classify_direction(*lits(prev, cur))) == expected


SQUARE = [(100, 100), (300, 100), (300, 300), (100, 300)]
NOTCHED = [(0, 0), (100, 0), (100, 100), (50, 50), (0, 100)]


def polygon(points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


@pytest.mark.parametrize("shape,point,inside", [
    (SQUARE, (150, 150), True), (SQUARE, (50, 50), False), (SQUARE, (400, 400), False), (SQUARE, (100, 200), True),
    (SQUARE, (300, 300), True), (SQUARE, (200, 300), True), (NOTCHED, (50, 80), False), (NOTCHED, (50, 50), True),
    (NOTCHED, (20, 60), True), (SQUARE[:2], (200, 100), False),
])
def test_point_in_polygon(spark, shape, point, inside):
    assert one(spark, G.point_in_polygon(*lits(*point), polygon(shape))) is inside


@pytest.mark.parametrize("shape,crossed", [
    ([(0, 0), (100, 100), (100, 0), (0, 100)], True), ([(0, 0), (100, 100), (0, 100), (100, 0)], True),
    (SQUARE, False), (SQUARE[:3], False), (NOTCHED, False),
])
def test_self_intersection(spark, shape, crossed):
    assert one(spark, validate.polygon_self_intersects(polygon(shape))) is crossed


def test_self_intersection_of_a_long_outline(spark):
    ring = F.transform(F.sequence(F.lit(0), F.lit(399)), lambda i: F.struct(
        F.cos(i / 400.0 * 6.283185307179586).alias("x"), F.sin(i / 400.0 * 6.283185307179586).alias("y")))
    begun = time.monotonic()
    assert one(spark, validate.polygon_self_intersects(ring)) is False
    assert time.monotonic() - begun < 20  # making the edges anew for every pair takes minutes


@pytest.mark.parametrize("raw,expected", [
    ("100.0", 100.0), ("2024-01-01T00:00:00Z", 1704067200.0), ("2024-01-01T01:00:00+01:00", 1704067200.0),
    ("2024-01-01T00:00:00", 1704067200.0), ("2024-01-01", 1704067200.0), ("2024-01-01 00:00:00.5", 1704067200.5),
    ("1e3", 1000.0), ("not-a-number", None), (None, None), ("2024-13-01", None),
])
def test_parse_timestamp(spark, raw, expected):
    assert one(spark, X.parse_timestamp(F.lit(raw).cast("string"))) == expected


def test_bad_boxes_and_texts(spark):
    assert tuple(one(spark, G.sanitize_bbox(F.lit(float("nan")), *lits(1, 2, 3)))) == (0, 0, 0, 0)
    assert tuple(one(spark, G.sanitize_bbox(*lits(1, 2, 3), F.lit(float("-inf"))))) == (0, 0, 0, 0)
    assert one(spark, X.clip_path("/e/", F.lit("cam 1"), F.lit(1704067199.5), F.lit(7))) == "/e/cam 1/2023-12-31/7.mp4"
    assert one(spark, X.clip_url("/e", F.lit("cam 1"), F.lit(0.0), F.lit(7))) == "file:///e/cam%201/1970-01-01/7.mp4"
    assert one(spark, X.clip_url("/e", F.lit("c"), F.lit(0.0), F.lit(7), "noop")) == "noop://c/7"
    assert one(spark, X.density_notes(F.lit(7), F.lit(5), F.lit(1.2))) == "count peaked at 7 (threshold 5) for 1.20s"
    assert one(spark, G.l2_normalize(F.array(*lits(3, 4)))) == [0.6, 0.8]
    assert one(spark, G.l2_normalize(F.array(*lits(0, 0)))) == [0.0, 0.0]
