"""Membership by the raster of zones is membership by their boxes."""

import random

from paceline import schemas
from paceline.operators import zones

POINTS = "stream_id string, n long, cx double, cy double"


def _zones(rng, n, span):
    out = []
    for i in range(n):
        x, y, size = rng.uniform(-200, span), rng.uniform(-200, span), rng.choice([0.0, 0.5, 8, 60, 300])
        kind = rng.randrange(4)
        if kind == 0:  # a box on whole numbers, so that points fall on its edges and corners
            a, b, c = int(x), int(y), int(size)
            corners = [(a, b), (a + c, b), (a + c, b + c), (a, b + c)]
        else:  # any order of corners: concave, crossing itself, or too few
            corners = [(x + rng.uniform(0, size), y + rng.uniform(0, size)) for _ in range(rng.choice([0, 2, 3, 5, 9]))]
        out.append(("dense" if i % 10 else "few", f"z{i}", i, [(float(a), float(b)) for a, b in corners]))
    return out


def _points(rng, n, span, zone_rows):
    out = [("dense" if i % 5 else "few", i, rng.uniform(-220, span + 300), rng.uniform(-220, span + 300)) for i in range(n)]
    for stream, _, _, corners in zone_rows[:300]:  # corners, and the middle of edges
        for (ax, ay), (bx, by) in zip(corners, corners[1:]):
            out += [(stream, len(out), ax, ay), (stream, len(out) + 1, (ax + bx) / 2, (ay + by) / 2)]
    nan, inf = float("nan"), float("inf")
    out += [("dense", -1, None, 5.0), ("dense", -2, nan, 5.0), ("dense", -3, 5.0, inf), ("none", -4, 5.0, 5.0), (None, -5, 5.0, 5.0)]
    return out


def test_raster_equals_boxes(spark):
    rng = random.Random(3)
    zone_rows = _zones(rng, 5000, 1500)
    z = spark.createDataFrame(zone_rows, schemas.ZONES)
    points = spark.createDataFrame(_points(rng, 1500, 1500, zone_rows), POINTS).repartition(8)
    raster = zones.zone_raster(z).cache()
    got = zones.raster_membership(points, raster)
    wanted = zones.zone_membership(points, z)
    text = lambda df: sorted(map(str, df.select("n", "zone_id").collect()))
    assert text(got) == text(wanted) and wanted.count() > 1000
    # a zone has a hundred cells at most; cells in the middle of a zone need no edges
    assert raster.groupBy("zone_id").count().agg({"count": "max"}).first()[0] <= 100
    assert raster.filter("__whole and __edges is null").count() > 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # pairs that meet in a cell: a small part of all pairs of a camera
    pairs = points.crossJoin(z.select("stream_id").withColumnRenamed("stream_id", "s")).filter("stream_id = s").count()
    cells = points.count() * raster.count() / raster.select("__stream", "__side", "__ix", "__iy").distinct().count()
    assert cells * 20 < pairs
    raster.unpersist()


def test_raster_of_no_zones(spark):
    z = spark.createDataFrame([], schemas.ZONES)
    points = spark.createDataFrame([("dense", 1, 1.0, 1.0)], POINTS)
    assert zones.raster_membership(points, zones.zone_raster(z)).count() == 0
