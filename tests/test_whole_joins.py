"""Points meet every zone and every wire of their camera, in every frame."""

import pytest

from paceline.plans import catalog
from paceline.plans import inputs as I

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "table", "key"), [
    ("point_in_polygon", I.zones, "zone_id"), ("signed_area", I.tripwires, "tripwire_id")])
def test_every_zone_and_wire(spark, name, table, key):
    of = {}
    for r in table(spark).collect():
        of.setdefault(r["stream_id"], []).append(r[key])
    wanted = sorted((r["stream_id"], r["frame_idx"], r["track_id"], k)
                    for r in catalog.points(spark, SF).collect() for k in of.get(r["stream_id"], []))
    got = catalog.QUERIES[name](spark, SF).collect()
    assert sorted((r["stream_id"], r["frame_idx"], r["track_id"], r[key]) for r in got) == wanted
