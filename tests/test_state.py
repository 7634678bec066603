"""State has a lifetime, and can be read as a table."""

import json

import pytest
from pyspark.sql import functions as F

from paceline.operators import camera_state, density
from paceline.sources import sinks
from paceline.streaming import inspection
from paceline.streaming import processors as P


def play(spark, tmp_path, tables, build, steps):
    """Feed the rows of each step to a stream and look at its checkpoint and output after each."""
    checkpoint, out = str(tmp_path / "checkpoint"), str(tmp_path / "out")
    folders = [str(tmp_path / f"in{k}") for k in range(len(tables))]
    for step in steps:
        for df, folder in zip(tables, folders):
            df.filter(step).coalesce(1).write.mode("append").parquet(folder)
        streams = [spark.readStream.schema(df.schema).parquet(f) for df, f in zip(tables, folders)]
        made = build(*streams)
        query = sinks.results_sink(made, sinks.log_sink(out), checkpoint).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        yield checkpoint, spark.read.schema(made.schema).option("recursiveFileLookup", "true").parquet(out)


def keys(spark, checkpoint, variable="memory"):
    return sorted(tuple(r["key"]) for r in inspection.state_rows(spark, checkpoint, variable).collect())


def test_switch_slots_go_after_their_memory(spark, tmp_path):
    rows = []
    for cam, times in (("a", (10.0, 10.5, 60.0, 60.5, 200.0)), ("b", (10.0, 199.0, 200.0))):
        for f, t in enumerate(times):
            rows += [(cam, f, t, 0, 2 * f, 100.0, 100.0, 140.0, 180.0), (cam, f, t, 1, 2 * f + 1, 500.0, 100.0, 540.0, 180.0)]
    tracks = spark.createDataFrame(rows, "stream_id string, frame_idx long, ts double, track_ord long, track_id long, x1 double, y1 double, x2 double, y2 double")
    seen = []
    steps = ["ts < 20", "ts between 20 and 100", "ts > 100"]
    for checkpoint, out in play(spark, tmp_path, [tracks], lambda s: P.stream_id_switches(s, "1 seconds"), steps):
        seen.append(keys(spark, checkpoint))
    # the last look: time is at 199, where b has just been seen and a not since 60.5
    assert seen[-1] == [("b",)]
    wanted = camera_state.id_switches(tracks.filter("ts < 100"))
    text = lambda df: sorted(map(tuple, df.select("stream_id", "frame_idx", "from_track_id", "to_track_id").collect()))
    assert text(out) == text(wanted) and wanted.count() == 4


def test_cooldown_goes_with_the_cooldown(spark, tmp_path):
    counts = spark.createDataFrame(
        [("a", "z", t, 5) for t in (10.0, 12.0, 21.0, 40.0, 50.5)] + [("b", "z", t, 5) for t in (10.0, 100.0, 300.0)],
        "stream_id string, zone_id string, ts double, count long").withColumn("frame_idx", F.col("ts").cast("long"))
    steps = ["ts < 30", "ts between 30 and 200", "ts > 200"]
    build = lambda s: P.stream_density_cooldown_alerts(s, 3, 10.0, "1 seconds")
    looks = [(keys(spark, c), out) for c, out in play(spark, tmp_path, [counts], build, steps)]
    assert looks[0][0] == [] or ("a", "z") in looks[0][0]
    assert looks[-1][0] == []
    text = lambda df: sorted(map(tuple, df.select("timestamp", "stream_id", "zone_id", "density_count").collect()))
    assert text(looks[-1][1]) == text(density.density_cooldown_alerts(counts.filter("ts < 200"), 3, 10.0))


@pytest.mark.parametrize("own", [False, True])
def test_idle_camera_loses_tracks_and_keeps_its_ids(spark, tmp_path, own):
    times = (10.0, 11.0, 500.0, 501.0, 2000.0)
    frames = spark.createDataFrame([("c", f, t) for f, t in enumerate(times)], "stream_id string, frame_idx long, ts double")
    boxes = frames.select("*", F.lit(0).cast("long").alias("det_ord"), F.lit(0).cast("long").alias("det_id"), F.lit(100.0).alias("x1"), F.lit(100.0).alias("y1"),
                          F.lit(150.0).alias("x2"), F.lit(200.0).alias("y2"), F.lit(0.9).alias("conf"), F.lit(0).alias("cls"))
    def build(f, b):
        if own:
            return P.stream_tracker(f, b, camera_state.OverlapTracker, "1 seconds", 60.0)
        return P.stream_iou_tracker(f, b, delay="1 seconds", idle_seconds=60.0)
    steps = ["ts < 100", "ts between 100 and 1000", "ts > 1000"]
    looks = [(c, out) for c, out in play(spark, tmp_path, [frames, boxes], build, steps)]
    checkpoint, out = looks[-1]
    assert sorted((r.frame_idx, r.track_id) for r in out.collect()) == [(0, 1), (1, 1), (2, 2), (3, 2)]
    left = json.loads(inspection.state_rows(spark, checkpoint).first()["body"])
    assert left == ([None, [], 3] if own else {"live": [], "fresh": 3})
    sizes = inspection.state_sizes(spark, checkpoint).first()
    assert sizes["keys"] == 1 and sizes["characters"] == sizes["largest"] < 40
    assert inspection.state_rows(spark, checkpoint, "waiting").count() == 2  # the frame and the box at 2000
