"""Trackers of one's own: in stretches and on streams what one pass over all frames gives."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from paceline.operators import camera_state
from paceline.sources import sinks
from paceline.streaming import processors as P


def velocity_tracker():
    """Made in a function, so that workers get it by value."""
    class VelocityTracker:
        """Predicts by the last step, numbers a track at its second box, uses weak boxes for old tracks only; ';' in its state."""

        def __init__(self, new_id, reach=30.0, patience=4):
            self.new_id, self.reach, self.patience = new_id, reach, patience
            self.tracks = []  # [id or None, x, y, vx, vy, age]

        def frame(self, ts, boxes):
            for t in self.tracks:
                t[1], t[2], t[5] = t[1] + t[3], t[2] + t[4], t[5] + 1
            self.tracks = [t for t in self.tracks if t[5] <= self.patience]
            found, taken = [None] * len(boxes), set()
            for strong in (True, False):
                for i, (x1, y1, x2, y2, conf, _) in enumerate(boxes):
                    if (conf >= 0.5) is not strong:
                        continue
                    x, y = (x1 + x2) / 2, (y1 + y2) / 2
                    near = [(abs(t[1] - x) + abs(t[2] - y), k) for k, t in enumerate(self.tracks) if k not in taken]
                    gap, k = min(near, default=(1e9, -1))
                    if gap <= self.reach:
                        t = self.tracks[k]
                        taken.add(k)
                        if t[0] is None:
                            t[0] = self.new_id()
                        self.tracks[k] = [t[0], x, y, round(x - t[1] + t[3]), round(y - t[2] + t[4]), 0]
                        found[i] = t[0]
                    elif strong:
                        taken.add(len(self.tracks))
                        self.tracks.append([None, x, y, 0, 0, 0])
            return found

        def snapshot(self):
            ids = [t[0] for t in self.tracks if t[0] is not None]
            return ";".join(json.dumps([ids.index(t[0]) if t[0] is not None else None, *t[1:]]) for t in self.tracks), ids

        def restore(self, state, ids):
            rows = [json.loads(t) for t in state.split(";")] if state else []
            self.tracks = [[ids[t[0]] if t[0] is not None else None, *t[1:]] for t in rows]

    return VelocityTracker


BOXES = ("stream_id string, frame_idx long, ts double, det_ord long, det_id long, x1 double, y1 double, x2 double, y2 double, "
         "conf double, cls int")


def scene(seed, n=240):
    rng = random.Random(seed)
    frames, boxes = [], []
    for cam in ("a", "b"):
        walkers = [[rng.uniform(0, 600), rng.uniform(0, 400), rng.randint(-6, 6), rng.randint(-4, 4)] for _ in range(5)]
        for f in range(n):
            ts = 10.0 + f * 0.5
            frames.append((cam, f, ts))
            if f % 60 > 52:
                continue
            k = 0
            for w in walkers:
                w[0], w[1] = (w[0] + w[2]) % 600, (w[1] + w[3]) % 400
                if rng.random() < 0.8:
                    boxes.append((cam, f, ts, k, k, w[0], w[1], w[0] + 30.0, w[1] + 60.0, rng.choice([0.3, 0.7, 0.9]), 0))
                    k += 1
    return frames, boxes


def one_pass(make, frames, boxes):
    truth = {}
    for cam in ("a", "b"):
        numbers = itertools.count(1)
        tracker = make(lambda: next(numbers))  # noqa: B023
        for _, f, ts in [r for r in frames if r[0] == cam]:
            now = [b for b in boxes if b[0] == cam and b[1] == f]
            for b, got in zip(now, tracker.frame(ts, [b[5:] for b in now])):
                truth[cam, f, b[3]] = got
    return truth


def tables(spark, frames, boxes):
    return spark.createDataFrame(frames, "stream_id string, frame_idx long, ts double"), spark.createDataFrame(boxes, BOXES)


@pytest.mark.parametrize("size,warm", [(1000, 150), (40, 20), (15, 3)])
def test_in_stretches(spark, size, warm):
    frames, boxes = scene(3)
    make = velocity_tracker()
    truth = one_pass(make, frames, boxes)
    assert None in truth.values() and max(t for t in truth.values() if t) > 8
    track = camera_state.stretched_tracker(make, size, warm)
    got = camera_state.run_tracker(*tables(spark, frames, boxes), "Own ", {"own": track})
    assert {(r.stream_id, r.frame_idx, r.det_ord): r.track_id for r in got.collect()} == truth


def test_the_box_tracker_by_the_protocol(spark):
    frames, boxes = tables(spark, *scene(4))
    got = camera_state.stretched_tracker(camera_state.OverlapTracker, 40, 10)(frames, boxes)
    wanted = camera_state.iou_tracker(frames, boxes)
    text = lambda df: sorted(map(tuple, df.select("stream_id", "frame_idx", "det_ord", "track_id").collect()))
    assert text(got) == text(wanted)


def test_without_detections(spark):
    frames, _ = tables(spark, *scene(5, 30))
    none = spark.createDataFrame([], BOXES)
    assert camera_state.stretched_tracker(velocity_tracker(), 10, 5)(frames, none).count() == 0
    assert camera_state.stretched_tracker(velocity_tracker(), 10, 5)(frames.limit(0), none).count() == 0


def test_on_a_stream(spark, tmp_path):
    frames, boxes = scene(6, 120)
    make = velocity_tracker()
    truth = one_pass(make, frames, boxes)
    streams = []
    for name, df in zip(("frames", "boxes"), tables(spark, frames, boxes)):
        path = str(tmp_path / name)
        for part in range(4):
            df.filter((F.col("frame_idx") / 30).cast("int") == part).orderBy(F.col("ts").desc()).coalesce(1).write.mode("append").parquet(path)
        df.limit(1).withColumn("ts", F.lit(1e6)).withColumn("stream_id", F.lit("~")).coalesce(1).write.mode("append").parquet(path)
        streams.append(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path))
    out = str(tmp_path / "out")
    tracked = P.stream_tracker(*streams, make, delay="60 seconds")
    query = sinks.results_sink(tracked, sinks.log_sink(out), str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    got = spark.read.schema(tracked.schema).option("recursiveFileLookup", "true").parquet(out).filter("stream_id <> '~'").collect()
    assert {(r.stream_id, r.frame_idx, r.det_ord): r.track_id for r in got} == truth
