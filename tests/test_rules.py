"""The ordered rules against one-row-at-a-time models, on hand cases and random series, cut in several ways."""

import os
import random

import pytest
from pyspark.sql import functions as F

from paceline import session
from paceline.operators import access, camera_state, density, scans, stretches, tracking, tripwire, zones
from paceline.streaming import transitions as T

WIRE = "stream_id string, tripwire_id string, tw_ord int, p1 struct<x:double,y:double>, p2 struct<x:double,y:double>, " \
       "direction_in string, recycle_after_frames int, recycle_distance_px double"


def walk(spark, ys, wires, x=200.0, frames=None):
    rows = [("c", 1, f, 0, float(f), x, float(y)) for f, y in zip(frames or range(len(ys)), ys)]
    points = spark.createDataFrame(rows, "stream_id string, track_id long, frame_idx long, track_ord long, ts double, cx double, cy double")
    table = spark.createDataFrame([("c", *w) for w in wires], WIRE)
    out = tripwire.crossings_of(points, table, frames_per_stretch=4).orderBy("frame_idx", "tripwire_id").collect()
    return [(r.tripwire_id, r.frame_idx, r.direction) for r in out]


def wire(name="w", y=200.0, direction="left_to_right", frames=60, px=200.0):
    return (name, 0, (0.0, y), (400.0, y), direction, frames, px)


@pytest.mark.parametrize("ys,wires,frames,expected", [
    ([140, 340], [wire()], None, [("w", 1, "in")]),
    ([140, 340, 140], [wire()], None, [("w", 1, "in"), ("w", 2, "out")]),
    ([140, 340, 440], [wire()], None, [("w", 1, "in")]),
    ([140, 340, 150], [wire()], None, [("w", 1, "in")]),
    ([140, 240, 240, 240, 340], [wire()], None, [("w", 1, "in")]),
    ([100, 240, 100], [wire(frames=5, px=500.0)], [0, 1, 22], [("w", 1, "in"), ("w", 22, "out")]),
    ([90, 390], [wire("a", 100.0), wire("b", 300.0)], None, [("a", 1, "in"), ("b", 1, "in")]),
    ([140, 340], [wire(direction="right_to_left")], None, [("w", 1, "out")]),
    ([300, 200, 100], [wire()], None, []),
])
def test_tripwire_cases(spark, ys, wires, frames, expected):
    assert walk(spark, ys, wires, frames=frames) == expected


def test_tripwire_random(spark):
    rng = random.Random(3)
    rows, truth = [], []
    w = dict(id="w", x1=0.0, y1=0.0, x2=100.0, y2=0.0, direction_in="left_to_right", frames=7, px=9.0)
    for track in range(6):
        state, f = None, 0
        for _ in range(120):
            f += rng.choice([1, 1, 1, 2, 9])
            x, y = float(rng.randint(0, 6)), float(rng.randint(-3, 3))
            rows.append(("c", track, f, 0, float(f), x, y))
            state, found = T.cross_wires(state, f, x, y, [w])
            truth += [(track, f, d) for _, d in found]
    points = spark.createDataFrame(rows, "stream_id string, track_id long, frame_idx long, track_ord long, ts double, cx double, cy double")
    table = spark.createDataFrame([("c", "w", 0, (0.0, 0.0), (100.0, 0.0), "left_to_right", 7, 9.0)], WIRE)
    for size in (10_000, 60):
        got = tripwire.crossings_of(points, table, frames_per_stretch=size).collect()
        assert sorted((r.track_id, r.frame_idx, r.direction) for r in got) == sorted(truth)


def alerts(spark, series, t, d, c, size=1200.0, resets=()):
    rows = [("c", "z", float(ts), n, False) for ts, n in series] + [("c", "z", float(r), 0, True) for r in resets]
    df = spark.createDataFrame(rows, "stream_id string, zone_id string, ts double, count long, reset boolean")
    got = density.density_alerts(density.constant_rule(df, t, d, c), size).orderBy("timestamp").collect()
    return [(r.timestamp, r.density_count) for r in got]


@pytest.mark.parametrize("series,t,d,c,expected", [
    ([(100, 6), (100.5, 6), (101.2, 7)], 5, 1, 10, [(101.2, 7)]),
    ([(100, 5), (102, 5)], 5, 1, 10, []),
    ([(100, 6), (100.5, 6), (100.6, 3), (101, 6), (101.5, 6), (102, 6)], 5, 1, 10, [(102.0, 6)]),
    ([(100, 6), (100.5, 6), (101, 6), (105, 7), (109, 8), (110, 9), (112, 9), (120, 3), (121, 7), (122.5, 7)], 5, 1, 10,
     [(101.0, 6), (122.5, 7)]),
    ([(100, 3)], 2, 0, 10, [(100.0, 3)]),
    # the cooldown of the first alert ends in the middle of the second run
    ([(0, 6), (1, 6), (2, 0), (3, 6), (4, 6), (8, 6), (11, 8), (12, 9)], 5, 1, 10, [(1.0, 6), (11.0, 8)]),
])
def test_density_cases(spark, series, t, d, c, expected):
    assert alerts(spark, series, t, d, c, size=5.0) == expected


def test_density_random_and_reset(spark):
    rng = random.Random(5)
    series = [(i * 0.5, rng.choice([0, 3, 3, 3, 4])) for i in range(400)]
    resets = {i * 0.5 for i in range(37, 400, 61)}
    for with_resets in (False, True):
        state, truth = None, []
        for ts, n in series:
            if with_resets and ts in resets:
                state, _ = T.crowd(state, ts, 0, True, 2, 1.0, 6.0)
            state, fired = T.crowd(state, ts, n, False, 2, 1.0, 6.0)
            if fired:
                truth.append((ts, fired[0]))
        for size in (1200.0, 7.0):
            assert alerts(spark, series, 2, 1.0, 6.0, size, resets if with_resets else ()) == truth


def test_cooldown_random(spark):
    rng = random.Random(6)
    series = [(i * 0.5, rng.choice([0, 9, 9])) for i in range(300)]
    state, truth = None, []
    for ts, n in series:
        state, fires = T.cooled(state, ts, n, 8, 10.0)
        truth += [ts] if fires else []
    df = spark.createDataFrame([("c", "z", t, n) for t, n in series], "stream_id string, zone_id string, ts double, count long")
    for size in (14400.0, 30.0):
        got = density.density_cooldown_alerts(df, seconds_per_stretch=size).orderBy("timestamp").collect()
        assert [r.timestamp for r in got] == truth


def decisions(spark, crossings, scan_rows, w, size=1200.0):
    c = spark.createDataFrame(
        [("c", "A", "A", i, i, 0, float(ts)) for i, ts in enumerate(crossings)],
        "stream_id string, tripwire_id string, zone_id string, track_id long, frame_idx long, track_ord long, ts double")
    s = spark.createDataFrame([("A", float(t), who, i) for i, (t, who) in enumerate(scan_rows)],
                              "zone_id string, ts double, identity string, arrival long")
    got = access.access_decisions(access.to_crossing_records(c), s, w, seconds_per_stretch=size).orderBy("track_id").collect()
    return [(r.kind, r.scan_identity) for r in got]


@pytest.mark.parametrize("crossings,scan_rows,expected", [
    ([102], [(100, "a")], [("authorized", "a")]),
    ([110.0, 110.001], [(100, "a")], [("authorized", "a"), ("unmatched", None)]),
    ([100.5, 101.5, 200.5], [(100, "alice"), (200, "bob")],
     [("authorized", "alice"), ("tailgating", "alice"), ("authorized", "bob")]),
    ([100, 105, 108], [(102, "a")], [("authorized", "a"), ("tailgating", "a"), ("tailgating", "a")]),
    ([-10, 10], [(0, "a")], [("authorized", "a"), ("authorized", "a")]),
    ([100], [(95, "early"), (105, "late")], [("authorized", "early")]),
    ([100], [(100, "first"), (100, "second")], [("authorized", "second")]),
])
def test_access_cases(spark, crossings, scan_rows, expected):
    assert decisions(spark, crossings, scan_rows, 10.0) == expected


def decide(ts, scans, used, window):
    """One pass: ``used`` has the last crossing on each scan."""
    near = [s for s in scans if ts - window <= s[0] <= ts + window]
    if not near:
        return "unmatched", None
    best = min(near, key=lambda s: (abs(s[0] - ts), s[0]))
    behind = best[0] in used and abs(used[best[0]] - ts) <= window
    used[best[0]] = ts
    return ("tailgating" if behind else "authorized"), best


def test_access_random(spark):
    rng = random.Random(7)
    scan_rows = sorted({rng.randint(0, 400) * 0.5 for _ in range(60)})
    crossings = sorted(rng.randint(0, 800) * 0.25 for _ in range(120))
    used, truth = {}, []
    for ts in crossings:
        kind, scan = decide(ts, [[s, f"p{s}", 0] for s in scan_rows], used, 1.5)
        truth.append((kind, scan[1] if scan else None))
    for size in (1200.0, 6.0):
        assert decisions(spark, crossings, [(s, f"p{s}") for s in scan_rows], 1.5, size) == truth


def test_scan_windows(spark):
    s = spark.createDataFrame([("A", 100.0, "alice", 1), ("A", 105.0, "bob", 2), ("A", 130.0, "carol", 3), ("B", 100.0, "x", 4)],
                              "zone_id string, ts double, identity string, arrival long")
    for ts, w, who in ((100, 5, {"alice", "bob"}), (105, 1, {"bob"}), (130, 5, {"carol"}), (110, 10, {"alice", "bob"}), (105, 0, {"bob"})):
        probe = spark.createDataFrame([("A", float(ts))], "zone_id string, ts double")
        assert {r.scan_identity for r in scans.scan_window_lookup(probe, s, w).collect()} == who
        assert scans.scan_count_near(probe, s, float(w), 3.0).first().n_scans == len(who)


def boxes(spark, seed, n_frames=120):
    rng = random.Random(seed)
    frames, dets = [], []
    for cam in ("a", "b"):
        for f in range(n_frames):
            frames.append((cam, f, f * 0.5))
            if f % 40 in (10, 11, 12):
                continue
            for k in range(4):
                if rng.random() < 0.8:
                    x, y = 30.0 * k + (f * (k + 1)) % 23, 10.0 + (f * 3) % 17
                    dets.append((cam, f, f * 0.5, k, k, x, y, x + 40.0, y + 50.0, 0.5, 0))
    return (spark.createDataFrame(frames, "stream_id string, frame_idx long, ts double"),
            spark.createDataFrame(dets, "stream_id string, frame_idx long, ts double, det_ord long, det_id long, x1 double, y1 double, x2 double, y2 double, conf double, cls int"),
            frames, dets)


@pytest.mark.parametrize("max_age", [2, 30])
def test_tracker_against_one_pass(spark, max_age):
    frames_df, dets_df, frames, dets = boxes(spark, 11)
    truth = {}
    for cam in ("a", "b"):
        tracker = camera_state.BoxTracker(max_age, 0.2, fresh=1)
        for _, f, _ in [r for r in frames if r[0] == cam]:
            now = [d for d in dets if d[0] == cam and d[1] == f]
            for d, ref in zip(now, tracker.frame([d[5:9] for d in now])):
                truth[(cam, f, d[3])] = ref
    for size, warm in ((1000, None), (40, 8)):
        got = camera_state.iou_tracker(frames_df, dets_df, max_age, 0.2, size, warm).collect()
        assert {(r.stream_id, r.frame_idx, r.det_ord): r.track_id for r in got} == truth


def test_id_switches_against_one_pass(spark):
    rng = random.Random(12)
    rows = []
    for f in range(200):
        for k in rng.sample(range(6), 4):
            rows.append(("c", f, f * 0.5, len(rows), k, 10.0 * k + rng.randint(0, 30), 0.0))
    truth, detector = [], camera_state.SwitchDetector(2.0, 40.0, 5.0)
    for f in range(200):
        people = [r for r in rows if r[1] == f]
        truth += [(f, i, a, b) for i, (a, b, *_) in enumerate(detector.frame(f * 0.5, [(r[4], r[5], r[6]) for r in people]))]
    df = spark.createDataFrame(
        [(s, f, ts, o, t, x - 5, y - 5, x + 5, y + 5) for s, f, ts, o, t, x, y in rows],
        "stream_id string, frame_idx long, ts double, track_ord long, track_id long, x1 double, y1 double, x2 double, y2 double")
    for size, warm in ((1000, 600), (50, 6)):
        got = camera_state.id_switches(df, frames_per_stretch=size, warm_up_frames=warm).collect()
        assert sorted((r.frame_idx, r.ord, r.from_track_id, r.to_track_id) for r in got) == truth


def test_cuts_do_not_matter(spark):
    rng = random.Random(13)
    rows = [("c", k, f, 0, f * 1.0, float(rng.randint(0, 9)), None if rng.random() < 0.7 else f) for k in range(3)
            for f in sorted(rng.sample(range(300), 90))]
    df = spark.createDataFrame(rows, "stream_id string, track_id long, frame_idx long, track_ord long, ts double, v double, e long")
    keys, order = ["stream_id", "track_id"], ["frame_idx", "track_ord"]
    def all_of(size):
        cut = stretches.by_frames(F.col("frame_idx"), size)
        out = stretches.previous_row(df, keys, order, ["v"], cut, "prev")
        out = stretches.last_known(out, keys, order, F.col("e"), cut, "known")
        out = stretches.running_number(out, keys, order, cut, "n")
        out = stretches.running_max(out, keys, order, F.col("v"), cut, "top")
        out = stretches.trailing_rows(out, keys, order, F.col("v"), 5, cut, "tail")
        return sorted(map(str, out.select(*keys, "frame_idx", "prev", "known", "n", "top", "tail").collect()))
    whole = all_of(10_000)
    assert all_of(50) == whole and all_of(7) == whole


def test_occupancy_keeps_low_confidence_and_empty_zones(spark):
    frames = spark.createDataFrame([("c", 0, 0.0), ("c", 1, 1.0)], "stream_id string, frame_idx long, ts double")
    tracks = spark.createDataFrame(
        [("c", 0, 0.0, i, i + 1, p - 10.0, p - 10.0, p + 10.0, float(p), conf) for i, (p, conf) in enumerate([(110, 0.05), (200, 0.9), (500, 0.9)])],
        "stream_id string, frame_idx long, ts double, track_ord long, track_id long, x1 double, y1 double, x2 double, y2 double, conf double")
    zone = spark.createDataFrame([("c", "z", 0, [(100.0, 100.0), (300.0, 100.0), (300.0, 300.0), (100.0, 300.0)])],
                                 "stream_id string, zone_id string, zone_ord int, polygon array<struct<x:double,y:double>>")
    got = zones.zone_occupancy(frames, zones.with_centroid(tracks), zone).orderBy("frame_idx").collect()
    assert [(r["count"], r.track_ids) for r in got] == [(2, [1, 2]), (0, [])]
    cams = spark.createDataFrame([("c", 0.25)], "stream_id string, display_conf double")
    assert tracking.display_tracks(tracks, cams).count() == 2


def test_large_order_numbers(spark):
    """Order numbers far above any packing: the row before is the one of the frame before."""
    rows = [("c", 7, 1, 3_145_728, 1.0, 10.0), ("c", 7, 2, 5_000_000_000, 2.0, 20.0), ("c", 7, 30, 0, 30.0, 30.0)]
    df = spark.createDataFrame(rows, "stream_id string, track_id long, frame_idx long, track_ord long, ts double, v double")
    keys, order = ["stream_id", "track_id"], ["frame_idx", "track_ord"]
    for size in (10, 10_000):
        cut = stretches.by_frames(F.col("frame_idx"), size)
        out = stretches.previous_row(df, keys, order, ["v"], cut, "prev")
        out = stretches.last_known(out, keys, order, F.when(F.col("frame_idx") < 3, F.col("v")), cut, "known").orderBy("frame_idx")
        assert [(r.prev and r.prev.v, r.known) for r in out.collect()] == [(None, 10.0), (10.0, 20.0), (20.0, 20.0)]
    assert tracking.latest_track_state(df).first().v == 30.0


def test_people_who_stay_take_few_rounds(spark):
    """Two who never leave, the later one listed first: one round, whatever the number of stretches."""
    n, size = 64 * 20, 20
    frames = spark.range(n).selectExpr("'c' as stream_id", "id as frame_idx", "id * 0.5D as ts")
    dets = []
    for f in range(n):
        people = [(0.0, 0.0)] if f < 5 else [(200.0, 0.0), (0.0, 0.0)]
        dets += [("c", f, k, k, x, y, x + 40.0, y + 80.0, 0.9, 0) for k, (x, y) in enumerate(people)]
    df = spark.createDataFrame(dets, "stream_id string, frame_idx long, det_ord long, det_id long, x1 double, y1 double, "
                                     "x2 double, y2 double, conf double, cls int")
    runs, _ = camera_state._tracked(frames, df, 5, 0.2, size, 12)
    assert runs.rounds <= 2
    got = camera_state.iou_tracker(frames, df, 5, 0.2, size, 12)
    assert {(r.x1, r.track_id) for r in got.select("x1", "track_id").distinct().collect()} == {(0.0, 1), (200.0, 2)}


def test_order_decides_equal_overlaps_across_a_cut(spark):
    """Two tracks in mirror image and one box between them just after a cut: the older one gets it."""
    frames_df = spark.range(12).selectExpr("'c' as stream_id", "id as frame_idx", "id * 0.5D as ts")
    left, right, middle = (0.0, 0.0, 40.0, 40.0), (20.0, 0.0, 60.0, 40.0), (10.0, 0.0, 50.0, 40.0)
    for first, second in ((left, right), (right, left)):
        boxes_of = {0: [first], 1: [first, second], 2: [second, first], 3: [first, second], 4: [middle], 5: [middle], 6: [left, right]}
        rows = [("c", f, k, k, *b, 0.9, 0) for f, bs in boxes_of.items() for k, b in enumerate(bs)]
        df = spark.createDataFrame(rows, "stream_id string, frame_idx long, det_ord long, det_id long, x1 double, y1 double, "
                                         "x2 double, y2 double, conf double, cls int")
        tracker, truth = camera_state.BoxTracker(30, 0.2, fresh=1), {}
        for f in range(12):
            for k, ref in enumerate(tracker.frame(boxes_of.get(f, []))):
                truth[f, k] = ref
        for size in (100, 4, 2):
            got = camera_state.iou_tracker(frames_df, df, 30, 0.2, size, 2).collect()
            assert {(r.frame_idx, r.det_ord): r.track_id for r in got} == truth


def test_zone_that_never_empties(spark):
    """64 stretches crowded throughout: alerts as in one pass, written tables by the logarithm of the stretches."""
    rng = random.Random(5)
    times = sorted(rng.uniform(0, 64 * 20) for _ in range(4000))
    df = spark.createDataFrame([("c", "z", t, 9) for t in times], "stream_id string, zone_id string, ts double, count long")
    truth, last = [], 0.0
    for t in times:
        if t - last >= 7.3:
            truth.append(t)
            last = t
    made = []
    kept = density.cut_lineage
    density.cut_lineage = lambda d: made.append(1) or kept(d)
    try:
        got = density.density_cooldown_alerts(df, 8, 7.3, 20.0).orderBy("timestamp").collect()
    finally:
        density.cut_lineage = kept
    assert [r.timestamp for r in got] == truth
    assert len(made) <= 4 + 2 * 8
    assert density.density_cooldown_alerts(df, 8, 0.0, 20.0).count() == len(times)


@pytest.mark.parametrize("n_stretches", [64, 1000])
def test_guard_chain_takes_rounds_by_the_logarithm(spark, monkeypatch, n_stretches):
    """A chain that never breaks: one-pass results, a table per doubling and a few more, and two of them left."""
    rng, size = random.Random(n_stretches), 20
    rows, frame = [], 0
    while frame < n_stretches * size:
        rows.append(("c", "w", 1, frame, 0, frame * 0.5, "in", rng.uniform(0, 300), rng.uniform(0, 300), 30, 250.0))
        frame += rng.choice([1, 2, 5, 11])
    df = spark.createDataFrame(rows, "stream_id string, tripwire_id string, track_id long, frame_idx long, track_ord long, ts double, "
                                     "direction string, cx double, cy double, recycle_after_frames int, recycle_distance_px double")
    truth, last = [], None
    for r in rows:
        if last is None or r[3] - last[3] >= 30 or ((r[7] - last[7]) ** 2 + (r[8] - last[8]) ** 2) ** 0.5 >= 250.0:
            truth.append(r[3])
            last = r
    made = []

    def noted(df, narrow=False):
        made.append(session.cut_lineage(df, narrow))
        return made[-1]

    monkeypatch.setattr(stretches, "cut_lineage", noted)
    got = tripwire.tripwire_crossings(df, size)
    assert [r.frame_idx for r in got.orderBy("frame_idx").collect()] == truth
    # pieces, their spans, up to two stretches looked into (30 frames of 20), the doublings, the path
    assert len(made) <= 6 + (n_stretches - 1).bit_length()
    assert sum(os.path.exists(t._paceline_path.removeprefix("file:")) for t in made) <= 2


def test_rule_that_looks_far_back(spark):
    """Stretches far shorter than the rule's memory, and keys with one row or none accepted after the first."""
    rows = [(k, f) for k in ("a", "b") for f in range(0, 90, 3)] + [("c", 5), ("d", 1), ("d", 2)]
    df = spark.createDataFrame(rows, "k string, f long")
    got = stretches.accepted_rows(df, ["k"], ["f"], [], stretches.by_frames(F.col("f"), 4), lambda last, row, m: row["f"] - last["f"] >= 25)
    assert sorted(map(tuple, got.collect())) == sorted([(k, f) for k in ("a", "b") for f in (0, 27, 54, 81)] + [("c", 5), ("d", 1)])
    none = stretches.accepted_rows(df.limit(0), ["k"], ["f"], [], stretches.by_frames(F.col("f"), 4), lambda last, row, m: row["f"] > last["f"])
    assert none.count() == 0


def test_ghosts_that_never_fade_take_few_rounds(spark):
    """A state that goes on through all stretches (a second track kept alive by crossings): repaired some stretches a round."""
    n, size = 60 * 20, 20
    frames = spark.range(n).selectExpr("'c' as stream_id", "id as frame_idx", "id * 0.5D as ts")
    boxes_of = {}
    for f in range(n):
        boxes_of[f] = [(0.0, 0.0, 40.0, 40.0), (20.0, 0.0, 60.0, 40.0)] if f < 3 else [(10.0, 0.0, 50.0, 40.0)] if f % 4 else [
            (0.0, 0.0, 40.0, 40.0), (20.0, 0.0, 60.0, 40.0)][f // 4 % 2:][:1 + f % 3 // 2]
    rows = [("c", f, k, k, *b, 0.9, 0) for f, bs in boxes_of.items() for k, b in enumerate(bs)]
    df = spark.createDataFrame(rows, "stream_id string, frame_idx long, det_ord long, det_id long, x1 double, y1 double, "
                                     "x2 double, y2 double, conf double, cls int")
    tracker, truth = camera_state.BoxTracker(30, 0.2, fresh=1), {}
    for f in range(n):
        for k, ref in enumerate(tracker.frame(boxes_of[f])):
            truth[f, k] = ref
    runs, _ = camera_state._tracked(frames, df, 30, 0.2, size, 2)
    assert runs.rounds <= 4
    got = camera_state.iou_tracker(frames, df, 30, 0.2, size, 2).collect()
    assert {(r.frame_idx, r.det_ord): r.track_id for r in got} == truth
