"""Streaming forms give what the batch forms give, fed file by file and partly out of order."""

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from paceline.operators import access, alertlog, camera_state, density, evidence, metrics, tripwire, zones
from paceline.plans import catalog as C
from paceline.plans import inputs as I  # noqa: E741
from paceline.sources import sinks
from paceline.streaming import intervals
from paceline.streaming import processors as P
from paceline.streaming import transitions as T

SF = "/root/testdata/sf0.001"
END = 1e6


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """A stream of ``df`` in several files; then one row of an unrelated key far in the future moves time on."""
    def make(df, name, key):
        path = str(tmp_path_factory.mktemp(name))
        part = F.floor(F.col("ts") / 25.0)
        rows = df.withColumn("__part", part).persist()
        n = int(rows.agg(F.max("__part")).first()[0])
        for i in range(n + 1):
            # rows of one file in reverse order
            rows.filter(F.col("__part") == i).drop("__part").orderBy(F.col("ts").desc()).coalesce(1).write.mode("append").parquet(path)
        last = df.orderBy("ts").limit(1).withColumn("ts", F.lit(END)).withColumn(key, F.lit("~"))
        last.coalesce(1).write.mode("append").parquet(path)
        rows.unpersist()
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)
    return make


def run(spark, stream, tmp_path):
    out = str(tmp_path / "out")
    query = sinks.results_sink(stream, sinks.log_sink(out), str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(out)


def same(got, wanted, columns):
    text = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert text(got) == text(wanted) and wanted.count() > 0


def test_crossings(spark, feed, tmp_path):
    points = C.points(spark, SF).select("stream_id", "track_id", "frame_idx", "ts", "track_ord", "cx", "cy")
    stream = P.stream_tripwire_crossings(feed(points, "points", "stream_id"), I.tripwires(spark), "60 seconds")
    same(run(spark, stream, tmp_path), tripwire.crossings_of(points, I.tripwires(spark)), C.CROSSING_COLUMNS)


def test_density(spark, feed, tmp_path):
    ruled = C.ruled(spark, SF).withColumn("reset", F.expr("frame_idx = 20"))
    columns = ["timestamp", "stream_id", "zone_id", "density_count", "threshold", "dwell_seconds", "notes"]
    stream = P.stream_density_alerts(feed(ruled, "ruled", "zone_id"), "60 seconds")
    same(run(spark, stream, tmp_path), density.density_alerts(ruled), columns)


def test_cooldown(spark, feed, tmp_path):
    counts = C.counts(spark, SF)
    stream = P.stream_density_cooldown_alerts(feed(counts, "counts", "zone_id"), 2, 10.0, "60 seconds")
    same(run(spark, stream, tmp_path).filter("zone_id <> '~'"), density.density_cooldown_alerts(counts, 2, 10.0),
         ["timestamp", "stream_id", "zone_id", "density_count"])


def test_access(spark, feed, tmp_path):
    records = C.records(spark, SF).select("stream_id", "zone_id", "tripwire_id", "track_id", "frame_idx", "track_ord", "ts", "direction")
    scans = I.scans(spark, SF)
    stream = P.stream_access_decisions(feed(records, "records", "zone_id"), feed(scans, "scans", "zone_id"), 1.0, "200 seconds")
    got = run(spark, stream, tmp_path).filter("zone_id <> '~'")
    same(got, access.access_decisions(records, scans, 1.0),
         ["ts", "zone_id", "track_id", "kind", "authorized", "scan_ts", "scan_identity"])


def test_tracker_and_switches(spark, feed, tmp_path):
    # the watermark starts at the epoch, and a row at the epoch itself would be late
    later = lambda df: df.withColumn("ts", F.col("ts") + 10.0)
    frames, found = later(I.frames(spark, SF)), later(I.detections(spark, SF))
    stream = P.stream_iou_tracker(feed(frames, "frames", "stream_id"), feed(found, "found", "stream_id"), delay="200 seconds")
    got = run(spark, stream, tmp_path / "a").filter("stream_id <> '~'")
    same(got, camera_state.iou_tracker(frames, found), ["stream_id", "frame_idx", "det_ord", "track_id", "x1", "y2"])
    # two people change ids half way
    tracks = later(I.tracks(spark, SF)).withColumn(
        "track_id", F.expr("case when frame_idx >= 25 and det_ord in (1, 2) then 3 - det_ord else track_id end")
    ).withColumn("x1", F.expr("case when det_ord in (1, 2) then 0.0 else x1 end")).withColumn(
        "x2", F.expr("case when det_ord in (1, 2) then 40.0 + det_ord else x2 end")).withColumn(
        "y1", F.expr("case when det_ord in (1, 2) then 0.0 else y1 end")).withColumn("y2", F.expr("case when det_ord in (1, 2) then 80.0 else y2 end"))
    switches = P.stream_id_switches(feed(tracks, "tracks", "stream_id"), "60 seconds")
    same(run(spark, switches, tmp_path / "b"), camera_state.id_switches(tracks),
         ["stream_id", "frame_idx", "from_track_id", "to_track_id", "dt"])


def test_idle_tracks_are_forgotten(spark, feed, tmp_path):
    rows = [("c", 1, f, float(t), 0, 100.0, y) for f, t, y in ((0, 10.0, 0.0), (1, 500.0, 300.0), (2, 501.0, 0.0))]
    points = spark.createDataFrame(rows, "stream_id string, track_id long, frame_idx long, ts double, track_ord long, cx double, cy double")
    wires = spark.createDataFrame([("c", "w", 0, (0.0, 100.0), (400.0, 100.0), "left_to_right", 0, 0.0)],
                                  I.schemas.TRIPWIRES)
    all_ = run(spark, P.stream_tripwire_crossings(feed(points, f"p{uuid.uuid4().hex}", "stream_id"), wires, "1 seconds"), tmp_path / "a")
    assert sorted(r.frame_idx for r in all_.collect()) == [1, 2]
    some = run(spark, P.stream_tripwire_crossings(feed(points, f"p{uuid.uuid4().hex}", "stream_id"), wires, "1 seconds", 60.0), tmp_path / "b")
    assert sorted(r.frame_idx for r in some.collect()) == [2]


def test_failing_handler_is_kept_apart(spark, tmp_path):
    batch = spark.createDataFrame([(1, "first")], "id long, notes string")
    def fail(df, batch_id):
        raise RuntimeError("no")
    sinks.alert_handler(fail, str(tmp_path / "failed"))(batch, 3)
    kept = spark.read.parquet(str(tmp_path / "failed" / "batch=3")).first()
    assert kept.notes == "first | on_violation callback raised: RuntimeError"
    seen = []
    sinks.alert_handler(lambda df, i: seen.append((i, df.count())), str(tmp_path / "f2"))(batch, 4)
    assert seen == [(4, 1)]


def test_counts_stream_from_zones(spark, feed, tmp_path):
    """Membership has no state, so it runs on a stream as it is."""
    points = C.points(spark, SF).select("stream_id", "track_id", "frame_idx", "ts", "track_ord", "cx", "cy")
    got = run(spark, zones.zone_membership(feed(points, "members", "stream_id"), I.zones(spark)), tmp_path)
    same(got, zones.zone_membership(points, I.zones(spark)), ["stream_id", "frame_idx", "track_id", "zone_id"])


def test_boxes_to_decisions_in_one_query(spark, feed, tmp_path):
    later = lambda df: df.withColumn("ts", F.col("ts") + 10.0)
    frames, found, scans = later(I.frames(spark, SF)), later(I.detections(spark, SF)), later(I.scans(spark, SF))
    tracked = P.stream_iou_tracker(feed(frames, "f1", "stream_id"), feed(found, "d1", "stream_id"), delay="60 seconds")
    points = zones.with_centroid(tracked.withColumn("track_ord", F.col("det_ord")), I.cameras(spark))
    crossed = P.stream_tripwire_crossings(points, I.tripwires(spark), "60 seconds")
    records = crossed.withColumn("zone_id", F.col("tripwire_id"))
    stream = P.stream_access_decisions(records, feed(scans, "s1", "zone_id"), 1.0, "60 seconds")
    got = run(spark, stream, tmp_path)
    tracks = camera_state.iou_tracker(frames, found).withColumn("track_ord", F.col("det_ord"))
    wanted = access.access_decisions(
        access.to_crossing_records(tripwire.crossings_of(zones.with_centroid(tracks, I.cameras(spark)), I.tripwires(spark))),
        scans, 1.0)
    same(got, wanted, ["ts", "zone_id", "track_id", "direction", "kind", "scan_ts", "scan_identity"])


def test_boxes_to_alert_log_in_one_query(spark, feed, tmp_path):
    later = lambda df: df.withColumn("ts", F.col("ts") + 10.0)
    frames, found = later(I.frames(spark, SF)), later(I.detections(spark, SF))
    frames_stream = feed(frames, "f2", "stream_id")
    tracked = P.stream_iou_tracker(frames_stream, feed(found, "d2", "stream_id"), delay="60 seconds")
    points = zones.with_centroid(tracked, I.cameras(spark))
    counted = P.stream_zone_counts(frames_stream, points, I.zones(spark), "60 seconds")
    stream = P.stream_density_alerts(density.camera_rule(counted, I.cameras(spark)), "60 seconds")
    path = str(tmp_path / "log")
    write = sinks.numbered_log_sink(path, alertlog.record_density_alerts)
    def twice(batch, batch_id):  # as if the first try had been lost
        write(batch, batch_id)
        write(batch, batch_id)
    query = sinks.results_sink(stream, twice, str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    log = sinks.read_log(spark, path)
    tracks = camera_state.iou_tracker(frames, found)
    wanted = density.density_alerts(density.camera_rule(
        zones.zone_counts(frames, zones.with_centroid(tracks, I.cameras(spark)), I.zones(spark)), I.cameras(spark)))
    same(log, wanted, ["timestamp", "stream_id", "zone_id", "density_count", "notes"])
    assert sorted(r.id for r in log.select("id").collect()) == list(range(1, wanted.count() + 1))


def test_stage_failures_on_a_stream(spark, feed, tmp_path):
    """Splitting frames by failed stage has no state, so failures run to their table on a stream as they are."""
    staged = C._staged(spark, SF)
    got = run(spark, metrics.stage_split(feed(staged, "staged", "stream_id"))[1], tmp_path).filter("stream_id <> '~'")
    same(got, metrics.stage_split(staged)[1], ["stream_id", "frame_idx", "stage", "reason", "dropped"])


def _access_rows(seed, n):
    rng = random.Random(seed)
    crossings = [("cam", "z", "z", i, i, 0, round(1000 + rng.random() * n * 0.7, 1), "in") for i in range(n)]
    scans = [("z", round(1000 + rng.random() * n * 0.7, 1), f"p{i % 5}", i) for i in range(n // 2)]
    return crossings, scans


CROSSED = "stream_id string, zone_id string, tripwire_id string, track_id long, frame_idx long, track_ord long, ts double, direction string"


def test_late_rows_correct_decisions(spark, tmp_path):
    """Scans and crossings behind the watermark: decisions and their corrections are those of the batch form."""
    crossings, scans = _access_rows(7, 120)
    all_c, all_s = spark.createDataFrame(crossings, CROSSED), spark.createDataFrame(scans, I.schemas.SCANS)
    on_time = (F.col("track_id") % 7 != 0, F.col("arrival") % 4 != 0)
    cp, sp = str(tmp_path / "c"), str(tmp_path / "s")
    move = lambda ts: (spark.createDataFrame([("~", "~", "~", 0, 0, 0, ts, "in")], CROSSED), spark.createDataFrame([("~", ts, "p", 0)], I.schemas.SCANS))
    out = str(tmp_path / "out")
    def run_once():
        stream = P.stream_access_decisions(
            spark.readStream.schema(all_c.schema).parquet(cp), spark.readStream.schema(all_s.schema).parquet(sp), 2.0, "1 second",
            correct_seconds=500.0)
        query = sinks.results_sink(stream, sinks.log_sink(out), str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        return stream.schema
    for part_c, part_s, until in (
        (all_c.filter(on_time[0]), all_s.filter(on_time[1]), 1300.0), (all_c.filter(~on_time[0]), all_s.filter(~on_time[1]), 1301.0),
        (all_c.limit(0), all_s.limit(0).union(spark.createDataFrame([("z", 500.0, "old", 999)], I.schemas.SCANS)), 5000.0),
    ):
        end_c, end_s = move(until)
        part_c.union(end_c).coalesce(1).write.mode("append").parquet(cp)
        part_s.union(end_s).coalesce(1).write.mode("append").parquet(sp)
        schema = run_once()
    got = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out).filter("zone_id = 'z'")
    columns = ["ts", "track_id", "kind", "authorized", "scan_ts", "scan_identity"]
    same(P.latest_decisions(got), access.access_decisions(all_c, all_s, 2.0), columns)
    # the first ones are those of the rows in time, and something had to be corrected
    first = got.filter("revision = 0 and kind <> 'too_late'").filter(on_time[0])
    same(first, access.access_decisions(all_c.filter(on_time[0]), all_s.filter(on_time[1]), 2.0), columns)
    assert got.filter("revision > 0").count() > 5
    assert [(r.kind, r.scan_ts, r.scan_identity) for r in got.filter("kind = 'too_late'").collect()] == [("too_late", 500.0, "old")]
    # all pages of the zone are gone once the watermark is far past them
    pages = spark.read.format("statestore").option("stateVarName", "book").load(str(tmp_path / "checkpoint"))
    assert pages.filter("key.zone_id = 'z'").count() == 0 and pages.count() > 0


def test_decision_reads_two_pages_of_many_scans():
    """The work of a decision does not grow with the scans of its zone."""
    kept = {}
    filled = T.AccessBook(5.0, kept.get)
    for i in range(100_000):
        filled.add_scan(i * 3.0, f"p{i}", i)
    kept = {page: json.dumps(body) for page, body in filled.pages.items()}
    for ts in (12.0, 150_001.4, 299_990.0):
        book = T.AccessBook(5.0, kept.get)
        book.add_crossing(ts, [ts], {})
        found = book.settle([(ts, ts + 5.0)])[0]["found"]
        nearest = min(range(100_000), key=lambda i: (abs(i * 3.0 - ts), i))
        assert found == ["authorized", nearest * 3.0, f"p{nearest}"] and len(book.pages) <= 2


def test_unmatched_on_a_stream(spark, feed, tmp_path):
    crossings, scans = _access_rows(11, 200)
    c, s = spark.createDataFrame(crossings, CROSSED), spark.createDataFrame(scans[::4], I.schemas.SCANS)
    wanted = access.unmatched_crossings(c, s, 2.0)
    later = lambda df: df.withColumn("ts", F.col("ts") - 1000.0 + 1.0)
    stream = intervals.stream_unmatched_crossings(
        feed(later(c), "uc", "zone_id"), feed(later(s), "us", "zone_id"), 2.0, "200 seconds", piece_seconds=10.0)
    got = run(spark, stream, tmp_path).filter("zone_id <> '~'")
    same(got, access.unmatched_crossings(later(c), later(s), 2.0), ["ts", "zone_id", "track_id", "frame_idx"])
    assert 0 < wanted.count() < c.count()


def test_evidence_on_a_stream(spark, feed, tmp_path):
    frames = spark.createDataFrame([("cam", i, 1.0 + i * 0.5) for i in range(200) if not 90 <= i < 120], "stream_id string, frame_idx long, ts double")
    alerts = spark.createDataFrame([(i, "cam", t, t) for i, t in enumerate([1.0, 3.25, 9.5, 52.0, 53.0, 60.0, 99.0])],
                                   "id long, stream_id string, timestamp double, ts double")
    stream = intervals.stream_evidence_window(
        feed(alerts.drop("timestamp"), "ea", "stream_id").withColumn("timestamp", F.col("ts")), feed(frames, "ef", "stream_id"), 2.0, 1.0, "200 seconds", piece_seconds=6.0, keep_empty=True)
    got = run(spark, stream, tmp_path).filter("stream_id <> '~'")
    same(got.filter("frame_idx is not null"), evidence.evidence_window(alerts, frames, 2.0, 1.0), ["id", "stream_id", "alert_ts", "frame_idx", "ts"])
    assert sorted(r.id for r in got.filter("frame_idx is null").collect()) == [3, 4]
