"""Every operator as a query over the given tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.functions import geometry as G
from paceline.functions import text as X
from paceline.operators import access, alertlog, camera_state, density, evidence, metrics, quality, report, scans
from paceline.operators import tracking, tripwire, validate, zones
from paceline.plans import inputs as I  # noqa: E741
from paceline.session import new_folder
from paceline.sources import config, ledger, media

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
W = I.ACCESS_WINDOW
BASE = "/evidence"
# Stretches far shorter than the defaults, so that results cross many cuts also on small tables.
FRAMES, SECONDS = 50, 20.0
TRACKER = dict(frames_per_stretch=100, warm_up_frames=60)
RULE = dict(threshold=2, dwell_seconds=1.0, cooldown_seconds=5.0)
BOX = ("x1", "y1", "x2", "y2")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _box() -> list:
    return [F.col(c) for c in BOX]


def _text(array, item=lambda v: v.cast("string"), sep=","):
    return F.array_join(F.transform(array, item), sep)


# ---- tables several queries start from


def points(s, d):
    return zones.with_centroid(I.tracks(s, d), I.cameras(s))


def crossings(s, d):
    return tripwire.crossings_of(points(s, d), I.tripwires(s), frames_per_stretch=FRAMES)


def records(s, d):
    return access.to_crossing_records(crossings(s, d))


def decisions(s, d):
    return access.access_decisions(records(s, d), I.scans(s, d), W, seconds_per_stretch=SECONDS)


def violations(s, d):
    return access.access_violations(records(s, d), I.scans(s, d), W, seconds_per_stretch=SECONDS)


def violation_log(s, d):
    return alertlog.record_violations(access.violation_rows(violations(s, d)))


def counts(s, d):
    return zones.zone_counts(I.frames(s, d), points(s, d), I.zones(s))


def ruled(s, d):
    return density.camera_rule(counts(s, d), I.cameras(s))


def alerts(s, d):
    return density.density_alerts(ruled(s, d), SECONDS)


def alert_log(s, d):
    return alertlog.record_density_alerts(density.density_alert_rows(alerts(s, d)))


def displayed(s, d):
    return tracking.display_tracks(I.tracks(s, d), I.cameras(s))


def samples(s, d):
    return I.stage_samples(s, d).withColumn("seconds", F.col("micros") / F.lit(1e6))


def matches(s, d):
    return quality.match_tracks_to_gt(I.scored_tracks(s, d), I.truth(s, d))


LOG_COLUMNS = ["id", "timestamp", "stream_id", "zone_id", "tripwire_id", "track_id", "direction", "kind",
               "matching_identity", "matching_scan_ts", "notes", "clip_path", "clip_url"]
ALERT_COLUMNS = ["id", "timestamp", "stream_id", "zone_id", "density_count", "threshold", "dwell_seconds", "notes",
                 "clip_path", "clip_url"]
CROSSING_COLUMNS = ["stream_id", "tripwire_id", "track_id", "frame_idx", "ts", "direction", "cx", "cy"]

# ---- sources, intake, sinks


@query
def read_detections(s, d):
    return I.detections(s, d)


@query
def detect_frames(s, d):
    """Frames whose content spells out what is to be seen, and a detector that reads it."""
    shown = I.detections(s, d).withColumn("cls", F.when(F.col("det_ord") == 5, 2).otherwise(0))
    frames = tracking.detections_matrix(shown).select(
        "stream_id", "frame_idx", (F.col("frame_idx").cast("double") * F.lit(0.5)).alias("ts"),
        F.to_json("matrix").alias("content"))
    return media.detect_frames(frames, lambda frame: json.loads(frame["content"]))


@query
def index_tracker(s, d):
    return camera_state.run_tracker(I.frames(s, d), I.detections(s, d), " Index").select(
        "stream_id", "frame_idx", "det_ord", "track_id")


@query
def ingest_scans(s, d):
    return scans.ingest_scans(I.scan_payloads(s, d)).drop("payload")


@query
def rejected_scans(s, d):
    return scans.rejected_scans(scans.ingest_scans(I.scan_payloads(s, d)))


@query
def parse_timestamp(s, d):
    raw = F.get_json_object("payload", "$.timestamp")
    return I.scan_payloads(s, d).select("arrival", X.parse_timestamp(raw).alias("ts"))


@query
def dedup_scans(s, d):
    return scans.dedup_scans(I.scans(s, d))


@query
def prune_scans(s, d):
    return scans.prune_scans(scans.dedup_scans(I.scans(s, d)), 100.0)


@query
def pruned_count(s, d):
    return scans.pruned_count(scans.dedup_scans(I.scans(s, d)), 100.0)


def _config(s, d):
    return config.parse_config(I.camera_docs(s, d))


@query
def load_cameras(s, d):
    return config.load_cameras(_config(s, d))


@query
def load_zones(s, d):
    return config.load_zones(_config(s, d)).select(
        "stream_id", "zone_id", "zone_ord", _text(F.col("polygon"), lambda p: F.concat_ws(" ", p["x"], p["y"])).alias("polygon"))


@query
def load_tripwires(s, d):
    return config.load_tripwires(_config(s, d)).select(
        "stream_id", "tripwire_id", "tw_ord", F.col("p1.x").alias("p1x"), F.col("p1.y").alias("p1y"),
        F.col("p2.x").alias("p2x"), F.col("p2.y").alias("p2y"), "direction_in", "recycle_after_frames", "recycle_distance_px")


@query
def record_violations(s, d):
    return violation_log(s, d).select(*LOG_COLUMNS)


@query
def record_density_alerts(s, d):
    return alert_log(s, d).select(*ALERT_COLUMNS)


UNKNOWN = 10**9


def _clips(log):
    """A clip for every alert, two in three under an id that the log does not have."""
    return log.select(
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.col("id") + UNKNOWN).alias("id"), X.clip_path(BASE, F.col("stream_id"), F.col("timestamp"), F.col("id")).alias("clip_path"),
        X.clip_url(BASE, F.col("stream_id"), F.col("timestamp"), F.col("id")).alias("clip_url"))


@query
def attach_clip(s, d):
    log = violation_log(s, d)
    return alertlog.attach_clip(log, _clips(log)).select("id", "stream_id", "timestamp", "clip_path", "clip_url")


@query
def results_sink(s, d):
    def shown(batch):
        return displayed_of(batch).select("stream_id", "frame_idx", F.lit(None).cast("string").alias("name"), F.col("track_id").alias("n"))

    def displayed_of(batch):
        return tracking.display_tracks(batch, I.cameras(s))

    def counted(batch):
        placed = zones.with_centroid(batch, I.cameras(s))
        return zones.zone_counts(I.frames(s, d), placed, I.zones(s)).select(
            "stream_id", "frame_idx", F.col("zone_id").alias("name"), F.col("count").cast("long").alias("n"))

    def crossed(batch):
        placed = zones.with_centroid(batch, I.cameras(s))
        return tripwire.crossings_of(placed, I.tripwires(s), frames_per_stretch=FRAMES).select(
            "stream_id", "frame_idx", F.col("tripwire_id").alias("name"), F.col("track_id").alias("n"))

    path = new_folder(s)
    outputs = {"displayed": shown, "counts": counted, "crossings": crossed}
    handler = ledger.outputs_sink(path, outputs)
    for _ in range(2):  # the second time it is there already
        handler(I.tracks(s, d), 0)
    found = [ledger.read_output(s, path, name).select(F.lit(name).alias("output"), "stream_id", "frame_idx", "name", "n") for name in outputs]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query
def alert_log_versions(s, d):
    rows = density.density_alert_rows(alerts(s, d))
    middle = rows.agg(F.avg("timestamp")).first()[0] or 0.0
    log = ledger.AlertLog(s, new_folder(s))
    for batch, half in ((0, F.col("timestamp") < middle), (0, F.lit(True)), (1, F.col("timestamp") >= middle)):
        log.append(alertlog.record_density_alerts(rows.filter(half)), "alerts", batch)  # a batch that is repeated counts once
    if log.read() is None:
        return alert_log(s, d).select(*ALERT_COLUMNS)
    log.attach(_clips(log.read()))
    log.compact()
    return log.read().select(*ALERT_COLUMNS)


@query
def expired_clips(s, d):
    index = I.table(s, d, "orders").select(
        F.concat(F.lit("/evidence/"), F.col("o_orderkey").cast("string"), F.lit(".mp4")).alias("path"),
        F.unix_date(F.col("o_orderdate").cast("date")).cast("double").__mul__(F.lit(86400.0)).alias("modified_ts"))
    return evidence.expired_clips(index, 883612800.0, 365.0)


# ---- projections and scalars


@query
def display_tracks(s, d):
    return displayed(s, d).select("stream_id", "frame_idx", "track_id", "conf")


@query
def sanitize_bbox(s, d):
    broken = I.tracks(s, d).withColumn(
        "x1", F.expr("case det_ord when 1 then double('NaN') when 2 then double('Infinity') else x1 end"))
    return tracking.sanitized(broken).select("stream_id", "frame_idx", "track_id", *BOX)


@query
def bottom_center(s, d):
    p = G.bottom_center(*_box())
    return I.tracks(s, d).select("stream_id", "frame_idx", "track_id", p["x"].alias("x"), p["y"].alias("y"))


@query
def geometric_center(s, d):
    p = G.geometric_center(*_box())
    return I.tracks(s, d).select("stream_id", "frame_idx", "track_id", p["x"].alias("x"), p["y"].alias("y"))


@query
def camera_centroid(s, d):
    mode = F.when(F.col("stream_id").isin("cam0", "cam1"), F.lit("geometric_center")).otherwise(F.lit("bottom_center"))
    p = G.camera_centroid(mode, *_box())
    return I.tracks(s, d).select("stream_id", "frame_idx", "track_id", p["x"].alias("x"), p["y"].alias("y"))


@query
def to_crossing_records(s, d):
    partly = crossings(s, d).withColumn(
        "zone_id", F.when(F.col("frame_idx") % 3 == 0, F.lit("")).when(F.col("frame_idx") % 3 == 1, F.lit("z_rect"))
    ).withColumn("tripwire_id", F.when(F.col("frame_idx") % 5 != 0, F.col("tripwire_id"))).withColumn(
        "direction", F.when(F.col("track_id") != 1, F.col("direction")))
    return access.to_crossing_records(partly).select(
        "stream_id", "zone_id", "tripwire_id", "track_id", "ts", "direction")


@query
def occupancy_snapshots(s, d):
    partly = counts(s, d).withColumn("count", F.when(F.col("frame_idx") % 10 != 0, F.col("count")))
    return density.occupancy_snapshots(partly)


@query
def violation_rows(s, d):
    return access.violation_rows(violations(s, d)).drop("embedding")


@query
def density_alert_rows(s, d):
    return density.density_alert_rows(alerts(s, d))


@query
def detections_matrix(s, d):
    row = lambda r: F.concat_ws(" ", *[r.getItem(i).cast("string") for i in range(6)])
    return tracking.detections_matrix(I.detections(s, d)).select(
        "stream_id", "frame_idx", _text(F.col("matrix"), row, ";").alias("matrix"))


@query
def tracks_from_matrix(s, d):
    row = F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2", "track_id", "conf", "cls", "det_ord")])
    out = I.tracks(s, d).groupBy("stream_id", "frame_idx").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("track_ord", row.alias("row")))), lambda r: r["row"]).alias("matrix"))
    return tracking.tracks_from_matrix(out).select(
        "stream_id", "frame_idx", "track_ord", "track_id", *BOX, "conf", "cls", "det_ind", "embeddable")


@query
def validate_cameras(s, d):
    return validate.validate_cameras(_config(s, d))


@query
def validate_zones(s, d):
    return validate.validate_zones(_config(s, d))


@query
def validate_tripwires(s, d):
    return validate.validate_tripwires(_config(s, d))


@query
def duplicate_ids(s, d):
    return validate.duplicate_ids(config.load_zones(_config(s, d)), ["stream_id", "zone_id"])


def _on_wires(s, d):
    side = G.signed_area(F.col("p1.x"), F.col("p1.y"), F.col("p2.x"), F.col("p2.y"), F.col("cx"), F.col("cy"))
    return points(s, d).join(I.tripwires(s), "stream_id").withColumn("side", side)


@query
def signed_area(s, d):
    return _on_wires(s, d).select("stream_id", "tripwire_id", "frame_idx", "track_id", "side")


def _sides(s, d):
    j = F.col("frame_idx")
    prev = F.expr("cast((frame_idx * 7) % 9 - 4 as double) / cast(2000 as double)")
    cur = F.expr("cast((frame_idx * 5) % 11 - 5 as double) / cast(2000 as double)")
    return I.frames(s, d).select("stream_id", j, prev.alias("prev_side"), cur.alias("cur_side"))


@query
def classify_direction(s, d):
    return _sides(s, d).select(
        "stream_id", "frame_idx", G.classify_direction(F.col("prev_side"), F.col("cur_side")).alias("raw_direction"))


@query
def map_in_out(s, d):
    raw = G.classify_direction(F.col("prev_side"), F.col("cur_side"))
    wanted = F.when(F.col("frame_idx") % 2 == 0, F.lit("left_to_right")).otherwise(F.lit("right_to_left"))
    return _sides(s, d).select("stream_id", "frame_idx", G.map_in_out(raw, wanted).alias("direction"))


@query
def point_on_segment(s, d):
    on = G.point_on_segment(F.col("cx"), F.col("cy"), F.col("cx") - 10, F.lit(100.0), F.col("cx") + 10, F.col("cy"))
    return points(s, d).select("stream_id", "frame_idx", "track_id", on.alias("on_segment"))


@query
def point_in_polygon(s, d):
    z = I.zones(s)
    return points(s, d).join(z, "stream_id").select(
        "stream_id", "frame_idx", "track_id", "zone_id",
        G.point_in_polygon(F.col("cx"), F.col("cy"), F.col("polygon")).alias("inside"))


@query
def segments_intersect(s, d):
    hit = G.segments_intersect(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.lit(50.0), F.lit(60.0), F.lit(590.0), F.lit(430.0))
    return I.tracks(s, d).select("stream_id", "frame_idx", "track_id", hit.alias("hit"))


@query
def polygon_self_intersects(s, d):
    z = config.load_zones(_config(s, d))
    return z.filter("size(polygon) >= 3").groupBy("stream_id", "zone_id", "zone_ord").agg(
        F.count_if(validate.polygon_self_intersects(F.col("polygon"))).alias("n_crossed"))


@query
def iou(s, d):
    t = I.tracks(s, d)
    shifted = [F.col(c) + F.expr("cast(frame_idx % 50 as double)") for c in BOX]
    return t.select("stream_id", "frame_idx", "track_id", G.iou(tuple(_box()), tuple(shifted)).alias("iou"))


@query
def centroid_distance(s, d):
    m = tripwire.prev_centroid(points(s, d), FRAMES).filter("prev is not null")
    return m.select("stream_id", "frame_idx", "track_id",
                    F.round(G.centroid_distance(F.col("prev.cx"), F.col("prev.cy"), F.col("cx"), F.col("cy")), 6).alias("dist"),
                    G.centroid_distance_sq(F.col("prev.cx"), F.col("prev.cy"), F.col("cx"), F.col("cy")).alias("dist_sq"))


@query
def l2_normalize(s, d):
    e = I.table(s, d, "embeddings")
    return e.select("vec_id", F.posexplode(G.l2_normalize(F.col("embedding"))).alias("pos", "v")).select(
        "vec_id", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("v"))


# ---- joins


@query
def zone_membership(s, d):
    return zones.zone_membership(points(s, d).select("stream_id", "frame_idx", "track_id", "cx", "cy"), I.zones(s))


@query
def raster_membership(s, d):
    return zones.raster_membership(
        points(s, d).select("stream_id", "frame_idx", "track_id", "cx", "cy"), zones.zone_raster(I.zones(s)))


@query
def crossing_candidates(s, d):
    return tripwire.crossing_candidates(tripwire.prev_centroid(points(s, d), FRAMES), I.tripwires(s)).select(*CROSSING_COLUMNS)


@query
def crossing_candidates_clipped(s, d):
    return tripwire.crossing_candidates(
        tripwire.prev_centroid(points(s, d), FRAMES), I.tripwires(s), clip_to_segment=True).select(*CROSSING_COLUMNS)


@query
def scan_window_lookup(s, d):
    probes = records(s, d).select("stream_id", "zone_id", "track_id", "ts")
    return scans.scan_window_lookup(probes, scans.dedup_scans(I.scans(s, d)), W)


@query
def nearest_scan(s, d):
    return access.nearest_scan(records(s, d), scans.dedup_scans(I.scans(s, d)), W, SECONDS).select(
        "stream_id", "zone_id", "track_id", "ts", "scan_ts", "scan_identity")


@query
def unmatched_crossings(s, d):
    return access.unmatched_crossings(records(s, d), I.scans(s, d), W).select("stream_id", "zone_id", "track_id", "ts")


@query
def occupancy_asof(s, d):
    placed = crossings(s, d).withColumn("zone_id", F.lit("z_rect"))
    # counted at times of its own, before, at or after a frame
    shifted = counts(s, d).withColumn("ts", F.col("ts") + F.expr("cast(frame_idx % 3 - 1 as double)") * F.lit(0.3))
    return access.occupancy_asof(placed, shifted, SECONDS).select(
        "stream_id", "tripwire_id", "track_id", "ts", "occupancy_at_crossing")


@query
def match_tracks_to_gt(s, d):
    return matches(s, d)


@query
def missed_ground_truth(s, d):
    return quality.missed_ground_truth(matches(s, d), I.truth(s, d)).select("scenario", "frame_idx", "gt_id")


def _log_alerts(s, d):
    return violation_log(s, d).select("id", "timestamp", "stream_id")


@query
def evidence_window(s, d):
    return evidence.evidence_window(_log_alerts(s, d), I.frames(s, d), 2.0, 1.0)


@query
def evidence_manifest(s, d):
    return evidence.evidence_manifest(_log_alerts(s, d), I.frames(s, d), BASE, 2.0, 1.0, fps=2.0, seconds_per_stretch=SECONDS)


@query
def clip_join(s, d):
    log = violation_log(s, d)
    half = log.select(
        F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") + UNKNOWN).alias("id"), "timestamp", "stream_id")
    manifest = evidence.evidence_manifest(half, I.frames(s, d), BASE, 2.0, 1.0, fps=2.0, seconds_per_stretch=SECONDS)
    return evidence.clip_join(log, manifest).select("id", "kind", "n_frames", "complete", "clip_path", "clip_url", "clip_backend")


@query
def id_switch_pairs(s, d):
    return tracking.id_switch_pairs(I.tracks(s, d), frames_per_stretch=FRAMES)


# ---- aggregations


@query
def zone_occupancy(s, d):
    return zones.zone_occupancy(I.frames(s, d), points(s, d), I.zones(s)).withColumn("track_ids", _text(F.col("track_ids")))


@query
def zone_occupancy_history(s, d):
    h = zones.zone_occupancy_history(counts(s, d))
    entries = F.sort_array(F.map_entries("zone_counts"))
    return h.select("stream_id", "frame_idx", "ts", _text(
        entries, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))).alias("zone_counts"))


@query
def stream_report(s, d):
    return report.stream_report(I.cameras(s), I.frames(s, d), displayed(s, d), crossings(s, d), alerts(s, d))


@query
def report_items(s, d):
    return report.report_items(displayed(s, d), crossings(s, d), alerts(s, d), metrics.stage_latency_avg(samples(s, d)))


@query
def list_streams(s, d):
    return report.list_streams(I.cameras(s), I.frames(s, d), displayed(s, d), crossings(s, d))


@query
def event_counters(s, d):
    return metrics.event_counters(I.pipeline_events(s, d))


@query
def latency_histogram(s, d):
    return metrics.latency_histogram(samples(s, d))


@query
def metrics_snapshot(s, d):
    return metrics.metrics_snapshot(I.pipeline_events(s, d), samples(s, d))


@query
def stage_latency_avg(s, d):
    return metrics.stage_latency_avg(samples(s, d))


@query
def scan_count_by_zone(s, d):
    return scans.scan_count_by_zone(scans.dedup_scans(I.scans(s, d)))


@query
def scan_count_near(s, d):
    return scans.scan_count_near(records(s, d), scans.dedup_scans(I.scans(s, d)), 1.0, SECONDS)


@query
def detection_quality(s, d):
    return quality.detection_quality(matches(s, d), I.truth(s, d))


@query
def overall_quality(s, d):
    m = matches(s, d)
    return quality.overall_quality(quality.detection_quality(m, I.truth(s, d)), quality.gt_id_switches(m, FRAMES))


@query
def id_switch_rate(s, d):
    return quality.id_switch_rate(
        quality.gt_id_switches(matches(s, d), FRAMES), I.frames(s, d).withColumnRenamed("stream_id", "scenario"))


def _by_person(s, d):
    who = I.tracks(s, d).select("stream_id", "frame_idx", "track_id", "gt_id")
    # as long as the recording, so it is no table to broadcast
    return decisions(s, d).join(who.hint("merge"), ["stream_id", "frame_idx", "track_id"]).withColumnRenamed("stream_id", "scenario")


def _true_decisions(s, d):
    ideal = points(s, d).withColumn("track_id", F.col("gt_id"))
    found = access.to_crossing_records(tripwire.crossings_of(ideal, I.tripwires(s), frames_per_stretch=FRAMES))
    return access.access_decisions(found, I.scans(s, d), W, seconds_per_stretch=SECONDS).withColumnRenamed("stream_id", "scenario").withColumn(
        "gt_id", F.col("track_id"))


@query
def crossing_quality(s, d):
    return quality.crossing_quality(_by_person(s, d), _true_decisions(s, d))


@query
def violation_quality(s, d):
    return quality.violation_quality(
        _by_person(s, d).filter("not authorized"), _true_decisions(s, d).filter("not authorized"))


@query
def crossing_totals(s, d):
    return tripwire.crossing_totals(crossings(s, d))


# ---- windows


@query
def prev_centroid(s, d):
    return tripwire.prev_centroid(points(s, d), FRAMES).select(
        "stream_id", "frame_idx", "track_id", F.col("prev.cx").alias("prev_cx"), F.col("prev.cy").alias("prev_cy"))


@query
def centroid_history(s, d):
    return tracking.centroid_history(I.tracks(s, d), frames_per_stretch=FRAMES).select(
        "stream_id", "frame_idx", "track_id",
        _text(F.col("history"), lambda h: F.concat_ws(":", h["x"], h["y"], h["ts"]), ";").alias("history"))


@query
def carry_embedding(s, d):
    return tracking.carry_embedding(I.tracks(s, d), "emb_key", FRAMES).select("stream_id", "frame_idx", "track_id", "emb_key")


@query
def track_lifetimes(s, d):
    return tracking.track_lifetimes(I.tracks(s, d))


@query
def tailgating(s, d):
    return access.tailgating(records(s, d), I.scans(s, d), W).select(
        "stream_id", "zone_id", "track_id", "ts", "scan_ts", "scan_identity")


@query
def consumption_ordinal(s, d):
    near = access.nearest_scan(records(s, d), scans.dedup_scans(I.scans(s, d)), W, SECONDS)
    return access.consumption_ordinal(near).select("stream_id", "zone_id", "track_id", "ts", "ordinal")


@query
def density_runs(s, d):
    return density.density_runs(ruled(s, d), SECONDS)


@query
def gt_id_switches(s, d):
    return quality.gt_id_switches(matches(s, d), FRAMES)


# ---- newest first, latest state


@query
def recent_violations(s, d):
    return alertlog.recent_violations(violation_log(s, d), "tw_cam1").select("id", "timestamp", "zone_id", "kind")


@query
def recent_density_alerts(s, d):
    return alertlog.recent_density_alerts(alert_log(s, d)).select("id", "timestamp", "zone_id", "density_count")


@query
def dashboard_alerts(s, d):
    return alertlog.dashboard_alerts(alert_log(s, d)).select("id", "timestamp", "zone_id", "density_count")


@query
def latest_track_state(s, d):
    return tracking.latest_track_state(I.tracks(s, d), "emb_key").select(
        "stream_id", "track_id", "frame_idx", "ts", *BOX, "conf", "emb_key")


@query
def latest_frame(s, d):
    return tracking.latest_frame(I.frames(s, d))


# ---- set operations


@query
def all_crossings(s, d):
    """Two crossing tables that were made apart: of each camera's first wire, and of all further ones."""
    return tripwire.all_crossings(*[
        tripwire.crossings_of(points(s, d), I.tripwires(s).filter(which), frames_per_stretch=FRAMES).select(*CROSSING_COLUMNS)
        for which in ("tw_ord = 0", "tw_ord <> 0")])


@query
def all_alerts(s, d):
    return alertlog.all_alerts(violation_log(s, d), alert_log(s, d)).select(
        "kind", "id", "timestamp", "stream_id", "zone_id", "density_count", "tripwire_id")


@query
def surviving_track_ids(s, d):
    renamed = F.expr("track_id + case when stream_id in ('cam0', 'cam2') and track_id = 4 and frame_idx > 25 then 100 else 0 end")
    return tracking.surviving_track_ids(I.tracks(s, d).withColumn("track_id", renamed), 19, 30)


# ---- state machines


@query
def id_switches(s, d):
    return camera_state.id_switches(I.tracks(s, d), **TRACKER)


@query
def iou_tracker(s, d):
    return camera_state.iou_tracker(I.frames(s, d), I.detections(s, d), **TRACKER)


@query
def tracker_fn(s, d):
    own = camera_state.stretched_tracker(camera_state.OverlapTracker, **TRACKER)
    return camera_state.run_tracker(I.frames(s, d), I.detections(s, d), "own", {"own": own})


@query
def tripwire_crossings(s, d):
    return crossings(s, d).select(*CROSSING_COLUMNS)


@query
def density_alerts(s, d):
    return alerts(s, d)


@query
def density_cooldown_alerts(s, d):
    return density.density_cooldown_alerts(counts(s, d), 2, 10.0, 2 * SECONDS)


@query
def access_violations(s, d):
    return violations(s, d).select(
        "timestamp", "stream_id", "zone_id", "tripwire_id", "track_id", "direction", "kind",
        F.col("matching_scan.identity").alias("identity"), "prior_crossings", "notes")


@query
def access_decisions(s, d):
    return decisions(s, d).select(
        "stream_id", "zone_id", "track_id", "ts", "kind", "authorized", "scan_ts", "scan_identity", "prior_crossings")


@query
def access_with_occupancy(s, d):
    placed = records(s, d)
    wire = F.concat(F.when(F.col("zone_id") == "z_rect", F.lit("tw_")).otherwise(F.lit("diag_")), F.col("stream_id"))
    per_wire = counts(s, d).select("stream_id", wire.alias("zone_id"), "ts", "count")
    return access.access_decisions(placed, I.scans(s, d), W, seconds_per_stretch=SECONDS, occupancy=per_wire).select(
        "stream_id", "zone_id", "track_id", "ts", "kind", "occupancy_at_crossing")


@query
def late_scan_reevaluation(s, d):
    # scans with a high identity number are the late ones
    late = I.scans(s, d).withColumn("arrival", F.col("arrival") + F.when(F.col("arrival") % 4 == 0, 10**9).otherwise(0))
    return access.late_scan_reevaluation(records(s, d), late, W, 10**9 - 1)


@query
def reset_density_zone(s, d):
    marks = F.expr("frame_idx % 97 = 50 and zone_id = 'z_rect'")
    return density.density_alerts(ruled(s, d).withColumn("reset", marks), SECONDS)


def _staged(s, d):
    ev = I.table(s, d, "events").withColumn("frame_idx", F.expr("event_id div 20")).withColumn(
        "stream_id", F.concat(F.lit("cam"), (F.col("event_id") % 4).cast("string")))
    bad = ev.groupBy("stream_id", "frame_idx").agg(*[
        F.max(F.when(F.col("event_type") == F.lit(kind), F.concat(F.lit(f"{stage} "), F.lpad(F.col("user_id").cast("string"), 8, "0")))).alias(f"{stage}_error")
        for stage, kind in (("detect", "purchase"), ("track", "signup"), ("zone", "error"), ("tripwire", "click"))])
    return bad.withColumn("ts", F.col("frame_idx").cast("double") * F.lit(0.5))


@query
def stage_failures(s, d):
    return metrics.stage_failures(metrics.stage_split(_staged(s, d))[1])


@query
def stage_survivors(s, d):
    return metrics.stage_split(_staged(s, d))[0]


# ---- texts


@query
def clip_path(s, d):
    return violation_log(s, d).select(
        "id", X.clip_path(BASE, F.col("stream_id"), F.col("timestamp"), F.col("id")).alias("path"))


@query
def clip_url(s, d):
    return violation_log(s, d).select("id", *[
        X.clip_url(BASE, F.col("stream_id"), F.col("timestamp"), F.col("id"), b).alias(f"{b}_url") for b in ("local", "noop")])


@query
def density_notes(s, d):
    return alerts(s, d).select("stream_id", "zone_id", "timestamp", "notes")


@query
def violation_notes(s, d):
    return violations(s, d).select("stream_id", "zone_id", "timestamp", "track_id",
                                   X.join_notes(F.col("notes"), F.lit("reviewed")).alias("notes"))
