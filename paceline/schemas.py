"""Table schemas, as Spark DDL, of everything the operators read and write."""

from __future__ import annotations

CAMERAS = (
    "stream_id string, source string, model_size string, tracker_type string, "
    "use_appearance boolean, buffer_seconds int, fps_fallback int, display_conf double, "
    "centroid_mode string, frame_w int, frame_h int, max_density_threshold int, "
    "density_dwell_seconds double, density_cooldown_seconds double"
)
POINT = "struct<x:double,y:double>"
ZONES = f"stream_id string, zone_id string, zone_ord int, polygon array<{POINT}>"
TRIPWIRES = (
    f"stream_id string, tripwire_id string, tw_ord int, p1 {POINT}, p2 {POINT}, "
    "direction_in string, recycle_after_frames int, recycle_distance_px double"
)
FRAMES = "stream_id string, frame_idx bigint, ts double"
DETECTIONS = (
    "stream_id string, frame_idx bigint, ts double, det_ord bigint, det_id bigint, "
    "x1 double, y1 double, x2 double, y2 double, conf double, cls int"
)
TRACKS = (
    "stream_id string, frame_idx bigint, ts double, track_ord bigint, track_id bigint, "
    "x1 double, y1 double, x2 double, y2 double, conf double, cls int, embedding array<float>"
)
SCANS = "zone_id string, ts double, identity string, arrival bigint"
SCAN_PAYLOADS = "payload string, arrival bigint"
VIOLATIONS = (
    "id bigint, timestamp double, stream_id string, zone_id string, tripwire_id string, "
    "track_id bigint, direction string, embedding binary, kind string, matching_identity string, "
    "matching_scan_ts double, notes string, clip_path string, clip_url string, created_at timestamp"
)
DENSITY_ALERTS = (
    "id bigint, timestamp double, stream_id string, zone_id string, density_count bigint, "
    "threshold int, dwell_seconds double, clip_path string, clip_url string, notes string, "
    "created_at timestamp"
)
PIPELINE_EVENTS = (
    "ts double, stream_id string, stage string, event string, kind string, seconds double"
)

# What a camera, zone or tripwire gets where its configuration is silent (fixed values).
CAMERA_DEFAULTS = {
    "model_size": "yolov8n.pt",
    "tracker_type": "bytetrack",
    "use_appearance": False,
    "buffer_seconds": 5,
    "fps_fallback": 30,
    "display_conf": 0.25,
    "centroid_mode": "bottom_center",
    "density_dwell_seconds": 2.0,
    "density_cooldown_seconds": 10.0,
}
TRIPWIRE_DEFAULTS = {
    "direction_in": "left_to_right",
    "recycle_after_frames": 60,
    "recycle_distance_px": 200.0,
}
