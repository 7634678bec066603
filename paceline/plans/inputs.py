"""Camera-shaped views of the star-schema tables.

Four cameras of two frames per second, five people each, with people and whole
cameras that are far off for a while and swapped ids, all computed from
``events``; every event is a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline import schemas

ACCESS_WINDOW = 1.0
N_CAMERAS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _camera(event_id: str = "event_id") -> F.Column:
    return F.concat(F.lit("cam"), (F.col(event_id) % 4).cast("string"))


def _frame_no() -> F.Column:
    return F.expr("event_id div 20")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        _camera().alias("stream_id"),
        _frame_no().alias("frame_idx"),
        (_frame_no().cast("double") * F.lit(0.5)).alias("ts"),
    ).distinct()


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events").select(
        "event_id", "user_id", _frame_no().alias("frame_idx"),
        (F.expr("event_id div 4") % 5 + 1).alias("slot"), _camera().alias("stream_id"),
    )
    placed = seen.select(
        "*",
        (F.col("frame_idx").cast("double") * F.lit(0.5)).alias("ts"),
        # far off: the third person in every fifth stretch of ten frames, all of cam3 now and then
        F.expr("cast(20 + slot * 120 + user_id % 11 - 5 - 100 + case when slot = 3 and frame_idx % 50 between 20 and 29 "
               "or stream_id = 'cam3' and frame_idx % 100 between 60 and 64 then 10000 else 0 end as double)").alias("cx"),
        F.expr("cast(40 + abs((frame_idx * 7 * slot) % 800 - 400) + user_id % 7 - 3 as double)").alias("y2"),
        F.expr("cast((event_id * 7) % 95 + 5 as double) / cast(100 as double)").alias("conf"),
    )
    return placed.select(
        "stream_id", "frame_idx", "ts", F.col("slot").alias("det_ord"), F.col("slot").alias("gt_id"),
        F.expr("case when (frame_idx div 60) % 2 = 1 and slot in (2, 4) then 6 - slot else slot end").alias("track_id"),
        (F.col("cx") - 20.0).alias("x1"), (F.col("y2") - 80.0).alias("y1"),
        (F.col("cx") + 20.0).alias("x2"), "y2", "conf", F.lit(0).alias("cls"),
        F.expr("case when event_id % 7 = 0 then event_id end").alias("emb_key"),
    ).withColumn("track_ord", F.col("det_ord"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).select(
        "stream_id", "frame_idx", "ts", "det_ord", (F.col("det_ord") - 1).alias("det_id"),
        "x1", "y1", "x2", "y2", "conf", "cls",
    )


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(
        F.concat(F.lit("tw_cam"), (F.col("event_id") % 4).cast("string")).alias("zone_id"),
        (_frame_no().cast("double") * F.lit(0.5) + F.lit(0.25)).alias("ts"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("identity"),
        F.col("event_id").alias("arrival"),
    )


def scan_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Webhook bodies in several forms: number, ISO with Z, numeric text, no identity, and texts that are no times."""
    payload = F.expr(
        """concat('{"zone_id": "tw_cam', event_id % 4, '"',
             case when event_id % 5 = 3 then '' else concat(', "identity": "user', user_id, '"') end,
             ', "timestamp": ',
             case event_id % 5
               when 0 then concat(event_id div 20, '.5')
               when 1 then concat('"2024-01-', lpad(cast(event_id % 28 + 1 as string), 2, '0'), 'T',
                                  lpad(cast(event_id % 24 as string), 2, '0'), ':30:00Z"')
               when 2 then concat('"', event_id div 20, '.25"')
               when 3 then concat(event_id div 20, '.5')
               else concat('"', case event_id % 35 when 4 then 'not-a-number' when 9 then '1.5d' when 14 then '12f'
                 when 19 then '0x1F' when 24 then 'NaN' when 29 then '1_000' else ' 7.5e1 ' end, '"') end, '}')"""
    )
    return table(spark, sf_dir, "events").select(payload.alias("payload"), F.col("event_id").alias("arrival"))


def _literal(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return f"cast({v!r} as double)"
    if isinstance(v, str):
        return f"'{v}'"
    if isinstance(v, tuple):
        return f"named_struct('x', {_literal(v[0])}, 'y', {_literal(v[1])})"
    if isinstance(v, list):
        return f"array({', '.join(map(_literal, v))})"
    return str(v)


def _dimension(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small table as a local relation, whose exact size the planner knows when it picks the join."""
    names = [f.name for f in spark.createDataFrame([], ddl).schema]
    values = ", ".join(f"({', '.join(map(_literal, r))})" for r in rows)
    return spark.sql(f"select * from values {values} as t({', '.join(names)})")


def camera_rows() -> list[tuple]:
    return [
        (f"cam{n}", f"rtsp://cam{n}", "yolov8n.pt", "bytetrack", False, 5, 30, 0.25 + 0.125 * n,
         "bottom_center", 640, 480, 2, 1.0, 5.0)
        for n in range(N_CAMERAS)
    ]


def cameras(spark: SparkSession) -> DataFrame:
    return _dimension(spark, camera_rows(), schemas.CAMERAS)


def tripwire_rows() -> list[tuple]:
    rows = []
    for n in range(N_CAMERAS):
        rows.append((f"cam{n}", f"tw_cam{n}", 0, (50.0, 240.0), (590.0, 240.0), "left_to_right", 60, 200.0))
        rows.append((f"cam{n}", f"diag_cam{n}", 1, (50.0, 60.0), (590.0, 430.0), "right_to_left", 60, 200.0))
    return rows


def tripwires(spark: SparkSession) -> DataFrame:
    return _dimension(spark, tripwire_rows(), schemas.TRIPWIRES)


RECT = [(100.0, 100.0), (500.0, 100.0), (500.0, 400.0), (100.0, 400.0)]
ELL = [(50.0, 50.0), (350.0, 50.0), (350.0, 250.0), (200.0, 250.0), (200.0, 420.0), (50.0, 420.0)]


def zone_rows() -> list[tuple]:
    rows = []
    for n in range(N_CAMERAS):
        rows.append((f"cam{n}", "z_rect", 0, RECT))
        rows.append((f"cam{n}", "z_ell", 1, ELL))
    return rows


def zones(spark: SparkSession) -> DataFrame:
    return _dimension(spark, zone_rows(), schemas.ZONES)


def stage_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage latencies from ``lineitem``, in whole microseconds so that sums are exact."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("cam"), (F.col("l_orderkey") % 4).cast("string")).alias("stream_id"),
        F.expr("case l_linenumber % 5 when 0 then 'detect' when 1 then 'track' when 2 then 'zone' "
               "when 3 then 'tripwire' else 'other' end").alias("stage"),
        ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 400 * 1000).cast("long").alias("micros"),
    )


def pipeline_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event log: what happened, on which camera, at which stage, of which kind."""
    return table(spark, sf_dir, "events").select(
        (_frame_no().cast("double") * F.lit(0.5)).alias("ts"),
        _camera().alias("stream_id"),
        F.expr("case when event_type = 'error' then "
               "case user_id % 4 when 0 then 'detect' when 1 then 'track' when 2 then 'zone' else 'tripwire' end end"
               ).alias("stage"),
        F.expr("case event_type when 'view' then 'frame_processed' when 'click' then 'frame_dropped' "
               "when 'signup' then case event_id % 3 when 0 then 'reconnect' when 1 then 'build_failure' "
               "else 'id_switch' end when 'purchase' then 'violation' when 'error' then 'stage_failure' end"
               ).alias("event"),
        F.expr("case when event_type = 'purchase' then case user_id % 3 when 0 then 'unmatched' "
               "when 1 then 'tailgating' else 'high_density' end end").alias("kind"),
    )


# One configured camera per customer, with all kinds of mistakes; the text is the same in Spark and DuckDB.
CAMERA_DOC_SQL = """concat(
  '{"id": "s', CAST(c_custkey % 140 AS STRING), '", "source": "', CASE WHEN c_custkey % 17 = 0 THEN '' ELSE 'rtsp://x' END, '"',
  CASE WHEN c_custkey % 3 = 0 THEN ', "tracker_type": " BotSort "' WHEN c_custkey % 13 = 1 THEN ', "tracker_type": "deepsort"' ELSE '' END,
  CASE WHEN c_custkey % 5 = 0 THEN ', "use_appearance": true' ELSE '' END,
  CASE WHEN c_custkey % 4 = 0 THEN concat(', "buffer_seconds": ', CAST(c_custkey % 7 AS STRING)) ELSE '' END,
  CASE WHEN c_custkey % 6 = 0 THEN concat(', "fps_fallback": ', CAST(c_custkey % 11 - 1 AS STRING)) ELSE '' END,
  CASE WHEN c_custkey % 7 = 0 THEN concat(', "display_conf": ', CAST(c_custkey % 3 AS STRING), '.5') ELSE '' END,
  CASE WHEN c_custkey % 8 = 0 THEN ', "centroid_mode": "Geometric_Center"' WHEN c_custkey % 29 = 0 THEN ', "centroid_mode": "top"' ELSE '' END,
  CASE WHEN c_custkey % 19 = 0 THEN ', "frame_size": [0, 480]' WHEN c_custkey % 2 = 0 THEN ', "frame_size": [640, 480]' ELSE '' END,
  CASE WHEN c_custkey % 9 = 0 THEN concat(', "max_density_threshold": ', CAST(c_custkey % 5 - 1 AS STRING), ', "density_dwell_seconds": ', CAST(c_custkey % 4 - 1 AS STRING), '.0') ELSE '' END,
  CASE WHEN c_custkey % 23 = 0 THEN ', "density_cooldown_seconds": -1.0' ELSE '' END,
  ', "zones": [{"id": "z0", "polygon": ', CASE WHEN c_custkey % 4 = 0 THEN '[[0,0],[100,100],[100,0],[0,100]]' WHEN c_custkey % 10 = 1 THEN '[[0,0],[9,9]]'
    ELSE concat('[[0,0],[', CAST(50 + c_custkey % 60 AS STRING), ',0],[60,60],[0,', CAST(40 + c_custkey % 30 AS STRING), ']]') END,
  '}, {"id": "', CASE WHEN c_custkey % 6 = 0 THEN 'z0' WHEN c_custkey % 31 = 0 THEN '' ELSE 'z1' END, '", "polygon": [[0,0],[100,0],[100,100],[50,', CAST(c_custkey % 140 AS STRING), '],[0,100]]}]',
  ', "tripwires": [{"id": "', CASE WHEN c_custkey % 37 = 0 THEN '' ELSE 't0' END, '", "p1": [', CAST(c_custkey % 900 AS STRING), ',10], "p2": [', CAST(c_custkey % 70 AS STRING), ',10]',
  CASE WHEN c_custkey % 5 = 1 THEN ', "direction_in": "right_to_left"' WHEN c_custkey % 41 = 0 THEN ', "direction_in": "up"' ELSE '' END,
  CASE WHEN c_custkey % 12 = 0 THEN ', "recycle_after_frames": -5' WHEN c_custkey % 12 = 1 THEN ', "recycle_after_frames": 20' ELSE '' END,
  CASE WHEN c_custkey % 15 = 0 THEN ', "recycle_distance_px": -1.0' ELSE '' END, '}]}')"""


def camera_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.expr(CAMERA_DOC_SQL).alias("doc"))


def scored_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks to be scored: drifting off by up to 20 px, one box misplaced every ninth frame."""
    drift = F.expr(
        "cast((frame_idx % 6) * 4 + case when det_ord = 1 and frame_idx % 9 = 0 then 20000 else 0 end as double)")
    return tracks(spark, sf_dir).select(
        F.col("stream_id").alias("scenario"), "frame_idx", "track_ord", "track_id",
        *[(F.col(c) + drift).alias(c) for c in ("x1", "x2")], "y1", "y2",
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    away = F.expr("cast(case when det_ord = 5 and frame_idx % 7 = 0 then 40000 else 0 end as double)")
    return tracks(spark, sf_dir).select(
        F.col("stream_id").alias("scenario"), "frame_idx", "gt_id", F.col("det_ord").alias("gt_ord"),
        (F.col("x1") + away).alias("x1"), "y1", (F.col("x2") + away).alias("x2"), "y2", "conf",
    )
