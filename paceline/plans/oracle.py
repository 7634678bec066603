"""The queries of the catalog once more, as SQL for DuckDB, written on their own.

Every statement is put together from named parts (``PARTS``) and a final body;
a part is only included where the body needs it. Constants are DOUBLE.
"""

from __future__ import annotations

import re

from paceline.plans.inputs import CAMERA_DOC_SQL

# The values below are written out here once more, so that an error in the operators' own tables shows.
LATENCY_BUCKETS = (0.001, 0.0025, 0.005, 0.010, 0.025, 0.050, 0.100, 0.250)
STAGES = ("detect", "track", "zone", "tripwire")
COUNTERS = {
    "frames_processed_total": "frame_processed", "frames_dropped_total": "frame_dropped",
    "stream_reconnects_total": "reconnect", "stream_build_failures_total": "build_failure",
    "id_switches_total": "id_switch", "violations_total": "violation", "stage_failures_total": "stage_failure",
}
CAMERAS = [(f"cam{n}", f"rtsp://cam{n}", limit) for n, limit in enumerate((0.25, 0.375, 0.5, 0.625))]
POLYGONS = {
    "z_rect": [(100.0, 100.0), (500.0, 100.0), (500.0, 400.0), (100.0, 400.0)],
    "z_ell": [(50.0, 50.0), (350.0, 50.0), (350.0, 250.0), (200.0, 250.0), (200.0, 420.0), (50.0, 420.0)],
}


def _values(rows: list[tuple]) -> str:
    def cell(v) -> str:
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return f"'{v}'" if isinstance(v, str) else str(v)

    return ", ".join(f"({', '.join(map(cell, r))})" for r in rows)


def _edge_rows() -> list[tuple]:
    out = []
    for stream, *_ in CAMERAS:
        for zone, polygon in POLYGONS.items():
            for i, (x1, y1) in enumerate(polygon):
                x2, y2 = polygon[(i + 1) % len(polygon)]
                out.append((stream, zone, i, x1, y1, x2, y2))
    return out


def _wire_rows() -> list[tuple]:
    return [
        row for stream, *_ in CAMERAS for row in (
            (stream, f"tw_{stream}", 50.0, 240.0, 590.0, 240.0, "left_to_right", 60, 200.0, 0),
            (stream, f"diag_{stream}", 50.0, 60.0, 590.0, 430.0, "right_to_left", 60, 200.0, 1))]


def _crossing_parts(prefix: str, person: str) -> dict[str, str]:
    """From points to counted crossings, where ``person`` is the column that tells people apart."""
    return {
        f"{prefix}moves": f"""SELECT stream_id, {person} AS track_id, gt_id, frame_idx, track_ord, ts, cx, cy,
            lag(cx) OVER w AS px, lag(cy) OVER w AS py FROM pts
            WINDOW w AS (PARTITION BY stream_id, {person} ORDER BY frame_idx, track_ord)""",
        f"{prefix}sided": f"""SELECT m.*, t.tripwire_id, t.direction_in, t.rf, t.rd, t.x1, t.y1, t.x2, t.y2,
            (t.x2 - t.x1) * (m.py - t.y1) - (t.y2 - t.y1) * (m.px - t.x1) AS sp,
            (t.x2 - t.x1) * (m.cy - t.y1) - (t.y2 - t.y1) * (m.cx - t.x1) AS sc
            FROM {prefix}moves m JOIN wires t USING (stream_id) WHERE m.px IS NOT NULL""",
        f"{prefix}cands": f"""SELECT *, CASE WHEN raw = direction_in THEN 'in' ELSE 'out' END AS direction FROM (
            SELECT *, CASE WHEN sp <= 1e-3 AND sc > 1e-3 THEN 'left_to_right'
                           WHEN sp > 1e-3 AND sc <= -1e-3 THEN 'right_to_left' END AS raw FROM {prefix}sided)
            WHERE raw IS NOT NULL""",
        f"{prefix}nth": f"""SELECT *, row_number() OVER (PARTITION BY stream_id, tripwire_id, track_id
            ORDER BY frame_idx, track_ord) AS rn FROM {prefix}cands""",
        f"{prefix}walk": f"""SELECT stream_id, tripwire_id, track_id, rn, frame_idx AS lf, cx AS lx, cy AS ly, true AS counted
            FROM {prefix}nth WHERE rn = 1
            UNION ALL
            SELECT stream_id, tripwire_id, track_id, rn, CASE WHEN ok THEN frame_idx ELSE lf END,
              CASE WHEN ok THEN cx ELSE lx END, CASE WHEN ok THEN cy ELSE ly END, ok
            FROM (SELECT n.stream_id, n.tripwire_id, n.track_id, n.rn, n.frame_idx, n.cx, n.cy, w.lf, w.lx, w.ly,
                    (n.frame_idx - w.lf >= n.rf
                     OR sqrt((w.lx - n.cx) * (w.lx - n.cx) + (w.ly - n.cy) * (w.ly - n.cy)) >= n.rd) AS ok
                  FROM {prefix}walk w JOIN {prefix}nth n ON n.stream_id = w.stream_id AND n.tripwire_id = w.tripwire_id
                    AND n.track_id = w.track_id AND n.rn = w.rn + 1)""",
        f"{prefix}crossings": f"""SELECT n.stream_id, n.tripwire_id, n.track_id, n.gt_id, n.frame_idx, n.track_ord, n.ts,
            n.direction, n.cx, n.cy FROM {prefix}nth n JOIN {prefix}walk w
            USING (stream_id, tripwire_id, track_id, rn) WHERE w.counted""",
        f"{prefix}records": f"SELECT *, tripwire_id AS zone_id FROM {prefix}crossings",
        **_decision_parts(prefix, f"{prefix}records", "scans"),
    }


def _decision_parts(prefix: str, records: str, scans: str) -> dict[str, str]:
    return {
        f"{prefix}ranked": f"""SELECT r.*, s.ts AS scan_ts, s.identity AS scan_identity, row_number() OVER (
              PARTITION BY r.stream_id, r.tripwire_id, r.track_id, r.frame_idx ORDER BY abs(s.ts - r.ts), s.ts) AS pick
            FROM {records} r LEFT JOIN {scans} s ON s.zone_id = r.zone_id
              AND s.ts >= r.ts - 1e0 AND s.ts <= r.ts + 1e0""",
        f"{prefix}nearest": f"SELECT * EXCLUDE (pick) FROM {prefix}ranked WHERE pick = 1",
        f"{prefix}used": f"""SELECT *, lag(ts) OVER w AS prev_ts, row_number() OVER w AS nth FROM {prefix}nearest
            WHERE scan_ts IS NOT NULL WINDOW w AS (PARTITION BY zone_id, scan_ts, scan_identity
              ORDER BY ts, stream_id, frame_idx, track_ord, track_id, tripwire_id)""",
        f"{prefix}decided": f"""SELECT *, CASE WHEN prev_ts IS NOT NULL AND ts - prev_ts <= 1e0 THEN 'tailgating'
              ELSE 'authorized' END AS kind FROM {prefix}used
            UNION ALL SELECT *, NULL, NULL, 'unmatched' FROM {prefix}nearest WHERE scan_ts IS NULL""",
    }


def _alert_parts(prefix: str, counts: str, reset: str = "false") -> dict[str, str]:
    """Crowd alerts with threshold 2, dwell 1, cooldown 5; ``reset`` marks rows that clear the zone."""
    return {
        f"{prefix}marked": f"SELECT *, ({reset}) AS reset, (count > 2 AND NOT ({reset})) AS above FROM {counts}",
        f"{prefix}starts": f"""SELECT *, max(CASE WHEN reset THEN ts END) OVER w AS epoch,
            CASE WHEN above AND NOT coalesce(lag(above) OVER (PARTITION BY stream_id, zone_id ORDER BY ts), false)
              THEN 1 ELSE 0 END AS fresh FROM {prefix}marked WINDOW w AS (PARTITION BY stream_id, zone_id ORDER BY ts)""",
        f"{prefix}islands": f"""SELECT *, sum(fresh) OVER (PARTITION BY stream_id, zone_id ORDER BY ts) AS run
            FROM {prefix}starts""",
        f"{prefix}runs": f"""SELECT stream_id, zone_id, ts, count, run, coalesce(epoch, -1e0) AS epoch,
              min(ts) OVER (PARTITION BY stream_id, zone_id, run) AS run_start,
              max(count) OVER (PARTITION BY stream_id, zone_id, run ORDER BY ts) AS peak
            FROM {prefix}islands WHERE above""",
        f"{prefix}ready": f"""SELECT *, row_number() OVER (PARTITION BY stream_id, zone_id ORDER BY ts) AS rn
            FROM {prefix}runs WHERE ts - run_start >= 1e0""",
        f"{prefix}fire": f"""SELECT stream_id, zone_id, rn, ts AS lts, run AS lrun, epoch AS lepoch, true AS fired
            FROM {prefix}ready WHERE rn = 1
            UNION ALL
            SELECT stream_id, zone_id, rn, CASE WHEN ok THEN ts ELSE lts END, CASE WHEN ok THEN run ELSE lrun END,
              CASE WHEN ok THEN epoch ELSE lepoch END, ok
            FROM (SELECT c.stream_id, c.zone_id, c.rn, c.ts, c.run, c.epoch, f.lts, f.lrun, f.lepoch,
                    (c.epoch <> f.lepoch OR (c.run <> f.lrun AND c.ts - f.lts >= 5e0)) AS ok
                  FROM {prefix}fire f JOIN {prefix}ready c
                    ON c.stream_id = f.stream_id AND c.zone_id = f.zone_id AND c.rn = f.rn + 1)""",
        f"{prefix}alerts": f"""SELECT r.ts AS timestamp, r.stream_id, r.zone_id, r.peak AS density_count, 2 AS threshold,
              r.ts - r.run_start AS dwell_seconds,
              printf('count peaked at %d (threshold 2) for %.2fs', r.peak, r.ts - r.run_start) AS notes
            FROM {prefix}ready r JOIN {prefix}fire f USING (stream_id, zone_id, rn) WHERE f.fired""",
    }


_HIT = """((e.y2 > p.cy) <> (e.y1 > p.cy)
    AND (e.x1 - e.x2) * (p.cy - e.y2) / nullif(e.y1 - e.y2, 0e0) + e.x2 > p.cx)"""
_TOUCH = """(abs((e.x2 - e.x1) * (p.cy - e.y1) - (e.y2 - e.y1) * (p.cx - e.x1)) <= 1e-7
    AND p.cx BETWEEN least(e.x1, e.x2) - 1e-7 AND greatest(e.x1, e.x2) + 1e-7
    AND p.cy BETWEEN least(e.y1, e.y2) - 1e-7 AND greatest(e.y1, e.y2) + 1e-7)"""


def _cross(o: str, p: str, q: str) -> str:
    return f"(({p}x - {o}x) * ({q}y - {o}y) - ({p}y - {o}y) * ({q}x - {o}x))"


def _proper(a: str, b: str, c: str, d: str) -> str:
    def opposite(u: str, v: str) -> str:
        return f"(({u} > 0 AND {v} < 0) OR ({u} < 0 AND {v} > 0))"

    return (f"({opposite(_cross(c, d, a), _cross(c, d, b))} AND {opposite(_cross(a, b, c), _cross(a, b, d))})")


PARTS: dict[str, str] = {
    "cams": "SELECT * FROM (VALUES " + _values(CAMERAS)
            + ") AS t(stream_id, source, display_conf)",
    "wires": "SELECT * FROM (VALUES " + _values(_wire_rows())
             + ") AS t(stream_id, tripwire_id, x1, y1, x2, y2, direction_in, rf, rd, tw_ord)",
    "edges": "SELECT * FROM (VALUES " + _values(_edge_rows()) + ") AS t(stream_id, zone_id, e, x1, y1, x2, y2)",
    "frames": """SELECT DISTINCT concat('cam', CAST(event_id % 4 AS STRING)) AS stream_id, event_id // 20 AS frame_idx,
        CAST(event_id // 20 AS DOUBLE) * 5e-1 AS ts FROM events""",
    "seen": """SELECT event_id, user_id, event_id // 20 AS frame_idx, (event_id // 4) % 5 + 1 AS slot,
        concat('cam', CAST(event_id % 4 AS STRING)) AS stream_id FROM events""",
    "placed": """SELECT *, CAST(frame_idx AS DOUBLE) * 5e-1 AS ts,
        CAST(20 + slot * 120 + user_id % 11 - 5 - 100 + CASE WHEN slot = 3 AND frame_idx % 50 BETWEEN 20 AND 29
          OR stream_id = 'cam3' AND frame_idx % 100 BETWEEN 60 AND 64 THEN 10000 ELSE 0 END AS DOUBLE) AS cx0,
        CAST(40 + abs((frame_idx * 7 * slot) % 800 - 400) + user_id % 7 - 3 AS DOUBLE) AS y2,
        CAST((event_id * 7) % 95 + 5 AS DOUBLE) / 1e2 AS conf FROM seen""",
    "tracks": """SELECT stream_id, frame_idx, ts, slot AS det_ord, slot AS track_ord, slot AS gt_id,
        CASE WHEN (frame_idx // 60) % 2 = 1 AND slot IN (2, 4) THEN 6 - slot ELSE slot END AS track_id,
        cx0 - 2e1 AS x1, y2 - 8e1 AS y1, cx0 + 2e1 AS x2, y2, conf, 0 AS cls,
        CASE WHEN event_id % 7 = 0 THEN event_id END AS emb_key FROM placed""",
    "pts": "SELECT *, (x1 + x2) / 2e0 AS cx, y2 AS cy FROM tracks",
    "raw_scans": """SELECT concat('tw_cam', CAST(event_id % 4 AS STRING)) AS zone_id,
        CAST(event_id // 20 AS DOUBLE) * 5e-1 + 25e-2 AS ts, concat('user', CAST(user_id AS STRING)) AS identity,
        event_id AS arrival FROM events WHERE event_type = 'purchase'""",
    "scans": """SELECT zone_id, ts, arg_max(identity, arrival) AS identity, max(arrival) AS arrival
        FROM raw_scans GROUP BY zone_id, ts""",
    "payloads": """SELECT event_id AS arrival, concat('{"zone_id": "tw_cam', CAST(event_id % 4 AS STRING), '"',
          CASE WHEN event_id % 5 = 3 THEN '' ELSE concat(', "identity": "user', CAST(user_id AS STRING), '"') END,
          ', "timestamp": ', CASE event_id % 5
            WHEN 0 THEN concat(CAST(event_id // 20 AS STRING), '.5')
            WHEN 1 THEN concat('"2024-01-', lpad(CAST(event_id % 28 + 1 AS STRING), 2, '0'), 'T',
                               lpad(CAST(event_id % 24 AS STRING), 2, '0'), ':30:00Z"')
            WHEN 2 THEN concat('"', CAST(event_id // 20 AS STRING), '.25"')
            WHEN 3 THEN concat(CAST(event_id // 20 AS STRING), '.5')
            ELSE concat('"', CASE event_id % 35 WHEN 4 THEN 'not-a-number' WHEN 9 THEN '1.5d' WHEN 14 THEN '12f'
              WHEN 19 THEN '0x1F' WHEN 24 THEN 'NaN' WHEN 29 THEN '1_000' ELSE ' 7.5e1 ' END, '"') END, '}') AS payload FROM events""",
    "bodies": """SELECT arrival, json_extract_string(payload, '$.zone_id') AS zone_id,
        json_extract_string(payload, '$.identity') AS identity,
        coalesce(epoch(try_cast(CASE WHEN json_extract_string(payload, '$.timestamp') LIKE '____-__-__T%'
                   THEN json_extract_string(payload, '$.timestamp') END AS TIMESTAMPTZ)),
                 CASE WHEN regexp_full_match(trim(json_extract_string(payload, '$.timestamp')), '[0-9.]+(e[0-9]+)?')
                   THEN try_cast(trim(json_extract_string(payload, '$.timestamp')) AS DOUBLE) END) AS ts,
        payload FROM payloads""",
    "taken": """SELECT payload, arrival, zone_id, ts, identity, CASE WHEN ts IS NULL THEN 'bad timestamp'
        WHEN identity IS NULL THEN 'missing identity' END AS reason FROM bodies""",
    "docs": f"SELECT {CAMERA_DOC_SQL} AS doc FROM customer",
    "cfg": """SELECT doc, json_extract_string(doc, '$.id') AS stream_id, json_extract_string(doc, '$.source') AS source,
        lower(trim(coalesce(json_extract_string(doc, '$.tracker_type'), 'bytetrack'))) AS tracker_type,
        coalesce(CAST(json_extract(doc, '$.use_appearance') AS BOOLEAN), false) AS use_appearance,
        coalesce(CAST(json_extract(doc, '$.buffer_seconds') AS INTEGER), 5) AS buffer_seconds,
        coalesce(CAST(json_extract(doc, '$.fps_fallback') AS INTEGER), 30) AS fps_fallback,
        coalesce(CAST(json_extract(doc, '$.display_conf') AS DOUBLE), 25e-2) AS display_conf,
        lower(coalesce(json_extract_string(doc, '$.centroid_mode'), 'bottom_center')) AS centroid_mode,
        CAST(json_extract(doc, '$.frame_size[0]') AS INTEGER) AS frame_w,
        CAST(json_extract(doc, '$.frame_size[1]') AS INTEGER) AS frame_h,
        CAST(json_extract(doc, '$.max_density_threshold') AS INTEGER) AS max_density_threshold,
        coalesce(CAST(json_extract(doc, '$.density_dwell_seconds') AS DOUBLE), 2e0) AS density_dwell_seconds,
        coalesce(CAST(json_extract(doc, '$.density_cooldown_seconds') AS DOUBLE), 1e1) AS density_cooldown_seconds
        FROM docs""",
    "cfg_zones": """SELECT stream_id, o AS zone_ord, json_extract_string(doc, concat('$.zones[', CAST(o AS STRING), '].id')) AS zone_id,
        json_extract(doc, concat('$.zones[', CAST(o AS STRING), '].polygon')) AS poly FROM cfg, range(0, 2) r(o)""",
    "cfg_points": """SELECT z.stream_id, z.zone_ord, z.zone_id, row_number() OVER () AS one, z.poly,
        CAST(json_array_length(z.poly) AS INTEGER) AS n FROM cfg_zones z""",
    "cfg_edges": """SELECT p.one, p.stream_id, p.zone_id, p.zone_ord, p.n, i AS i,
        CAST(json_extract(poly, concat('$[', CAST(i AS STRING), '][0]')) AS DOUBLE) AS a_x,
        CAST(json_extract(poly, concat('$[', CAST(i AS STRING), '][1]')) AS DOUBLE) AS a_y,
        CAST(json_extract(poly, concat('$[', CAST((i + 1) % n AS STRING), '][0]')) AS DOUBLE) AS b_x,
        CAST(json_extract(poly, concat('$[', CAST((i + 1) % n AS STRING), '][1]')) AS DOUBLE) AS b_y
        FROM cfg_points p, range(0, 8) r(i) WHERE i < n""",
    "cfg_crossed": f"""SELECT DISTINCT e.one FROM
        (SELECT one, n, i, a_x, a_y, b_x, b_y FROM cfg_edges) e
        JOIN (SELECT one, i AS j, a_x AS c_x, a_y AS c_y, b_x AS d_x, b_y AS d_y FROM cfg_edges) f ON e.one = f.one
        WHERE n >= 4 AND j >= i + 2 AND NOT (i = 0 AND j = n - 1) AND {_proper('a_', 'b_', 'c_', 'd_')}""",
    "cfg_wires": """SELECT stream_id, frame_w, frame_h, 0 AS tw_ord, json_extract_string(doc, '$.tripwires[0].id') AS tripwire_id,
        CAST(json_extract(doc, '$.tripwires[0].p1[0]') AS DOUBLE) AS p1x, CAST(json_extract(doc, '$.tripwires[0].p1[1]') AS DOUBLE) AS p1y,
        CAST(json_extract(doc, '$.tripwires[0].p2[0]') AS DOUBLE) AS p2x, CAST(json_extract(doc, '$.tripwires[0].p2[1]') AS DOUBLE) AS p2y,
        coalesce(json_extract_string(doc, '$.tripwires[0].direction_in'), 'left_to_right') AS direction_in,
        coalesce(CAST(json_extract(doc, '$.tripwires[0].recycle_after_frames') AS INTEGER), 60) AS recycle_after_frames,
        coalesce(CAST(json_extract(doc, '$.tripwires[0].recycle_distance_px') AS DOUBLE), 2e2) AS recycle_distance_px FROM cfg""",
    "inside": f"""SELECT p.stream_id, p.frame_idx, p.track_ord, p.track_id, p.cx, p.cy, e.zone_id,
        (sum(CASE WHEN {_HIT} THEN 1 ELSE 0 END) % 2 = 1 OR bool_or({_TOUCH})) AS inside
        FROM pts p JOIN edges e USING (stream_id) GROUP BY ALL""",
    "member": "SELECT * FROM inside WHERE inside",
    "zone_ids": "SELECT DISTINCT stream_id, zone_id FROM edges",
    "occ": """SELECT f.stream_id, f.frame_idx, f.ts, z.zone_id, count(m.track_id) AS count,
        coalesce(string_agg(CAST(m.track_id AS STRING), ',' ORDER BY m.track_ord), '') AS track_ids
        FROM frames f JOIN zone_ids z USING (stream_id)
        LEFT JOIN member m ON m.stream_id = f.stream_id AND m.frame_idx = f.frame_idx AND m.zone_id = z.zone_id
        GROUP BY f.stream_id, f.frame_idx, f.ts, z.zone_id""",
    **_crossing_parts("", "track_id"),
    **_crossing_parts("gt_", "gt_id"),
    "vlog": """SELECT row_number() OVER (ORDER BY ts, stream_id, tripwire_id, track_id, zone_id) AS id, ts AS timestamp,
        stream_id, zone_id, tripwire_id, track_id, direction, kind, scan_identity AS matching_identity,
        scan_ts AS matching_scan_ts, nth, CASE WHEN kind = 'unmatched' THEN 'no scan in window'
          ELSE concat('scan already authorized for ', CAST(nth AS STRING), ' prior crossing(s)') END AS notes
        FROM decided WHERE kind <> 'authorized'""",
    **_alert_parts("", "occ"),
    **_alert_parts("reset_", "occ", "frame_idx % 97 = 50 AND zone_id = 'z_rect'"),
    "alog": "SELECT row_number() OVER (ORDER BY timestamp, stream_id, zone_id) AS id, * FROM alerts",
    # the tracker, one box at a time: live tracks with the frame in which each was last seen
    "numbered_frames": "SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY frame_idx) AS fn FROM frames",
    "box_steps": """SELECT f.stream_id, f.fn, f.frame_idx, f.ts, t.det_ord, t.det_ord - 1 AS det_id, t.x1, t.y1, t.x2, t.y2, t.conf, t.cls,
        row_number() OVER (PARTITION BY f.stream_id ORDER BY f.frame_idx, t.det_ord) AS rn
        FROM numbered_frames f LEFT JOIN tracks t USING (stream_id, frame_idx)""",
    "box_walk": """SELECT DISTINCT stream_id, CAST(0 AS BIGINT) AS rn,
          CAST([] AS STRUCT(id BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, fn BIGINT)[]) AS live,
          CAST(0 AS BIGINT) AS made, CAST(NULL AS BIGINT) AS got FROM frames
        UNION ALL
        SELECT stream_id, rn, CASE WHEN x1 IS NULL THEN live
            WHEN pick IS NULL THEN list_append(live, {'id': made + 1, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'fn': fn})
            ELSE list_transform(live, lambda t: CASE WHEN t.id = pick
              THEN {'id': pick, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'fn': fn} ELSE t END) END,
          CASE WHEN x1 IS NOT NULL AND pick IS NULL THEN made + 1 ELSE made END,
          CASE WHEN x1 IS NOT NULL THEN coalesce(pick, made + 1) END
        FROM (SELECT q.*, list_sort(list_filter(list_transform(list_filter(q.live, lambda t: t.fn < q.fn), lambda t: {
              'o': -(greatest(0e0, least(t.x2, q.x2) - greatest(t.x1, q.x1)) * greatest(0e0, least(t.y2, q.y2) - greatest(t.y1, q.y1)))
                / ((t.x2 - t.x1) * (t.y2 - t.y1) + (q.x2 - q.x1) * (q.y2 - q.y1)
                   - greatest(0e0, least(t.x2, q.x2) - greatest(t.x1, q.x1)) * greatest(0e0, least(t.y2, q.y2) - greatest(t.y1, q.y1)) + 1e-6),
              'id': t.id}), lambda c: c.o < -2e-1))[1].id AS pick
          FROM (SELECT s.*, w.made, list_filter(w.live, lambda t: s.fn - t.fn <= 30) AS live
            FROM box_walk w JOIN box_steps s ON s.stream_id = w.stream_id AND s.rn = w.rn + 1) q)""",
    # the id-switch detector, one person at a time: all of a frame look for a switch, then all are entered
    "switch_steps": """SELECT stream_id, frame_idx, ts, track_ord, track_id, phase, (x1 + x2) / 2e0 AS x, (y1 + y2) / 2e0 AS y,
        row_number() OVER (PARTITION BY stream_id ORDER BY frame_idx, phase, track_ord) AS rn,
        phase = 1 AND track_ord = max(track_ord) OVER (PARTITION BY stream_id, frame_idx) AS closing
        FROM tracks, (VALUES (0), (1)) p(phase)""",
    "switch_walk": """SELECT DISTINCT stream_id, CAST(0 AS BIGINT) AS rn,
          CAST([] AS STRUCT(id BIGINT, x DOUBLE, y DOUBLE, since DOUBLE)[]) AS slots,
          CAST(NULL AS STRUCT(id BIGINT, x DOUBLE, y DOUBLE, since DOUBLE)) AS pick FROM tracks
        UNION ALL
        SELECT stream_id, rn, CASE WHEN closing THEN list_filter(later, lambda t: ts - t.since <= 5e0) ELSE later END, pick
        FROM (SELECT *, CASE WHEN phase = 0 THEN list_filter(slots, lambda t: pick IS NULL OR t.id <> pick.id)
              WHEN len(list_filter(slots, lambda t: t.id = track_id)) > 0
                THEN list_transform(slots, lambda t: CASE WHEN t.id = track_id THEN {'id': track_id, 'x': x, 'y': y, 'since': ts} ELSE t END)
              ELSE list_append(slots, {'id': track_id, 'x': x, 'y': y, 'since': ts}) END AS later
          FROM (SELECT s.*, w.slots, CASE WHEN s.phase = 0 THEN list_filter(w.slots, lambda t: t.id <> s.track_id AND s.ts - t.since <= 2e0
                AND (s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) <= 16e2)[1] END AS pick
            FROM switch_walk w JOIN switch_steps s ON s.stream_id = w.stream_id AND s.rn = w.rn + 1))""",
    "crowded": "SELECT *, row_number() OVER (PARTITION BY stream_id, zone_id ORDER BY ts) AS rn FROM occ WHERE count > 2",
    "cooled": """SELECT stream_id, zone_id, CAST(0 AS BIGINT) AS rn, 0e0 AS lts, false AS fired FROM zone_ids
        UNION ALL SELECT c.stream_id, c.zone_id, c.rn, CASE WHEN c.ts - w.lts >= 1e1 THEN c.ts ELSE w.lts END,
          c.ts - w.lts >= 1e1 FROM cooled w JOIN crowded c
          ON c.stream_id = w.stream_id AND c.zone_id = w.zone_id AND c.rn = w.rn + 1""",
    "shown": "SELECT t.* FROM tracks t JOIN cams c USING (stream_id) WHERE t.conf >= c.display_conf",
    "clip": """SELECT id, stream_id, timestamp, concat('/evidence/', stream_id, '/',
        strftime(to_timestamp(timestamp) AT TIME ZONE 'UTC', '%Y-%m-%d'), '/', CAST(id AS STRING), '.mp4') AS path FROM vlog""",
    "win": """SELECT a.id, a.stream_id, a.timestamp AS alert_ts, f.frame_idx, f.ts FROM vlog a JOIN frames f
        ON f.stream_id = a.stream_id AND f.ts BETWEEN a.timestamp - 2e0 AND a.timestamp + 1e0""",
    "manifest": """SELECT id AS violation_id, stream_id, count(*) AS n_frames, min(ts) AS first_ts, max(ts) AS last_ts,
        CAST(6 AS BIGINT) AS expected_frames, count(*) >= 6 AS complete, path AS clip_path, concat('file://', path) AS clip_url,
        'local' AS clip_backend, CASE WHEN count(*) FILTER (WHERE ts > alert_ts) = 0
          THEN 'no post-event frames captured within 1.0s window' ELSE '' END AS notes
        FROM win JOIN (SELECT id, path FROM clip) USING (id) GROUP BY id, stream_id, path""",
    "samples": """SELECT concat('cam', CAST(l_orderkey % 4 AS STRING)) AS stream_id,
        CASE l_linenumber % 5 WHEN 0 THEN 'detect' WHEN 1 THEN 'track' WHEN 2 THEN 'zone' WHEN 3 THEN 'tripwire' ELSE 'other' END AS stage,
        (l_orderkey * 7 + l_linenumber * 13) % 400 * 1000 AS micros FROM lineitem""",
    "log_events": """SELECT concat('cam', CAST(event_id % 4 AS STRING)) AS stream_id,
        CASE WHEN event_type = 'error' THEN CASE user_id % 4 WHEN 0 THEN 'detect' WHEN 1 THEN 'track' WHEN 2 THEN 'zone' ELSE 'tripwire' END END AS stage,
        CASE event_type WHEN 'view' THEN 'frame_processed' WHEN 'click' THEN 'frame_dropped'
          WHEN 'signup' THEN CASE event_id % 3 WHEN 0 THEN 'reconnect' WHEN 1 THEN 'build_failure' ELSE 'id_switch' END
          WHEN 'purchase' THEN 'violation' WHEN 'error' THEN 'stage_failure' END AS event,
        CASE WHEN event_type = 'purchase' THEN CASE user_id % 3 WHEN 0 THEN 'unmatched' WHEN 1 THEN 'tailgating' ELSE 'high_density' END END AS kind
        FROM events""",
    "counted_events": "SELECT *, CASE event " + " ".join(f"WHEN '{e}' THEN '{c}'" for c, e in COUNTERS.items())
                      + """ END AS counter, CASE WHEN event = 'violation' THEN kind
        WHEN event = 'stage_failure' THEN concat(stream_id, '/', stage) ELSE stream_id END AS label FROM log_events""",
    "scored": """SELECT stream_id AS scenario, frame_idx, track_ord, track_id, x1 + drift AS x1, y1, x2 + drift AS x2, y2 FROM (
        SELECT *, CAST((frame_idx % 6) * 4 + CASE WHEN det_ord = 1 AND frame_idx % 9 = 0 THEN 20000 ELSE 0 END AS DOUBLE) AS drift
        FROM tracks)""",
    "truth": """SELECT stream_id AS scenario, frame_idx, gt_id, det_ord AS gt_ord, x1 + away AS x1, y1, x2 + away AS x2, y2 FROM (
        SELECT *, CAST(CASE WHEN det_ord = 5 AND frame_idx % 7 = 0 THEN 40000 ELSE 0 END AS DOUBLE) AS away FROM tracks)""",
    "lapped": """SELECT a.scenario, a.frame_idx, a.track_ord, a.track_id, b.gt_id, b.gt_ord,
        greatest(0e0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0e0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter,
        (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS areas
        FROM scored a LEFT JOIN truth b USING (scenario, frame_idx)""",
    "best": """SELECT scenario, frame_idx, track_ord, track_id, gt_id, inter / (areas - inter + 1e-6) AS iou,
        row_number() OVER (PARTITION BY scenario, frame_idx, track_ord, track_id
          ORDER BY inter / (areas - inter + 1e-6) DESC NULLS LAST, gt_ord) AS pick FROM lapped""",
    "matched": """SELECT scenario, frame_idx, track_ord, track_id, CASE WHEN iou > 4e-1 THEN gt_id END AS gt_id,
        CASE WHEN iou > 4e-1 THEN iou END AS iou FROM best WHERE pick = 1""",
    "missed": """SELECT t.scenario, t.frame_idx, t.gt_id FROM truth t WHERE NOT EXISTS (SELECT 1 FROM matched m
        WHERE m.scenario = t.scenario AND m.frame_idx = t.frame_idx AND m.gt_id = t.gt_id)""",
    "tallies": """SELECT scenario, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM (
          SELECT scenario, CASE WHEN gt_id IS NOT NULL THEN 1 ELSE 0 END AS tp, CASE WHEN gt_id IS NULL THEN 1 ELSE 0 END AS fp, 0 AS fn FROM matched
          UNION ALL SELECT scenario, 0, 0, 1 FROM missed) GROUP BY scenario""",
    "hops": """SELECT scenario, gt_id, frame_idx, track_id AS to_track_id, lag(track_id) OVER (
        PARTITION BY scenario, gt_id ORDER BY frame_idx, track_ord) AS from_track_id FROM matched WHERE gt_id IS NOT NULL""",
    "switched": "SELECT scenario, gt_id, frame_idx, from_track_id, to_track_id FROM hops WHERE from_track_id <> to_track_id",
    "sides": """SELECT stream_id, frame_idx, CAST((frame_idx * 7) % 9 - 4 AS DOUBLE) / 2e3 AS a,
        CAST((frame_idx * 5) % 11 - 5 AS DOUBLE) / 2e3 AS b FROM frames""",
    "turned": """SELECT *, CASE WHEN a <= 1e-3 AND b > 1e-3 THEN 'left_to_right'
        WHEN a > 1e-3 AND b <= -1e-3 THEN 'right_to_left' END AS raw_direction FROM sides""",
    "late_scans": """SELECT zone_id, ts, identity, CASE WHEN arrival % 4 = 0 THEN arrival + 1000000000 ELSE arrival END AS arrival
        FROM raw_scans""",
    "then_scans": "SELECT zone_id, ts, arg_max(identity, arrival) AS identity FROM late_scans WHERE arrival < 1000000000 GROUP BY zone_id, ts",
    "final_scans": "SELECT zone_id, ts, arg_max(identity, arrival) AS identity FROM late_scans GROUP BY zone_id, ts",
    **_decision_parts("then_", "records", "then_scans"),
    **_decision_parts("final_", "records", "final_scans"),
    "staged": """SELECT concat('cam', CAST(event_id % 4 AS STRING)) AS stream_id, event_id // 20 AS frame_idx,
        bool_or(event_type = 'purchase') AS d, bool_or(event_type = 'signup') AS t, bool_or(event_type = 'error') AS z,
        bool_or(event_type = 'click') AS w FROM events GROUP BY ALL""",
    "failed": """SELECT stream_id, 'detect' AS stage, true AS dropped FROM staged WHERE d
        UNION ALL SELECT stream_id, 'track', true FROM staged WHERE t AND NOT d
        UNION ALL SELECT stream_id, 'zone', false FROM staged WHERE z AND NOT d AND NOT t
        UNION ALL SELECT stream_id, 'tripwire', false FROM staged WHERE w AND NOT d AND NOT t""",
}

# Parts that several events-against-truth queries share, by the column compared next to person and tripwire.
for _name, _col, _where in (("cq", "direction", "true"), ("vq", "kind", "kind <> 'authorized'")):
    PARTS[f"{_name}_det"] = f"SELECT stream_id AS scenario, tripwire_id, gt_id, {_col} AS what, frame_idx FROM decided WHERE {_where}"
    PARTS[f"{_name}_ref"] = f"SELECT stream_id AS scenario, tripwire_id, gt_id, {_col} AS what, frame_idx FROM gt_decided WHERE {_where}"
    PARTS[f"{_name}_near"] = f"""SELECT r.scenario, r.tripwire_id, r.gt_id, r.what, r.frame_idx, count(d.frame_idx) AS n
        FROM {_name}_ref r LEFT JOIN {_name}_det d ON d.scenario = r.scenario AND d.tripwire_id = r.tripwire_id AND d.gt_id = r.gt_id
          AND d.what = r.what AND abs(d.frame_idx - r.frame_idx) <= 2 GROUP BY ALL"""
    PARTS[f"{_name}_tally"] = f"""SELECT scenario, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fn) AS BIGINT) AS fn,
          CAST(sum(dc) AS BIGINT) AS double_counts, CAST(sum(fp) AS BIGINT) AS fp FROM (
        SELECT scenario, CASE WHEN n > 0 THEN 1 ELSE 0 END AS tp, CASE WHEN n = 0 THEN 1 ELSE 0 END AS fn,
          CASE WHEN n > 1 THEN n - 1 ELSE 0 END AS dc, 0 AS fp FROM {_name}_near
        UNION ALL SELECT scenario, 0, 0, 0, 1 FROM {_name}_det d WHERE NOT EXISTS (SELECT 1 FROM {_name}_ref r
          WHERE d.scenario = r.scenario AND d.tripwire_id = r.tripwire_id AND d.gt_id = r.gt_id AND d.what = r.what
            AND abs(d.frame_idx - r.frame_idx) <= 2)) GROUP BY scenario"""

_CROSS = "stream_id, tripwire_id, track_id, frame_idx, ts, direction, cx, cy"
_PRF = """tp / (tp + fp + 1e-6) AS precision, tp / (tp + fn + 1e-6) AS recall,
    2e0 * (tp / (tp + fp + 1e-6)) * (tp / (tp + fn + 1e-6)) / ((tp / (tp + fp + 1e-6)) + (tp / (tp + fn + 1e-6)) + 1e-6) AS f1"""
_KEY = "stream_id, frame_idx, track_id"


def _rules(table: str, object_id: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT stream_id, {object_id} AS object_id, '{name}' AS rule FROM {table} WHERE {bad}" for name, bad in rules.items())


BODIES: dict[str, str] = {
    "read_detections": "SELECT stream_id, frame_idx, ts, det_ord, det_ord - 1 AS det_id, x1, y1, x2, y2, conf, cls FROM tracks",
    "detect_frames": """SELECT stream_id, frame_idx, ts, det_no AS det_ord, det_no AS det_id, x1, y1, x2, y2, conf, cls FROM (
        SELECT *, row_number() OVER (PARTITION BY stream_id, frame_idx ORDER BY det_ord) - 1 AS det_no FROM tracks) WHERE det_ord <> 5""",
    "index_tracker": """SELECT stream_id, frame_idx, det_ord,
        row_number() OVER (PARTITION BY stream_id, frame_idx ORDER BY det_ord) - 1 AS track_id FROM tracks""",
    "ingest_scans": "SELECT * EXCLUDE (payload) FROM taken",
    "rejected_scans": "SELECT payload, arrival, reason FROM taken WHERE reason IS NOT NULL",
    "parse_timestamp": "SELECT arrival, ts FROM bodies",
    "dedup_scans": "SELECT * FROM scans",
    "prune_scans": "SELECT * FROM scans WHERE ts >= 1e2",
    "pruned_count": "SELECT count(*) AS n_pruned FROM scans WHERE ts < 1e2",
    "load_cameras": "SELECT * EXCLUDE (doc), 'yolov8n.pt' AS model_size FROM cfg",
    "load_zones": """SELECT p.stream_id, p.zone_id, CAST(p.zone_ord AS INTEGER) AS zone_ord,
        string_agg(concat(CAST(e.a_x AS STRING), ' ', CAST(e.a_y AS STRING)), ',' ORDER BY e.i) AS polygon
        FROM cfg_points p JOIN cfg_edges e USING (one) GROUP BY p.one, p.stream_id, p.zone_id, p.zone_ord""",
    "load_tripwires": "SELECT * EXCLUDE (frame_w, frame_h) FROM cfg_wires",
    "record_violations": "SELECT * EXCLUDE (nth), CAST(NULL AS VARCHAR) AS clip_path, CAST(NULL AS VARCHAR) AS clip_url FROM vlog",
    "record_density_alerts": "SELECT *, CAST(NULL AS VARCHAR) AS clip_path, CAST(NULL AS VARCHAR) AS clip_url FROM alog",
    "attach_clip": """SELECT id, stream_id, timestamp, CASE WHEN id % 3 = 0 THEN path END AS clip_path,
        CASE WHEN id % 3 = 0 THEN concat('file://', path) END AS clip_url FROM clip""",
    "results_sink": """SELECT 'displayed' AS output, stream_id, frame_idx, CAST(NULL AS VARCHAR) AS name, track_id AS n FROM shown
        UNION ALL SELECT 'counts', stream_id, frame_idx, zone_id, CAST(count AS BIGINT) FROM occ
        UNION ALL SELECT 'crossings', stream_id, frame_idx, tripwire_id, track_id FROM crossings""",
    "alert_log_versions": """SELECT * EXCLUDE (path), CASE WHEN id % 3 = 0 THEN path END AS clip_path, CASE WHEN id % 3 = 0 THEN concat('file://', path) END AS clip_url
        FROM (SELECT *, concat('/evidence/', stream_id, '/', strftime(to_timestamp(timestamp) AT TIME ZONE 'UTC', '%Y-%m-%d'), '/',
          CAST(id AS STRING), '.mp4') AS path FROM alog)""",
    "expired_clips": """SELECT concat('/evidence/', CAST(o_orderkey AS STRING), '.mp4') AS path,
        CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS DOUBLE) * 864e2 AS modified_ts FROM orders
        WHERE CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS DOUBLE) * 864e2 < 883612800e0 - 365e0 * 864e2""",
    "display_tracks": f"SELECT {_KEY}, conf FROM shown",
    "sanitize_bbox": f"""SELECT {_KEY}, CASE WHEN det_ord IN (1, 2) THEN 0e0 ELSE x1 END AS x1, CASE WHEN det_ord IN (1, 2) THEN 0e0 ELSE y1 END AS y1,
        CASE WHEN det_ord IN (1, 2) THEN 0e0 ELSE x2 END AS x2, CASE WHEN det_ord IN (1, 2) THEN 0e0 ELSE y2 END AS y2 FROM tracks""",
    "bottom_center": f"SELECT {_KEY}, (x1 + x2) / 2e0 AS x, y2 AS y FROM tracks",
    "geometric_center": f"SELECT {_KEY}, (x1 + x2) / 2e0 AS x, (y1 + y2) / 2e0 AS y FROM tracks",
    "camera_centroid": f"""SELECT {_KEY}, (x1 + x2) / 2e0 AS x,
        CASE WHEN stream_id IN ('cam0', 'cam1') THEN (y1 + y2) / 2e0 ELSE y2 END AS y FROM tracks""",
    "to_crossing_records": """SELECT stream_id, track_id, ts,
        coalesce(z, w, 'default') AS zone_id, coalesce(w, z, 'default') AS tripwire_id,
        CASE WHEN track_id = 1 THEN 'unknown' ELSE direction END AS direction FROM (
          SELECT *, CASE WHEN frame_idx % 3 = 1 THEN 'z_rect' END AS z,
            CASE WHEN frame_idx % 5 <> 0 THEN tripwire_id END AS w FROM crossings)""",
    "occupancy_snapshots": "SELECT ts AS timestamp, zone_id, count, stream_id FROM occ WHERE frame_idx % 10 <> 0",
    "violation_rows": "SELECT * EXCLUDE (id, nth) FROM vlog",
    "density_alert_rows": "SELECT * FROM alerts",
    "detections_matrix": """SELECT stream_id, frame_idx, string_agg(concat_ws(' ', CAST(x1 AS STRING), CAST(y1 AS STRING), CAST(x2 AS STRING),
        CAST(y2 AS STRING), CAST(conf AS STRING), '0.0'), ';' ORDER BY det_ord) AS matrix FROM tracks GROUP BY ALL""",
    "tracks_from_matrix": """SELECT stream_id, frame_idx, CAST(row_number() OVER (PARTITION BY stream_id, frame_idx ORDER BY det_ord) - 1 AS INTEGER) AS track_ord,
        track_id, x1, y1, x2, y2, conf, cls, det_ord AS det_ind, true AS embeddable FROM tracks""",
    "validate_cameras": _rules("cfg", "stream_id", {
        "source_required": "source = ''", "tracker_type_known": "tracker_type NOT IN ('bytetrack', 'botsort')",
        "appearance_needs_botsort": "use_appearance AND tracker_type <> 'botsort'",
        "buffer_seconds_positive": "buffer_seconds <= 0", "fps_fallback_positive": "fps_fallback <= 0",
        "display_conf_in_0_1": "display_conf < 0 OR display_conf > 1",
        "centroid_mode_known": "centroid_mode NOT IN ('bottom_center', 'geometric_center')",
        "max_density_threshold_positive": "max_density_threshold <= 0",
        "density_dwell_not_negative": "density_dwell_seconds < 0", "density_cooldown_not_negative": "density_cooldown_seconds < 0",
        "frame_size_pair_of_positive": "frame_w <= 0 OR frame_h <= 0",
    }) + " UNION ALL SELECT stream_id, stream_id, 'stream_id_unique' FROM cfg GROUP BY stream_id HAVING count(*) > 1",
    "validate_zones": _rules("cfg_points", "zone_id", {
        "id_required": "zone_id = ''", "at_least_3_points": "n < 3",
        "not_self_intersecting": "one IN (SELECT one FROM cfg_crossed)",
    }) + """ UNION ALL SELECT stream_id, zone_id, 'zone_id_unique' FROM cfg_points GROUP BY stream_id, zone_id HAVING count(*) > 1""",
    "validate_tripwires": _rules("cfg_wires", "tripwire_id", {
        "id_required": "tripwire_id = ''", "ends_differ": "p1x = p2x AND p1y = p2y",
        "inside_frame": "NOT (p1x BETWEEN 0 AND frame_w AND p1y BETWEEN 0 AND frame_h AND p2x BETWEEN 0 AND frame_w AND p2y BETWEEN 0 AND frame_h)",
        "recycle_after_frames_not_negative": "recycle_after_frames < 0", "recycle_distance_px_not_negative": "recycle_distance_px < 0",
        "direction_in_known": "direction_in NOT IN ('left_to_right', 'right_to_left')",
    }) + " UNION ALL SELECT stream_id, tripwire_id, 'tripwire_id_unique' FROM cfg_wires GROUP BY ALL HAVING count(*) > 1",
    "duplicate_ids": "SELECT stream_id, zone_id, count(*) AS n FROM cfg_points GROUP BY ALL HAVING count(*) > 1",
    "signed_area": """SELECT p.stream_id, t.tripwire_id, p.frame_idx, p.track_id,
        (t.x2 - t.x1) * (p.cy - t.y1) - (t.y2 - t.y1) * (p.cx - t.x1) AS side FROM pts p JOIN wires t
        ON p.stream_id = t.stream_id""",
    "classify_direction": "SELECT stream_id, frame_idx, raw_direction FROM turned",
    "map_in_out": """SELECT stream_id, frame_idx, CASE WHEN raw_direction IS NULL THEN NULL
        WHEN raw_direction = CASE WHEN frame_idx % 2 = 0 THEN 'left_to_right' ELSE 'right_to_left' END THEN 'in' ELSE 'out' END AS direction FROM turned""",
    "point_on_segment": f"SELECT {_KEY}, {_TOUCH} AS on_segment FROM pts p, LATERAL (SELECT p.cx - 1e1 AS x1, 1e2 AS y1, p.cx + 1e1 AS x2, p.cy AS y2) e",
    "point_in_polygon": f"SELECT {_KEY}, zone_id, inside FROM inside",
    "segments_intersect": f"SELECT {_KEY}, {_proper('a_', 'b_', 'c_', 'd_')} AS hit FROM (SELECT *, x1 AS a_x, y1 AS a_y, x2 AS b_x, y2 AS b_y, "
                          "5e1 AS c_x, 6e1 AS c_y, 59e1 AS d_x, 43e1 AS d_y FROM tracks)",
    "polygon_self_intersects": """SELECT stream_id, zone_id, CAST(zone_ord AS INTEGER) AS zone_ord,
        count(*) FILTER (WHERE one IN (SELECT one FROM cfg_crossed)) AS n_crossed FROM cfg_points WHERE n >= 3 GROUP BY ALL""",
    "iou": f"""SELECT {_KEY}, inter / (areas - inter + 1e-6) AS iou FROM (SELECT *, (x2 - x1) * (y2 - y1) + ((x2 + s) - (x1 + s)) * ((y2 + s) - (y1 + s)) AS areas,
        greatest(0e0, least(x2, x2 + s) - greatest(x1, x1 + s)) * greatest(0e0, least(y2, y2 + s) - greatest(y1, y1 + s)) AS inter
        FROM (SELECT *, CAST(frame_idx % 50 AS DOUBLE) AS s FROM tracks))""",
    "centroid_distance": f"""SELECT {_KEY}, round(sqrt((px - cx) * (px - cx) + (py - cy) * (py - cy)), 6) AS dist,
        (px - cx) * (px - cx) + (py - cy) * (py - cy) AS dist_sq FROM moves WHERE px IS NOT NULL""",
    "l2_normalize": """SELECT vec_id, CAST(generate_subscripts(v, 1) - 1 AS BIGINT) AS pos, round(unnest(v), 6) AS v FROM (
        SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE) / sqrt(list_reduce(list_transform(embedding,
          lambda q: CAST(q AS DOUBLE) * CAST(q AS DOUBLE)), lambda m, n: m + n))) AS v FROM embeddings)""",
    "zone_membership": f"SELECT {_KEY}, cx, cy, zone_id FROM member",
    "raster_membership": f"SELECT {_KEY}, cx, cy, zone_id FROM member",
    "crossing_candidates": f"SELECT {_CROSS} FROM cands",
    "crossing_candidates_clipped": f"""SELECT {_CROSS} FROM cands WHERE
        ((cx - px) * (y1 - py) - (cy - py) * (x1 - px)) * ((cx - px) * (y2 - py) - (cy - py) * (x2 - px)) <= 0""",
    "scan_window_lookup": """SELECT r.stream_id, r.zone_id, r.track_id, r.ts, s.ts AS scan_ts, s.identity AS scan_identity
        FROM records r JOIN scans s ON s.zone_id = r.zone_id AND s.ts BETWEEN r.ts - 1e0 AND r.ts + 1e0""",
    "nearest_scan": "SELECT stream_id, zone_id, track_id, ts, scan_ts, scan_identity FROM nearest",
    "unmatched_crossings": """SELECT stream_id, zone_id, track_id, ts FROM records r WHERE NOT EXISTS (
        SELECT 1 FROM raw_scans s WHERE s.zone_id = r.zone_id AND s.ts BETWEEN r.ts - 1e0 AND r.ts + 1e0)""",
    "occupancy_asof": """SELECT c.stream_id, c.tripwire_id, c.track_id, c.ts, o.count AS occupancy_at_crossing FROM crossings c
        ASOF LEFT JOIN (SELECT stream_id, count, ts + CAST(frame_idx % 3 - 1 AS DOUBLE) * 3e-1 AS ts FROM occ WHERE zone_id = 'z_rect') o
          ON o.stream_id = c.stream_id AND c.ts >= o.ts""",
    "match_tracks_to_gt": "SELECT * FROM matched",
    "missed_ground_truth": "SELECT * FROM missed",
    "evidence_window": "SELECT * FROM win",
    "evidence_manifest": "SELECT * FROM manifest",
    "clip_join": """SELECT l.id, l.kind, m.n_frames, m.complete, m.clip_path, m.clip_url, m.clip_backend
        FROM vlog l LEFT JOIN (SELECT * FROM manifest WHERE violation_id % 2 = 0) m ON m.violation_id = l.id""",
    "id_switch_pairs": """SELECT a.stream_id, a.frame_idx, a.ts, b.track_id AS from_track_id, a.track_id AS to_track_id,
          a.gx - b.gx AS dx, a.gy - b.gy AS dy, a.ts - b.ts AS dt
        FROM (SELECT *, (x1 + x2) / 2e0 AS gx, (y1 + y2) / 2e0 AS gy FROM tracks) a
        JOIN (SELECT *, (x1 + x2) / 2e0 AS gx, (y1 + y2) / 2e0 AS gy,
                lead(frame_idx) OVER (PARTITION BY stream_id, track_id ORDER BY frame_idx, track_ord) AS nf FROM tracks) b
          ON a.stream_id = b.stream_id AND a.track_id <> b.track_id AND b.frame_idx < a.frame_idx AND b.ts >= a.ts - 2e0
        WHERE (b.nf IS NULL OR a.frame_idx <= b.nf) AND (a.gx - b.gx) * (a.gx - b.gx) + (a.gy - b.gy) * (a.gy - b.gy) <= 16e2""",
    "zone_occupancy": "SELECT * FROM occ",
    "zone_occupancy_history": """SELECT stream_id, frame_idx, ts, string_agg(concat(zone_id, '=', CAST(count AS STRING)), ',' ORDER BY zone_id) AS zone_counts
        FROM occ GROUP BY ALL""",
    "stream_report": """SELECT c.stream_id, c.source, concat('rep_', c.stream_id) AS report_id,
        (SELECT count(*) FROM frames f WHERE f.stream_id = c.stream_id) AS total_frames_processed,
        (SELECT round(max(ts) - min(ts), 2) FROM frames f WHERE f.stream_id = c.stream_id) AS processing_duration_seconds,
        (SELECT round(count(*) / (max(ts) - min(ts) + 1e-6), 2) FROM frames f WHERE f.stream_id = c.stream_id) AS pipeline_fps,
        (SELECT count(DISTINCT track_id) FROM shown f WHERE f.stream_id = c.stream_id) AS unique_persons_tracked,
        (SELECT count(*) FROM crossings f WHERE f.stream_id = c.stream_id) AS total_tripwire_crossings,
        (SELECT count(*) FROM alerts f WHERE f.stream_id = c.stream_id) AS total_high_density_alerts FROM cams c""",
    "report_items": """SELECT stream_id, 'person_track_ids' AS section, CAST(NULL AS DOUBLE) AS sort_ts, track_id AS sort_id,
          CAST(track_id AS STRING) AS body FROM (SELECT DISTINCT stream_id, track_id FROM shown)
        UNION ALL SELECT stream_id, 'tripwire_crossings', ts, track_id, concat('{"timestamp":', CAST(round(ts, 2) AS STRING),
          ',"track_id":', CAST(track_id AS STRING), ',"tripwire_id":"', tripwire_id, '","direction":"', direction,
          '","centroid":[', CAST(round(cx, 1) AS STRING), ',', CAST(round(cy, 1) AS STRING), ']}') FROM crossings
        UNION ALL SELECT stream_id, 'high_density_alerts', timestamp, NULL, concat('{"timestamp":', CAST(round(timestamp, 2) AS STRING),
          ',"zone_id":"', zone_id, '","density_count":', CAST(density_count AS STRING), ',"threshold":', CAST(threshold AS STRING), '}') FROM alerts
        UNION ALL SELECT stream_id, 'stage_latencies', NULL, NULL, concat('{"stage":"', stage, '","count":', CAST(count(*) AS STRING),
          ',"avg_ms":', CAST(round(CAST(sum(micros) AS DOUBLE) / 1e6 / (count(*) + 1e-6) * 1e3, 2) AS STRING), '}')
          FROM samples WHERE stage <> 'other' GROUP BY stream_id, stage""",
    "list_streams": """SELECT c.stream_id, c.source, (SELECT count(*) FROM frames f WHERE f.stream_id = c.stream_id) AS processed_frames,
        (SELECT count(DISTINCT track_id) FROM shown f WHERE f.stream_id = c.stream_id) AS unique_persons_tracked,
        (SELECT count(*) FROM crossings f WHERE f.stream_id = c.stream_id) AS crossings_count, 'active' AS status FROM cams c""",
    "event_counters": """SELECT counter, label, count(*) AS value FROM counted_events WHERE counter IS NOT NULL GROUP BY counter, label
        UNION ALL SELECT counter, NULL, count(*) FROM counted_events WHERE counter IS NOT NULL GROUP BY counter""",
    "latency_histogram": """WITH g AS (SELECT stage, stream_id, micros FROM samples WHERE stage <> 'other'
          UNION ALL SELECT stage, NULL, micros FROM samples WHERE stage <> 'other'),
        h AS (SELECT stage, stream_id, count(*) AS n, CAST(sum(micros) AS DOUBLE) / 1e6 AS sum_seconds FROM g GROUP BY ALL),
        b(le, top) AS (VALUES """ + ", ".join(f"('{b}', {b * 1e6!r}e0)" for b in LATENCY_BUCKETS) + """, ('+Inf', 1e18))
        SELECT h.stage, h.stream_id, h.n, h.sum_seconds, b.le, count(g.micros) AS cumulative FROM h, b
        LEFT JOIN g ON g.stage = h.stage AND g.stream_id IS NOT DISTINCT FROM h.stream_id AND g.micros <= b.top GROUP BY ALL""",
    "metrics_snapshot": "SELECT " + ", ".join(
        f"(SELECT count(*) FROM log_events WHERE event = '{e}') AS {c}" for c, e in COUNTERS.items()) + ", " + ", ".join(
        f"(SELECT count(*) FROM samples WHERE stage = '{s}') AS {s}_count" for s in STAGES),
    "stage_latency_avg": """SELECT stream_id, stage, count(*) AS n,
        round(CAST(sum(micros) AS DOUBLE) / 1e6 / (count(*) + 1e-6) * 1e3, 2) AS avg_ms FROM samples WHERE stage <> 'other' GROUP BY ALL""",
    "scan_count_by_zone": "SELECT zone_id, count(*) AS n_scans FROM scans GROUP BY zone_id",
    "scan_count_near": """SELECT p.zone_id, p.ts, count(s.ts) AS n_scans FROM (SELECT DISTINCT zone_id, ts FROM records) p
        LEFT JOIN scans s ON s.zone_id = p.zone_id AND s.ts BETWEEN p.ts - 1e0 AND p.ts + 1e0 GROUP BY ALL""",
    "detection_quality": f"SELECT scenario, tp, fp, fn, {_PRF} FROM tallies",
    "overall_quality": f"""SELECT tp, fp, fn, {_PRF}, (SELECT count(*) FROM switched) AS id_switches FROM (
        SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM tallies)""",
    "id_switch_rate": """SELECT scenario, n_frames, id_switches, id_switches / (n_frames / 3e1 / 6e1 + 1e-6) AS switches_per_minute FROM (
        SELECT stream_id AS scenario, count(*) AS n_frames, (SELECT count(*) FROM switched s WHERE s.scenario = f.stream_id) AS id_switches
        FROM frames f GROUP BY stream_id)""",
    "crossing_quality": "SELECT *, tp / (tp + fp + 1e-6) AS precision, tp / (tp + fn + 1e-6) AS recall FROM cq_tally",
    "violation_quality": "SELECT *, tp / (tp + fp + 1e-6) AS precision, tp / (tp + fn + 1e-6) AS recall FROM vq_tally",
    "crossing_totals": """SELECT stream_id, tripwire_id, count(*) FILTER (WHERE direction = 'in') AS n_in,
        count(*) FILTER (WHERE direction = 'out') AS n_out, count(*) AS n_total FROM crossings GROUP BY stream_id, tripwire_id
        UNION ALL SELECT stream_id, NULL, count(*) FILTER (WHERE direction = 'in'), count(*) FILTER (WHERE direction = 'out'), count(*)
        FROM crossings GROUP BY stream_id""",
    "prev_centroid": f"SELECT {_KEY}, px AS prev_cx, py AS prev_cy FROM moves",
    "centroid_history": f"""SELECT {_KEY}, array_to_string(list(concat_ws(':', CAST((x1 + x2) / 2e0 AS STRING), CAST((y1 + y2) / 2e0 AS STRING),
        CAST(ts AS STRING))) OVER (PARTITION BY stream_id, track_id ORDER BY frame_idx, track_ord ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), ';') AS history
        FROM tracks""",
    "carry_embedding": f"""SELECT {_KEY}, last_value(emb_key IGNORE NULLS) OVER (PARTITION BY stream_id, track_id ORDER BY frame_idx, track_ord
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS emb_key FROM tracks""",
    "track_lifetimes": """SELECT stream_id, track_id, min(ts) AS first_seen_ts, max(ts) AS last_seen_ts, max(ts) - min(ts) AS age_seconds,
        count(*) AS observations FROM tracks GROUP BY ALL""",
    "tailgating": "SELECT stream_id, zone_id, track_id, ts, scan_ts, scan_identity FROM decided WHERE kind = 'tailgating'",
    "consumption_ordinal": "SELECT stream_id, zone_id, track_id, ts, nth AS ordinal FROM decided",
    "density_runs": "SELECT stream_id, zone_id, ts, count, run_start, ts - run_start AS dwell_seconds, peak FROM runs",
    "gt_id_switches": "SELECT * FROM switched",
    "recent_violations": "SELECT id, timestamp, zone_id, kind FROM vlog WHERE zone_id = 'tw_cam1' ORDER BY timestamp DESC, id LIMIT 100",
    "recent_density_alerts": "SELECT id, timestamp, zone_id, density_count FROM alog ORDER BY timestamp DESC, id LIMIT 100",
    "dashboard_alerts": "SELECT id, timestamp, zone_id, density_count FROM alog ORDER BY timestamp DESC, id LIMIT 20",
    "latest_track_state": """SELECT t.stream_id, t.track_id, t.frame_idx, t.ts, t.x1, t.y1, t.x2, t.y2, t.conf,
        (SELECT arg_max(e.emb_key, e.frame_idx) FROM tracks e WHERE e.stream_id = t.stream_id AND e.track_id = t.track_id
          AND e.emb_key IS NOT NULL) AS emb_key
        FROM tracks t WHERE t.frame_idx = (SELECT max(m.frame_idx) FROM tracks m WHERE m.stream_id = t.stream_id AND m.track_id = t.track_id)""",
    "latest_frame": "SELECT stream_id, max(frame_idx) AS frame_idx, arg_max(ts, frame_idx) AS ts FROM frames GROUP BY stream_id",
    "all_crossings": f"SELECT {_CROSS} FROM crossings",
    "all_alerts": """SELECT kind, id, timestamp, stream_id, zone_id, CAST(NULL AS BIGINT) AS density_count, tripwire_id FROM vlog
        UNION ALL SELECT 'high_density', id, timestamp, stream_id, zone_id, density_count, NULL FROM alog""",
    "surviving_track_ids": """WITH renamed AS (SELECT stream_id, frame_idx, CASE WHEN stream_id IN ('cam0', 'cam2') AND track_id = 4
          AND frame_idx > 25 THEN 104 ELSE track_id END AS track_id FROM tracks)
        SELECT stream_id, track_id FROM renamed WHERE frame_idx <= 19
        INTERSECT SELECT stream_id, track_id FROM renamed WHERE frame_idx >= 30""",
    "iou_tracker": """SELECT s.stream_id, frame_idx, ts, det_ord, det_id, x1, y1, x2, y2, conf, cls, w.got AS track_id
        FROM box_steps s JOIN box_walk w USING (stream_id, rn) WHERE w.got IS NOT NULL""",
    "tracker_fn": """SELECT s.stream_id, frame_idx, ts, det_ord, det_id, x1, y1, x2, y2, conf, cls, w.got AS track_id
        FROM box_steps s JOIN box_walk w USING (stream_id, rn) WHERE w.got IS NOT NULL""",
    "id_switches": """SELECT s.stream_id, frame_idx, ts, row_number() OVER (PARTITION BY s.stream_id, frame_idx ORDER BY rn) - 1 AS ord,
        w.pick.id AS from_track_id, track_id AS to_track_id, s.x - w.pick.x AS dx, s.y - w.pick.y AS dy, ts - w.pick.since AS dt
        FROM switch_steps s JOIN switch_walk w USING (stream_id, rn) WHERE w.pick IS NOT NULL""",
    "tripwire_crossings": f"SELECT {_CROSS} FROM crossings",
    "density_alerts": "SELECT * FROM alerts",
    "density_cooldown_alerts": """SELECT c.ts AS timestamp, c.stream_id, c.zone_id, c.count AS density_count, 2 AS threshold
        FROM crowded c JOIN cooled w USING (stream_id, zone_id, rn) WHERE w.fired""",
    "access_violations": """SELECT timestamp, stream_id, zone_id, tripwire_id, track_id, direction, kind, matching_identity AS identity,
        nth - 1 AS prior_crossings, notes FROM vlog""",
    "access_decisions": """SELECT stream_id, zone_id, track_id, ts, kind, kind = 'authorized' AS authorized, scan_ts, scan_identity,
        nth - 1 AS prior_crossings FROM decided""",
    "access_with_occupancy": """SELECT c.stream_id, c.zone_id, c.track_id, c.ts, c.kind, o.count AS occupancy_at_crossing FROM decided c
        LEFT JOIN occ o ON o.stream_id = c.stream_id AND o.ts = c.ts
          AND c.zone_id = concat(CASE WHEN o.zone_id = 'z_rect' THEN 'tw_' ELSE 'diag_' END, o.stream_id)""",
    "late_scan_reevaluation": """SELECT a.zone_id, a.stream_id, a.tripwire_id, a.track_id, a.frame_idx, a.ts, a.kind AS kind_then, b.kind AS kind_final
        FROM then_decided a JOIN final_decided b USING (zone_id, stream_id, tripwire_id, track_id, frame_idx, ts) WHERE a.kind <> b.kind""",
    "reset_density_zone": "SELECT * FROM reset_alerts",
    "stage_failures": """SELECT stream_id, stage, count(*) AS n_failures, count(*) FILTER (WHERE dropped) AS n_dropped_frames
        FROM failed GROUP BY stream_id, stage""",
    "stage_survivors": """SELECT stream_id, frame_idx, CAST(frame_idx AS DOUBLE) * 5e-1 AS ts, NOT z AS zones_ok, NOT w AS tripwires_ok
        FROM staged WHERE NOT d AND NOT t""",
    "clip_path": "SELECT id, path FROM clip",
    "clip_url": "SELECT id, concat('file://', path) AS local_url, concat('noop://', stream_id, '/', CAST(id AS STRING)) AS noop_url FROM clip",
    "density_notes": "SELECT stream_id, zone_id, timestamp, notes FROM alerts",
    "violation_notes": "SELECT stream_id, zone_id, timestamp, track_id, concat(notes, ' | reviewed') AS notes FROM vlog",
}

_WORD = re.compile(r"[a-z_][a-z0-9_]*")


def sql_for(body: str) -> str:
    """``body`` with the parts it needs, in the order they are listed."""
    needed: set[str] = set()
    open_ = [body]
    while open_:
        for word in set(_WORD.findall(open_.pop())):
            if word in PARTS and word not in needed:
                needed.add(word)
                open_.append(PARTS[word])
    if not needed:
        return body
    listed = ",\n".join(f"{name} AS ({PARTS[name]})" for name in PARTS if name in needed)
    return f"WITH RECURSIVE {listed}\nSELECT * FROM ({body})" if body.lstrip().startswith("WITH") else f"WITH RECURSIVE {listed}\n{body}"


def all_sql() -> dict[str, str]:
    return {name: sql_for(body) for name, body in BODIES.items()}
