"""Structured Streaming forms of the stateful operators.

Rows reach a rule in event-time order however they arrive: a row waits in the
state until the watermark has passed it, and is then worked on. Every key's
state is bounded by what its rule remembers plus the rows still waiting, and a
key that has been idle for ``idle_seconds`` of event time is forgotten if the
processor has such a limit.

Every output has a column ``event_time``, named to Spark as its event time: when
the row could be known. So one form can feed the next in a single query, from
boxes to tracks, crossings and decisions, or to counts and alerts.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from paceline.functions import geometry as G
from paceline.functions.text import density_notes
from paceline.operators.camera_state import BOX_COLUMNS, BoxTracker, MakeTracker, SwitchDetector
from paceline.operators.zones import zone_membership
from paceline.streaming import transitions as T


class InOrder(StatefulProcessor):
    """Holds rows back until the watermark has passed them, then hands them to ``work`` in order.

    Subclasses give ``order`` (columns to sort by), ``columns`` (what to keep of
    a row) and ``work(key, rows, state) -> (output rows, state)``.
    """

    order: tuple[str, ...] = ("ts",)
    columns: tuple[str, ...] = ()
    hold_seconds = 0.0
    idle_seconds: float | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts double, body string")
        self.memory = handle.getValueState("memory", "body string")
        self.latest = handle.getValueState("latest", "ts double")

    def work(self, key: tuple, rows: list[dict], state: str | None) -> tuple[list[dict], str | None]:
        raise NotImplementedError

    def forget(self, state: str | None) -> str | None:
        """What stays of the state of a key that has been idle for too long."""
        return None

    def _remember(self, state: str | None) -> None:
        if state is None:
            self.memory.clear()
        else:
            self.memory.update((state,))

    def _due(self, ts: float) -> int:
        """The watermark, in ms, from which on nothing earlier can come."""
        return math.ceil(round((ts + self.hold_seconds) * 1e6) / 1000)

    def _wake(self, ts: float) -> None:
        # timers that lie below the watermark expire
        self.handle.registerTimer(self._due(ts) - 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            kept = pdf[list(self.columns)]
            bodies = [json.dumps(r, default=_plain) for r in kept.to_dict("records")]
            self.waiting.appendList([(float(t), b) for t, b in zip(pdf["ts"], bodies)])
            # one timer for all: when it expires, it takes every row that is due and sets the next one
            self._wake(float(pdf["ts"].min()))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        ready, later = [], []
        for ts, body in self.waiting.get():
            (ready if self._due(ts) <= now else later).append((ts, body))
        if not ready:
            if later:
                self._wake(min(ts for ts, _ in later))
            # rows that still wait are later than the watermark, and so than the gap
            if self.idle_seconds is not None and self.latest.exists():
                if self._due(self.latest.get()[0] + self.idle_seconds) <= now:
                    self._remember(self.forget(self.memory.get()[0] if self.memory.exists() else None))
                    self.latest.clear()
            return
        if later:
            self.waiting.put(later)
            self._wake(min(ts for ts, _ in later))
        else:
            self.waiting.clear()
        rows = sorted((json.loads(b) for _, b in ready), key=lambda r: tuple(r[c] for c in self.order))
        state = self.memory.get()[0] if self.memory.exists() else None
        out = []
        for fresh_start, block in self._blocks(rows):
            found, state = self.work(key, block, self.forget(state) if fresh_start else state)
            out += found
        if self.idle_seconds is not None:
            last = rows[-1]["ts"]
            if self._due(last + self.idle_seconds) <= now:
                state = self.forget(state)
                self.latest.clear()
            else:
                self.latest.update((last,))
                self._wake(last + self.idle_seconds)
        self._remember(state)
        if out:
            made = pd.DataFrame(out)
            at = made["ts" if "ts" in made else "timestamp"] + self.hold_seconds
            yield made.assign(event_time=pd.to_datetime((at * 1e6).round().astype("int64"), unit="us", utc=True))

    def _blocks(self, rows: list[dict]) -> Iterator[tuple[bool, list[dict]]]:
        """Rows between gaps longer than ``idle_seconds``, and whether the key is new by then."""
        if self.idle_seconds is None:
            yield False, rows
            return
        last = self.latest.get()[0] if self.latest.exists() else rows[0]["ts"]
        fresh, block = False, []
        for r in rows:
            if r["ts"] - last > self.idle_seconds:
                if block:
                    yield fresh, block
                fresh, block = True, []
            block.append(r)
            last = r["ts"]
        yield fresh, block

    def close(self) -> None:
        pass


def _plain(v):
    return v.item() if hasattr(v, "item") else str(v)


def _timed(stream: DataFrame, delay: str) -> DataFrame:
    if "event_time" in stream.columns:
        return stream
    return stream.withColumn("event_time", F.timestamp_micros((F.col("ts") * F.lit(1e6)).cast("long"))).withWatermark(
        "event_time", delay)


def _run(stream: DataFrame, keys: list[str], processor: StatefulProcessor, ddl: str, delay: str) -> DataFrame:
    # a stream that was timed before, by a join or another processor, keeps its watermark
    return _timed(stream, delay).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=f"{ddl}, event_time timestamp", outputMode="append",
        timeMode="EventTime", eventTimeColumnName="event_time")


class _Wires(InOrder):
    order = ("frame_idx",)
    columns = ("frame_idx", "ts", "track_ord", "cx", "cy", "wires")

    def __init__(self, idle_seconds: float | None):
        self.idle_seconds = idle_seconds

    def work(self, key, rows, state):
        out = []
        for r in rows:
            state, found = T.cross_wires(state, r["frame_idx"], r["cx"], r["cy"], json.loads(r["wires"]))
            out += [
                {"stream_id": key[0], "tripwire_id": wire, "track_id": key[1], "frame_idx": r["frame_idx"], "ts": r["ts"],
                 "track_ord": r["track_ord"], "direction": direction, "cx": r["cx"], "cy": r["cy"]}
                for wire, direction in found
            ]
        return out, state


def stream_tripwire_crossings(
    points: DataFrame, tripwires: DataFrame, delay: str = "10 seconds", idle_seconds: float | None = None
) -> DataFrame:
    """``tripwire_crossings`` on a stream of track points, by camera and track.

    With ``idle_seconds`` a track not seen for so long is forgotten, which keeps
    the state small where ids are never used again.
    """
    wires = tripwires.groupBy("stream_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct(
        "tw_ord", F.col("tripwire_id").alias("id"), F.col("p1.x").alias("x1"), F.col("p1.y").alias("y1"),
        F.col("p2.x").alias("x2"), F.col("p2.y").alias("y2"), "direction_in",
        F.col("recycle_after_frames").alias("frames"), F.col("recycle_distance_px").alias("px"))))).alias("wires"))
    return _run(
        _timed(points, delay).join(wires, "stream_id"), ["stream_id", "track_id"], _Wires(idle_seconds),
        "stream_id string, tripwire_id string, track_id bigint, frame_idx bigint, ts double, track_ord bigint, "
        "direction string, cx double, cy double", delay)


def stream_zone_counts(frames: DataFrame, points: DataFrame, zones: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """``zone_counts`` on streams of frames and track points, which carry the time of their frame.

    A frame's counts come out once the watermark has passed it; frames without
    people count 0 in every zone. The result feeds ``stream_density_alerts`` and
    ``stream_density_cooldown_alerts``.
    """
    timed = _timed(points, delay).select("event_time", "stream_id", "frame_idx", "cx", "cy")
    none = F.lit(None)
    people = zone_membership(timed, zones).select(
        "event_time", "stream_id", "frame_idx", "zone_id", none.cast("double").alias("ts"), F.lit(1).alias("one"))
    blank = _timed(frames, delay).join(zones.select("stream_id", "zone_id"), "stream_id").select(
        "event_time", "stream_id", "frame_idx", "zone_id", "ts", none.cast("int").alias("one"))
    return (
        blank.unionByName(people).groupBy("event_time", "stream_id", "frame_idx", "zone_id")
        .agg(F.max("ts").alias("ts"), F.count("one").alias("count")).filter("ts is not null")
    )


class _Crowd(InOrder):
    columns = ("ts", "count", "reset", "turn", "threshold", "dwell_required", "cooldown")
    order = ("ts", "turn")

    def __init__(self, idle_seconds: float | None):
        self.idle_seconds = idle_seconds

    def work(self, key, rows, state):
        out = []
        for r in rows:
            state, alert = T.crowd(
                state, r["ts"], r["count"], bool(r["reset"]), r["threshold"], r["dwell_required"], r["cooldown"])
            if alert:
                out.append({"timestamp": r["ts"], "stream_id": key[0], "zone_id": key[1], "density_count": alert[0],
                            "threshold": r["threshold"], "dwell_seconds": alert[1]})
        return out, state


def stream_density_alerts(
    ruled: DataFrame, delay: str = "10 seconds", idle_seconds: float | None = None
) -> DataFrame:
    """``density_alerts`` on a stream of counts with their rule; rows with ``reset`` clear the zone.

    With ``idle_seconds`` a zone without counts for so long begins anew.
    """
    rows = ruled if "reset" in ruled.columns else ruled.withColumn("reset", F.lit(False))
    rows = rows.withColumn("reset", F.coalesce("reset", F.lit(False)))
    rows = rows.withColumn("turn", F.when(F.col("reset"), 0).otherwise(1))
    alerts = _run(
        rows, ["stream_id", "zone_id"], _Crowd(idle_seconds),
        "timestamp double, stream_id string, zone_id string, density_count bigint, threshold int, dwell_seconds double", delay)
    return alerts.withColumn(
        "notes", density_notes(F.col("density_count"), F.col("threshold"), F.col("dwell_seconds")))


class _Cooled(InOrder):
    columns = ("ts", "count")

    def __init__(self, threshold: int, cooldown: float):
        self.threshold, self.cooldown = threshold, cooldown
        # after a longer gap the rule fires whatever it remembers
        self.idle_seconds = cooldown

    def work(self, key, rows, state):
        out = []
        for r in rows:
            state, fires = T.cooled(state, r["ts"], r["count"], self.threshold, self.cooldown)
            if fires:
                out.append({"timestamp": r["ts"], "stream_id": key[0], "zone_id": key[1], "density_count": r["count"],
                            "threshold": self.threshold})
        return out, state


def stream_density_cooldown_alerts(
    occupancy: DataFrame, threshold: int = 8, cooldown_seconds: float = 10.0, delay: str = "10 seconds"
) -> DataFrame:
    return _run(
        occupancy, ["stream_id", "zone_id"], _Cooled(threshold, cooldown_seconds),
        "timestamp double, stream_id string, zone_id string, density_count bigint, threshold int", delay)


#: A watermark that moves on by more pages than this at once has the zone's pages listed.
JUMP_PAGES = 64


class _Access(InOrder):
    """Crossings wait until every scan they could match must have come: their time plus the window.

    Scans and decided crossings lie in a map by page of time. With
    ``correct_seconds`` rows behind the watermark come in as well, and decisions
    they change are put out again.
    """

    columns = ("ts", "stream_id", "tripwire_id", "track_id", "frame_idx", "track_ord", "direction")
    order = ("ts", "stream_id", "frame_idx", "track_ord", "track_id", "tripwire_id")

    def __init__(self, window: float, correct_seconds: float | None):
        self.window, self.correct_seconds = window, correct_seconds
        self.hold_seconds = window
        # a late scan decides anew three windows around it, which look one window further; two more for the ends of pages
        self.keep_seconds = 2 * window + (correct_seconds or 0.0) + (0.0 if correct_seconds is None else 4 * window)

    def init(self, handle):
        super().init(handle)
        self.stored = handle.getMapState("book", "page long", "body string")
        self.oldest = handle.getValueState("oldest", "page long")

    def _open(self) -> T.AccessBook:
        def load(page: int) -> str | None:
            return self.stored.getValue((page,))[0] if self.stored.containsKey((page,)) else None
        return T.AccessBook(self.window, load)

    def _save(self, book: T.AccessBook) -> None:
        for page in book.changed:
            self.stored.updateValue((page,), (json.dumps(book.pages[page]),))
        if book.changed:
            first = min(book.changed)
            if not self.oldest.exists() or first < self.oldest.get()[0]:
                self.oldest.update((first,))
            self._wake((max(book.changed) + 1) * 2 * self.window + self.keep_seconds)

    def _too_late(self, ts: float, now: float) -> bool:
        return self.correct_seconds is not None and ts < now - self.correct_seconds

    def _row(self, zone: str, row: dict, found: list, revision: int) -> dict:
        return {
            "ts": row["ts"], "stream_id": row["stream_id"], "zone_id": zone, "tripwire_id": row["tripwire_id"],
            "track_id": row["track_id"], "frame_idx": row["frame_idx"], "direction": row["direction"], "kind": found[0],
            "authorized": found[0] == "authorized", "scan_ts": found[1], "scan_identity": found[2], "revision": revision,
        }

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentWatermarkInMs() / 1000.0
        book, spans, out, frames = self._open(), [], [], []
        for pdf in rows:
            is_scan = pdf["kind"] == "scan"
            late = pdf["ts"].map(lambda ts: self._too_late(ts, now)).astype(bool)
            for r in pdf[late].to_dict("records"):
                scan = r["kind"] == "scan"
                out.append(self._row(key[0], r, ["too_late", r["ts"] if scan else None, r["identity"] if scan else None], 0))
            found = pdf[is_scan & ~late]
            for ts, who, arrival in zip(found["ts"], found["identity"], found["arrival"]):
                if book.add_scan(float(ts), who, int(arrival)) and ts <= now:
                    spans.append((ts - 3 * self.window, ts + 3 * self.window))
            frames.append(pdf[~is_scan & ~late])
        out += [self._row(key[0], c["row"], c["found"], c["revision"]) for c in book.settle(spans)]
        self._save(book)
        yield from super().handleInputRows(key, iter([f for f in frames if len(f)]), timerValues)
        if out:
            yield _known_at(pd.DataFrame(out), now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() / 1000.0
        for made in super().handleExpiredTimer(key, timerValues, expiredTimerInfo):
            yield made if self.correct_seconds is None else _known_at(made, now)
        if self.oldest.exists():
            first, bound = self.oldest.get()[0], math.floor((now - self.keep_seconds) / (2 * self.window))
            # time may have jumped: then the pages there are, not all those there could be
            pages = range(first, bound) if bound - first <= JUMP_PAGES else [k[0] for k in self.stored.keys() if k[0] < bound]
            for page in pages:
                if self.stored.containsKey((page,)):
                    self.stored.removeKey((page,))
            if bound > first:
                self.oldest.update((bound,))

    def work(self, key, rows, state):
        book = self._open()
        for r in rows:
            book.add_crossing(r["ts"], [r[c] for c in self.order], r)
        decided = book.settle([(r["ts"], r["ts"] + self.window) for r in rows])
        self._save(book)
        return [self._row(key[0], c["row"], c["found"], c["revision"]) for c in decided], None


def _known_at(made: pd.DataFrame, now: float) -> pd.DataFrame:
    # just ahead of the watermark, as nothing may be put out behind it
    return made.assign(event_time=pd.to_datetime(round(now * 1e3) + 1, unit="ms", utc=True))


def stream_access_decisions(
    crossings: DataFrame, scans: DataFrame, window: float, delay: str = "10 seconds", correct_seconds: float | None = None
) -> DataFrame:
    """``access_decisions`` on streams of crossing records and scans, by zone.

    A decision is made once the watermark is past the crossing by ``window``.
    Scans and crossings that come later than ``delay`` allows are too late to
    count, unless ``correct_seconds`` is given: then those at most so far behind
    the watermark still count, and every decision they change is put out again
    with the next ``revision`` (``latest_decisions`` takes the last ones). Rows
    still further behind come out with the kind ``too_late``, so none is lost
    unseen. State is kept for that time and a few windows.
    """
    no = lambda kind: F.lit(None).cast(kind)
    crossings, scans = _timed(crossings, delay), _timed(scans, delay)
    c = crossings.select(
        "event_time", "zone_id", "ts", F.lit("crossing").alias("kind"), "stream_id", "tripwire_id", "track_id", "frame_idx", "track_ord",
        "direction", no("string").alias("identity"), F.lit(0).cast("long").alias("arrival"))
    s = scans.select(
        "event_time", "zone_id", "ts", F.lit("scan").alias("kind"), no("string").alias("stream_id"), no("string").alias("tripwire_id"),
        F.lit(0).cast("long").alias("track_id"), F.lit(0).cast("long").alias("frame_idx"), F.lit(0).cast("long").alias("track_ord"),
        no("string").alias("direction"), "identity", "arrival")
    rows = c.unionByName(s)
    if correct_seconds is not None:
        # a computed time is no event time to Spark, which would drop late rows by it; the watermark moves on all the same
        rows = rows.withColumn("event_time", F.timestamp_micros(F.unix_micros("event_time")))
    return _run(
        rows, ["zone_id"], _Access(float(window), correct_seconds),
        "ts double, stream_id string, zone_id string, tripwire_id string, track_id bigint, frame_idx bigint, "
        "direction string, kind string, authorized boolean, scan_ts double, scan_identity string, revision int", delay)


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """Of the written output of ``stream_access_decisions`` the last revision of every decision; rows too late are left out."""
    key = ["zone_id", "stream_id", "tripwire_id", "track_id", "frame_idx", "ts"]
    values = [c for c in decisions.columns if c not in key]
    return (
        decisions.filter("kind <> 'too_late'").groupBy(*key)
        .agg(F.max_by(F.struct(*values), "revision").alias("__last")).select(*key, "__last.*")
    )


class _Boxes(InOrder):
    columns = ("frame_idx", "ts", "det_ord", "x1", "y1", "x2", "y2", "conf", "cls")
    order = ("frame_idx", "det_ord")

    def __init__(self, max_age: int, iou_threshold: float, idle_seconds: float | None):
        self.max_age, self.iou_threshold, self.idle_seconds = max_age, iou_threshold, idle_seconds

    def forget(self, state):
        return state and json.dumps({"live": [], "fresh": json.loads(state)["fresh"]})

    def work(self, key, rows, state):
        s = json.loads(state) if state else {"live": [], "fresh": 1}
        tracker = BoxTracker(self.max_age, self.iou_threshold, s["live"], s["fresh"])
        out = []
        for frame_idx, group in _by_frame(rows):
            seen = [r for r in group if r["det_ord"] >= 0]
            ids = tracker.frame([(r["x1"], r["y1"], r["x2"], r["y2"]) for r in seen])
            out += [{"stream_id": key[0], **{c: r[c] for c in self.columns}, "track_id": t} for r, t in zip(seen, ids)]
        return out, json.dumps({"live": tracker.live, "fresh": tracker.fresh})


class _OwnBoxes(_Boxes):
    """As ``_Boxes``, with a user's tracker; the state is its snapshot, the ids of its tracks and the next id."""

    def __init__(self, make: MakeTracker, idle_seconds: float | None):
        self.make, self.idle_seconds = make, idle_seconds

    def forget(self, state):
        return state and json.dumps([None, [], json.loads(state)[2]])

    def work(self, key, rows, state):
        text, ids, begun = json.loads(state) if state else (None, [], 1)
        numbers = [begun]

        def new_id() -> int:
            numbers[0] += 1
            return numbers[0] - 1

        tracker = self.make(new_id)
        if text is not None:
            tracker.restore(text, ids)
        out = []
        for _, group in _by_frame(rows):
            seen = [r for r in group if r["det_ord"] >= 0]
            found = tracker.frame(group[0]["ts"], [tuple(r[c] for c in BOX_COLUMNS) for r in seen])
            out += [{"stream_id": key[0], **{c: r[c] for c in self.columns}, "track_id": t} for r, t in zip(seen, found)]
        text, ids = tracker.snapshot()
        return out, json.dumps([text, [int(i) for i in ids], numbers[0]])


def _by_frame(rows: list[dict]):
    group: list[dict] = []
    for r in rows:
        if group and r["frame_idx"] != group[0]["frame_idx"]:
            yield group[0]["frame_idx"], group
            group = []
        group.append(r)
    if group:
        yield group[0]["frame_idx"], group


def stream_iou_tracker(
    frames: DataFrame, detections: DataFrame, max_age: int = 30, iou_threshold: float = 0.20, delay: str = "10 seconds",
    idle_seconds: float | None = None,
) -> DataFrame:
    """``iou_tracker`` on streams of frames and detections, by camera.

    With ``idle_seconds`` a camera without frames for so long loses its tracks; its ids go on.
    """
    return _stream_boxes(frames, detections, _Boxes(max_age, iou_threshold, idle_seconds), delay)


def stream_tracker(
    frames: DataFrame, detections: DataFrame, make: MakeTracker, delay: str = "10 seconds", idle_seconds: float | None = None,
) -> DataFrame:
    """A user's ``FrameTracker`` on streams of frames and detections, by camera: the rows of ``stretched_tracker``.

    With ``idle_seconds`` a camera without frames for so long begins with a new tracker; its ids go on.
    """
    return _stream_boxes(frames, detections, _OwnBoxes(make, idle_seconds), delay)


def _stream_boxes(frames: DataFrame, detections: DataFrame, processor: InOrder, delay: str) -> DataFrame:
    boxes = ("x1", "y1", "x2", "y2", "conf")
    frames, detections = _timed(frames, delay), _timed(detections, delay)
    blank = frames.select(
        "event_time", "stream_id", "frame_idx", "ts", F.lit(-1).cast("long").alias("det_ord"),
        *[F.lit(0.0).alias(c) for c in boxes], F.lit(0).alias("cls"))
    found = detections.select("event_time", "stream_id", "frame_idx", "ts", "det_ord", *boxes, "cls")
    return _run(
        blank.unionByName(found), ["stream_id"], processor,
        "stream_id string, frame_idx bigint, ts double, det_ord bigint, x1 double, y1 double, x2 double, y2 double, "
        "conf double, cls int, track_id bigint", delay)


class _Switches(InOrder):
    columns = ("frame_idx", "ts", "track_ord", "track_id", "x", "y")
    order = ("frame_idx", "track_ord")
    # after a longer gap no position is young enough to be taken
    idle_seconds = max(G.SWITCH_MEMORY_SECONDS, G.SWITCH_SECONDS)

    def work(self, key, rows, state):
        detector = SwitchDetector(G.SWITCH_SECONDS, G.SWITCH_PX, G.SWITCH_MEMORY_SECONDS, json.loads(state) if state else [])
        out = []
        for frame_idx, group in _by_frame(rows):
            found = detector.frame(group[0]["ts"], [(r["track_id"], r["x"], r["y"]) for r in group])
            out += [
                {"stream_id": key[0], "frame_idx": frame_idx, "ts": group[0]["ts"], "ord": i, "from_track_id": a,
                 "to_track_id": b, "dx": dx, "dy": dy, "dt": dt} for i, (a, b, dx, dy, dt) in enumerate(found)
            ]
        return out, json.dumps([[k, *v] for k, v in detector.slots.items()])


def stream_id_switches(tracks: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """``id_switches`` on a stream of tracks, by camera."""
    centre = G.geometric_center(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    rows = _timed(tracks, delay).select(
        "event_time", "stream_id", "frame_idx", "ts", "track_ord", "track_id", centre["x"].alias("x"), centre["y"].alias("y"))
    return _run(
        rows, ["stream_id"], _Switches(),
        "stream_id string, frame_idx bigint, ts double, ord bigint, from_track_id bigint, to_track_id bigint, "
        "dx double, dy double, dt double", delay)
