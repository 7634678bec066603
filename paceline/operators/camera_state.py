"""The two state machines that need every row of a camera in order: the box tracker and the id-switch detector.

A camera is cut into stretches of frames that run as separate grouped tasks.
What state a stretch begins with is first *guessed* from the frames just before
it, then all stretches run once from the guessed states, and a stretch whose
guess was not the state its predecessor really ended in runs again, with those
behind it for as long as its new end is not what they began with. The rows that
come out are those of one pass in order; the work is about one pass, as both
machines mostly forget within seconds. Only what has to run again is written again.
"""

from __future__ import annotations

import itertools
import json
import logging
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.functions import geometry as G
from paceline.operators import stretches as S
from paceline.session import cut_lineage, release

STRETCH = ["stream_id", "__stretch"]
# Frames per grouped task: minutes of video, some hundred thousand rows. What is repaired may take in some stretches.
FRAMES_PER_TASK, FRAMES_PER_REPAIR = 5_000, 20_000
_RUN = (
    "stream_id string, __stretch bigint, __end boolean, __entry string, __state string, __refs array<bigint>, "
    "__fresh bigint, __tied boolean, "
)
Step = Callable[[pd.DataFrame, str], pd.DataFrame]


def _before(column: str) -> Column:
    return F.lag(column).over(Window.partitionBy("stream_id").orderBy("__stretch"))


def _one(step: Step, pdf: pd.DataFrame, entry: str | None) -> pd.DataFrame:
    """The rows of one stretch run from the state ``entry``, and its end."""
    out = step(pdf, entry if isinstance(entry, str) else "[]")
    out["stream_id"], out["__stretch"] = pdf["stream_id"].iloc[0], pdf["__stretch"].iloc[0]
    begun = [None] * len(out)
    begun[-1] = entry if isinstance(entry, str) else None
    out["__entry"] = pd.Series(begun, dtype=object)
    return out


def _nothing(ddl: str) -> pd.DataFrame:
    """No rows of these columns, for tasks to put out; made by the driver."""
    return pd.DataFrame({f.name: pd.Series(dtype=object) for f in T.StructType.fromDDL(ddl).fields})


def _run_all(rows: DataFrame, entries: DataFrame, step: Step, out_ddl: str) -> DataFrame:
    """``step`` over the stretches that ``entries`` lists, each with its state, which travels once per stretch."""
    ddl = _RUN + out_ddl
    nothing = _nothing(ddl)

    def task(pdf: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        return _one(step, pdf, begin["__entry"].iloc[0]) if len(begin) and len(pdf) else nothing

    # long work on few bytes: as many tasks as there are partitions, which bytes alone would not give
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *STRETCH).groupBy(*STRETCH).cogroup(entries.groupBy(*STRETCH)).applyInPandas(task, ddl)


def _run_on(rows: DataFrame, ends: DataFrame, step: Step, out_ddl: str) -> DataFrame:
    """``step`` over stretches that began with a wrong state, and on over those behind that this makes wrong as well.

    Rows and ``ends`` (``__entry`` it had, ``__tied``, ``__refs``, ``__new`` or null,
    whether it is the camera's ``__first``) come by ``__block``, some stretches long.
    The work stops where the end of a stretch is what the next one had begun with,
    and at the end of a block. The order of tracks is known from the camera's first
    stretch on, or from one that was told, and goes along with what is not run again.
    """
    ddl = _RUN + out_ddl
    nothing = _nothing(ddl)

    def task(pdf: pd.DataFrame, had: pd.DataFrame) -> pd.DataFrame:
        had = had.sort_values("__stretch")
        found, handed, order = [], None, "[]" if had["__first"].iloc[0] else None
        of = dict(list(pdf.groupby("__stretch")))
        had = had[["__stretch", "__entry", "__tied", "__refs", "__new"]]
        for had_stretch, entry, tied, refs, new in had.itertuples(index=False):
            had_state, _, had_order = (entry if isinstance(entry, str) else "[]").partition(RANKED)
            if handed is not None:
                new = handed if handed != had_state else None
            if order is None and isinstance(new, str):
                order = new.partition(RANKED)[2] or None
            # the same tracks in another order: it matters only where it decided something
            if not isinstance(new, str) and tied and order and order != (had_order or _as_sorted(had_state)):
                new = had_state
            if not isinstance(new, str):
                handed, order = None, order and refs is not None and _order_after(order, refs)
                continue
            out = _one(step, of[had_stretch], new.partition(RANKED)[0] + (RANKED + order if order else ""))
            handed, refs = out["__state"].iloc[-1], out["__refs"].iloc[-1]
            order = order and refs is not None and _order_after(order, refs)
            found.append(out)
        return pd.concat(found, ignore_index=True) if found else nothing

    block = ["stream_id", "__block"]
    return rows.groupBy(*block).cogroup(ends.groupBy(*block)).applyInPandas(task, ddl)


class _Runs:
    """What all stretches put out: the first run of each, less what was run again, and the later runs."""

    def __init__(self, rows: DataFrame, entries: DataFrame, step: Step, out_ddl: str, stretches_per_repair: int):
        self.rows, self.step, self.out_ddl = rows, step, out_ddl
        self.block = F.floor(F.col("__stretch") / F.lit(stretches_per_repair)).alias("__block")
        begun = cut_lineage(entries, narrow=True)
        self.now = cut_lineage(_run_all(rows, begun, step, out_ddl))
        release(begun)
        self.rounds = 1

    def again(self, wrong: DataFrame) -> None:
        """Run the stretches of ``wrong`` (a written table) again with the states it has, and what that makes wrong."""
        ends = cut_lineage(self.ends().select(
            *STRETCH, "__entry", "__tied", "__refs", self.block, _before("__stretch").isNull().alias("__first")).join(
            wrong.select(*STRETCH, F.coalesce("__entry", F.lit("[]")).alias("__new")), STRETCH, "left"), narrow=True)
        first = ends.filter("__new is not null or __tied").groupBy("stream_id", "__block").agg(F.min("__stretch").alias("__from"))
        open_ = ends.filter("__new is not null").select(F.col("stream_id").alias("__s"), F.col("__block").alias("__b")).distinct()
        first = first.join(open_, (F.col("stream_id") == F.col("__s")) & (F.col("__block") == F.col("__b")), "left_semi")
        rows = self.rows.select("*", self.block).join(first, ["stream_id", "__block"]).filter("__stretch >= __from")
        redone = cut_lineage(_run_on(rows.drop("__from"), ends, self.step, self.out_ddl))
        release(ends)
        keys = redone.filter("__end").select(*STRETCH)
        self.now = self.now.join(keys, STRETCH, "left_anti").unionByName(redone)
        self.rounds += 1

    def ends(self) -> DataFrame:
        return self.now.filter("__end")

    def settle(self) -> None:
        """Run again, all at once, what did not begin with the state the stretch before ended in, until nothing is wrong."""
        none = F.lit("[]")
        while True:
            wrong = cut_lineage(
                self.ends().select(*STRETCH, "__entry", F.coalesce(_before("__state"), none).alias("__true"))
                .filter(~F.col("__true").eqNullSafe(F.coalesce(_state_of("__entry"), none)))
                .select(*STRETCH, F.col("__true").alias("__entry")), narrow=True)
            if not wrong.isEmpty():
                self.again(wrong)
                release(wrong)
                continue
            release(wrong)
            return


def _state_of(entry: str) -> Column:
    """The state in an entry: all of it, or what stands before the mark behind which an order of tracks is given."""
    return F.split(F.col(entry), RANKED)[0]


RANKED = ";"


def _as_sorted(state: str) -> str:
    """The order of a state's tracks that is that of the state itself."""
    return _order(list(range(1, len(json.loads(state)) + 1)))


def _order(ranks: list[int]) -> str:
    return json.dumps(ranks, separators=(",", ":"))


def _order_after(order: str, refs: list[int]) -> str:
    """The order of the tracks that a stretch ends with, from that in which it began: new ones come behind all others."""
    before = json.loads(order)
    made = [(0, before[-r - 1]) if r < 0 else (1, r) for r in map(int, refs)]
    place = {m: k for k, m in enumerate(sorted(made), 1)}
    return _order([place[m] for m in made])


def per_repair(frames_per_stretch: int) -> int:
    return max(1, FRAMES_PER_REPAIR // frames_per_stretch)


def _guessed(
    rows: DataFrame, parts: DataFrame, warm_up: Column, step: Step, out_ddl: str, stretches_per_repair: int,
    guess_step: Step | None = None,
) -> _Runs:
    """All stretches, run from states guessed from the rows of the stretch before that ``warm_up`` marks, and settled."""
    feeding = parts.select(*STRETCH, F.lead("__stretch").over(
        Window.partitionBy("stream_id").orderBy("__stretch")).alias("__following"))
    none = F.lit(None).cast("string")
    guesses = _run_all(
        rows.filter(warm_up),
        feeding.filter("__following is not null").select(*STRETCH, none.alias("__entry")),
        guess_step or step, out_ddl,
    ).filter("__end").select(*STRETCH, F.col("__state").alias("__guess"))
    entries = feeding.join(guesses, STRETCH, "left").select(*STRETCH, _before("__guess").alias("__entry"))
    runs = _Runs(rows, entries, step, out_ddl, stretches_per_repair)
    runs.settle()
    return runs


# --------------------------------------------------------------------------- tracker


class BoxTracker:
    """Greedy overlap matching, one frame at a time.

    Live tracks are kept in the order they were made: ``[ref, x1, y1, x2, y2, age]``.
    ``ref`` is whatever names the track for the caller; new ones get 0, 1, 2, ...
    ``tied`` tells whether of two tracks with a negative ref one was taken only
    because it stood first.
    """

    def __init__(self, max_age: int, iou_threshold: float, live: list[list] | None = None, fresh: int = 0):
        self.max_age, self.iou_threshold = max_age, iou_threshold
        self.live = live or []
        self.fresh = fresh
        self.tied = False

    def frame(self, boxes: list[tuple[float, float, float, float]]) -> list[int]:
        """The ref of every box of this frame, in the order given."""
        for track in self.live:
            track[5] += 1
        self.live = [t for t in self.live if t[5] <= self.max_age]
        refs: list[int | None] = [None] * len(boxes)
        if boxes and self.live:
            overlaps = _overlaps(np.array([t[1:5] for t in self.live], np.float64), np.array(boxes, np.float64))
            overlaps[~(overlaps > self.iou_threshold)] = 0.0
            for i, box in enumerate(boxes):
                own = overlaps[:, i]
                at = int(own.argmax())
                if own[at] <= 0.0:
                    continue
                taken = self.live[at]
                if taken[0] < 0 and any(self.live[k][0] < 0 for k in np.flatnonzero(own == own[at]) if k != at):
                    self.tied = True
                taken[1:6] = [*box, 0]
                refs[i] = taken[0]
                overlaps[at] = 0.0
        for i, box in enumerate(boxes):
            if refs[i] is None:
                refs[i] = self.fresh
                self.live.append([self.fresh, *box, 0])
                self.fresh += 1
        return refs


def _overlaps(tracks: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Overlap of each track (rows) with each box."""
    a, b = tracks[:, None, :], boxes[None, :, :]
    w = np.maximum(0.0, np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0]))
    h = np.maximum(0.0, np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1]))
    inter = w * h
    union = (a[..., 2] - a[..., 0]) * (a[..., 3] - a[..., 1]) + (b[..., 2] - b[..., 0]) * (b[..., 3] - b[..., 1]) - inter
    return inter / (union + G.IOU_EPS)


def _frames_of(pdf: pd.DataFrame, order: str, columns: list[str]):
    """(frame_idx, ts, rows) per frame of ``pdf``, which is in order; rows are tuples of ``columns``.

    A frame without objects has no rows.
    """
    frame_no = pdf["frame_idx"].to_numpy()
    starts = [0, *(np.flatnonzero(np.diff(frame_no)) + 1).tolist(), len(pdf)]
    times = pdf["ts"].tolist()
    filled = pdf[order].notna().tolist()
    rows = list(zip(*[pdf[c].tolist() for c in columns]))
    for a, b in zip(starts, starts[1:]):
        yield int(frame_no[a]), times[a], [rows[i] for i in range(a, b) if filled[i]]


_PASSED_ON = ["frame_idx", "ts", "det_ord", "det_id", "x1", "y1", "x2", "y2", "conf", "cls"]
BOX_COLUMNS = ("x1", "y1", "x2", "y2", "conf", "cls")
_WHOLE = ("frame_idx", "det_ord", "det_id", "cls", "ref", "ord", "from_track_id", "to_track_id")
_TRACKER_DDL = (
    "frame_idx bigint, ts double, det_ord bigint, det_id bigint, x1 double, y1 double, x2 double, y2 double, "
    "conf double, cls int, ref bigint"
)


def _with_end(rows: pd.DataFrame, end: dict) -> pd.DataFrame:
    """The rows of a stretch and, last, the row that tells the state it ends in."""
    for c in rows.columns.intersection(_WHOLE):
        rows[c] = rows[c].astype("Int64")
    rows["__end"] = False
    closing = pd.DataFrame({"__end": [True], **{k: [v] for k, v in end.items()}})
    out = pd.concat([rows, closing], ignore_index=True)
    for c in ("__state", "__refs"):
        values = out[c] if c in out else [None] * len(out)
        out[c] = pd.Series([v if isinstance(v, (str, list)) else None for v in values], dtype=object)
    if "__tied" not in out:
        out["__tied"] = None
    out["__fresh"] = out["__fresh"].astype("Int64") if "__fresh" in out else pd.array([pd.NA] * len(out), "Int64")
    return out


def _tracker_step(max_age: int, iou_threshold: float):
    """One stretch. States are sets: tracks sorted by box and age, named -1, -2, ... by that order where they come in.

    In which order they were made only matters where overlaps are exactly
    equal. An entry may give that order behind ``RANKED``, as a number for each
    track; one that does not is taken in the sorted order, and ``__tied`` tells if
    that decided anything.
    """

    def step(pdf: pd.DataFrame, entry: str) -> pd.DataFrame:
        state, _, ranks = entry.partition(RANKED)
        live = [[-(i + 1), *track] for i, track in enumerate(json.loads(state))]
        if ranks:
            order = json.loads(ranks)
            live.sort(key=lambda t: order[-t[0] - 1])
        tracker = BoxTracker(max_age, iou_threshold, live)
        pdf = pdf.sort_values(["frame_idx", "det_ord"], kind="stable")
        refs: list[int] = []
        for _, _, boxes in _frames_of(pdf, "det_ord", ["x1", "y1", "x2", "y2"]):
            refs += tracker.frame(boxes)
        rows = pdf.loc[pdf["det_ord"].notna(), _PASSED_ON].reset_index(drop=True)
        rows["ref"] = pd.Series(refs, dtype="Int64")
        ends = sorted(tracker.live, key=lambda t: t[1:6])
        return _with_end(rows, {
            "__state": json.dumps([[float(v) for v in t[1:5]] + [int(t[5])] for t in ends]),
            "__refs": [int(t[0]) for t in ends], "__fresh": tracker.fresh, "__tied": tracker.tied,
        })

    return step


def _ranked(runs: _Runs, names: _track_names) -> DataFrame:
    """Stretches in which the order of incoming tracks decided something and was not the order they were made in."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("ref")).alias("at"), "__id"))), lambda t: t["__id"])
    numbers = names.incoming.groupBy(*STRETCH).agg(ids.alias("__ids")).withColumn(
        "__ranks", F.transform("__ids", lambda i: F.array_position(F.sort_array("__ids"), i)))
    return (
        runs.ends().filter("__tied").select(*STRETCH, "__entry").join(numbers, STRETCH)
        .select(*STRETCH, F.concat(_state_of("__entry"), F.lit(RANKED), F.to_json("__ranks")).alias("__ordered"), "__entry",
                F.to_json(F.sort_array("__ids")).eqNullSafe(F.to_json("__ids")).alias("__as_sorted"))
        .filter((F.col("__ordered") != F.col("__entry")) & ~(F.col("__as_sorted") & ~F.col("__entry").contains(RANKED)))
        .select(*STRETCH, F.col("__ordered").alias("__entry"))
    )


def iou_tracker(
    frames: DataFrame, detections: DataFrame, max_age: int = 30, iou_threshold: float = 0.20,
    frames_per_stretch: int = FRAMES_PER_TASK, warm_up_frames: int | None = None,
) -> DataFrame:
    """Detections with a ``track_id``, per camera, 1, 2, 3, ... in order of first sight.

    Each detection, in order, takes the free track it overlaps most (more than
    ``iou_threshold``; on a tie the older track). The rest become new tracks. A
    track unseen for more than ``max_age`` frames is gone; frames without
    detections count, so ``frames`` has to list them all.
    """
    return _numbered(*_tracked(frames, detections, max_age, iou_threshold, frames_per_stretch, warm_up_frames))


def _numbered(runs: _Runs, names: _track_names) -> DataFrame:
    """The detections of all stretches with the numbers of their tracks."""
    found = runs.now.filter("not __end").select(*STRETCH, *_PASSED_ON, "ref")
    return (
        found.join(names.offsets, STRETCH)
        .join(names.incoming, [*STRETCH, "ref"], "left")
        .select(
            "stream_id", *_PASSED_ON,
            F.when(F.col("ref") >= 0, F.col("__offset") + F.col("ref") + 1).otherwise(F.col("__id")).alias("track_id"),
        )
    )


def _tracked(
    frames: DataFrame, detections: DataFrame, max_age: int, iou_threshold: float, frames_per_stretch: int,
    warm_up_frames: int | None,
) -> tuple[_Runs, _track_names]:
    warm = warm_up_frames if warm_up_frames is not None else 5 * max_age
    runs = _tracker_runs(frames, detections, _tracker_step(max_age, iou_threshold), frames_per_stretch, warm)
    while True:
        names = _track_names(runs.ends().select(*STRETCH, "__refs", "__fresh"))
        wrong = cut_lineage(_ranked(runs, names))
        if wrong.isEmpty():
            release(wrong)
            return runs, names
        runs.again(wrong)
        runs.settle()


def _tracker_runs(frames: DataFrame, detections: DataFrame, step: Step, frames_per_stretch: int, warm_up_frames: int) -> _Runs:
    boxes = detections.select("stream_id", *[c for c in _PASSED_ON if c != "ts"])
    # frames and boxes are put together once; every round reads the written rows
    rows = cut_lineage(
        frames.select("stream_id", "frame_idx", "ts").join(boxes, ["stream_id", "frame_idx"], "left").withColumn(
            "__stretch", S.by_frames(F.col("frame_idx"), frames_per_stretch)))
    warm = min(warm_up_frames, frames_per_stretch)
    near_end = F.pmod(F.col("frame_idx"), F.lit(frames_per_stretch)) >= F.lit(frames_per_stretch - warm)
    parts = rows.select(*STRETCH).distinct()
    return _guessed(rows, parts, near_end, step, _TRACKER_DDL, per_repair(frames_per_stretch))


class _track_names:  # noqa: N801
    """Numbers of tracks from the ends of stretches.

    ``offsets``: how many tracks were made before a stretch. ``incoming``: the
    number of each track a stretch begins with, found by following it back to
    the stretch that made it, in steps that double.
    """

    def __init__(self, ends: DataFrame):
        along = Window.partitionBy("stream_id").orderBy("__stretch")
        before = along.rowsBetween(Window.unboundedPreceding, -1)
        base = cut_lineage(ends.select(
            *STRETCH, "__refs", F.lag("__stretch").over(along).alias("__prev"),
            F.lag("__refs").over(along).alias("__prev_refs"),
            F.coalesce(F.sum("__fresh").over(before), F.lit(0)).alias("__offset"),
            F.coalesce(F.sum("__fresh").over(before.rowsBetween(Window.unboundedPreceding, -2)), F.lit(0))
            .alias("__prev_offset"),
        ))
        self.offsets = base.select(*STRETCH, "__offset")
        links = base.filter("__prev is not null").select(
            F.col("stream_id").alias("i_stream"), F.col("__stretch").alias("i_stretch"),
            F.col("__prev").alias("at"), "__prev_offset", F.posexplode("__prev_refs").alias("pos", "__ref"),
        ).select(
            "i_stream", "i_stretch", (-F.col("pos") - 1).cast("long").alias("i_ref"),
            F.when(F.col("__ref") >= 0, F.col("__prev_offset") + F.col("__ref") + 1).alias("i_id"),
            F.when(F.col("__ref") < 0, F.col("at")).alias("at"),
            F.when(F.col("__ref") < 0, F.col("__ref")).alias("at_ref"),
        )
        links = cut_lineage(links)
        while not links.filter("i_id is null").isEmpty():
            onward = links.select(
                F.col("i_stream").alias("o_stream"), F.col("i_stretch").alias("o_stretch"),
                F.col("i_ref").alias("o_ref"), F.col("i_id").alias("o_id"), F.col("at").alias("o_at"),
                F.col("at_ref").alias("o_at_ref"),
            )
            links = cut_lineage(
                links.join(
                    onward,
                    (F.col("i_stream") == F.col("o_stream")) & (F.col("at") == F.col("o_stretch"))
                    & (F.col("at_ref") == F.col("o_ref")), "left",
                ).select(
                    "i_stream", "i_stretch", "i_ref", F.coalesce("i_id", "o_id").alias("i_id"),
                    F.when(F.col("i_id").isNull() & F.col("o_id").isNull(), F.col("o_at")).alias("at"),
                    F.when(F.col("i_id").isNull() & F.col("o_id").isNull(), F.col("o_at_ref")).alias("at_ref"),
                )
            )
        self.incoming = links.select(
            F.col("i_stream").alias("stream_id"), F.col("i_stretch").alias("__stretch"),
            F.col("i_ref").alias("ref"), F.col("i_id").alias("__id"),
        )


# From frames and detections to detections with a track_id.
TrackerFn = Callable[[DataFrame, DataFrame], DataFrame]


class FrameTracker(Protocol):
    """A user's own tracker, frame by frame, whose state can be put down and taken up again.

    It is made by ``make(new_id)`` and calls ``new_id()`` for each track that it
    numbers, in order. Ids only name tracks: what the tracker does must not depend
    on their values.
    """

    def frame(self, ts: float, boxes: list[tuple]) -> list[int | None]:
        """The id of every box ``(x1, y1, x2, y2, conf, cls)``, None where it belongs to no numbered track. Frames may be empty."""

    def snapshot(self) -> tuple[str, list[int]]:
        """The whole state as text, in which a numbered track stands as its place in a list, and that list of ids.

        Two trackers that go on alike should have equal texts: the sooner a state
        forgets what it began with, the less is run twice.
        """

    def restore(self, state: str, ids: list[int]) -> None:
        """Take up a state that ``snapshot`` put down, with these ids for its tracks."""


MakeTracker = Callable[[Callable[[], int]], FrameTracker]


def _packed_state(state: str, tracks: int) -> str:
    """A user's state and its number of tracks, without the mark that an order of tracks stands behind."""
    return json.dumps([state, tracks]).replace(RANKED, f"\\u{ord(RANKED):04x}")


def _protocol_step(make: MakeTracker) -> Step:
    """One stretch of a user's tracker: tracks that come in are called -1, -2, ... and new ones 0, 1, 2, ..."""

    def step(pdf: pd.DataFrame, entry: str) -> pd.DataFrame:
        numbers = itertools.count()
        made: list[int] = []

        def new_id() -> int:
            made.append(next(numbers))
            return made[-1]

        tracker = make(new_id)
        begun = json.loads(entry.partition(RANKED)[0])
        if begun:
            state, n = begun
            tracker.restore(state, [-k - 1 for k in range(n)])
        pdf = pdf.sort_values(["frame_idx", "det_ord"], kind="stable")
        refs: list[int | None] = []
        for _, ts, boxes in _frames_of(pdf, "det_ord", list(BOX_COLUMNS)):
            refs += tracker.frame(ts, boxes)
        rows = pdf.loc[pdf["det_ord"].notna(), _PASSED_ON].reset_index(drop=True)
        rows["ref"] = pd.Series(refs, dtype="Int64")
        state, ids = tracker.snapshot()
        return _with_end(rows, {
            "__state": _packed_state(state, len(ids)), "__refs": [int(i) for i in ids], "__fresh": len(made), "__tied": False,
        })

    return step


def stretched_tracker(
    make: MakeTracker, frames_per_stretch: int = FRAMES_PER_TASK, warm_up_frames: int = 150,
) -> TrackerFn:
    """A user's ``FrameTracker`` as a tracker for ``run_tracker``, run in stretches as the box tracker is.

    Per camera, the result is that of one tracker over all frames in order, with
    ids 1, 2, 3, ... as it asked for them; boxes it gave no id have a null
    ``track_id``. A stretch begins from the state that ``warm_up_frames`` before it
    lead to and is run again if that was not the true one. No detections give no
    rows; a camera without frames gives none either.
    """

    def track(frames: DataFrame, detections: DataFrame) -> DataFrame:
        runs = _tracker_runs(frames, detections, _protocol_step(make), frames_per_stretch, warm_up_frames)
        return _numbered(runs, _track_names(runs.ends().select(*STRETCH, "__refs", "__fresh")))

    return track


class OverlapTracker:
    """The box tracker as a ``FrameTracker``: a pattern for trackers of one's own."""

    def __init__(self, new_id: Callable[[], int], max_age: int = 30, iou_threshold: float = 0.20):
        self.new_id, self.boxes, self.ids = new_id, BoxTracker(max_age, iou_threshold), {}

    def frame(self, ts: float, boxes: list[tuple]) -> list[int | None]:
        refs = self.boxes.frame([b[:4] for b in boxes])
        for ref in refs:
            if ref not in self.ids:
                self.ids[ref] = self.new_id()
        found = [self.ids[ref] for ref in refs]
        self.ids = {t[0]: self.ids[t[0]] for t in self.boxes.live}
        return found

    def snapshot(self) -> tuple[str, list[int]]:
        return json.dumps([t[1:] for t in self.boxes.live]), [self.ids[t[0]] for t in self.boxes.live]

    def restore(self, state: str, ids: list[int]) -> None:
        live = [[k, *t] for k, t in enumerate(json.loads(state))]
        self.boxes = BoxTracker(self.boxes.max_age, self.boxes.iou_threshold, live, fresh=len(live))
        self.ids = dict(enumerate(ids))


def index_tracker(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """A stand-in for tests: the track id is the place of the detection in its frame, from 0."""
    place = F.row_number().over(Window.partitionBy("stream_id", "frame_idx").orderBy("det_ord")) - 1
    return detections.withColumn("track_id", place.cast("long"))


# The two configurable names stand for third-party trackers, in whose place the box tracker works; a log entry says so.
TRACKERS: dict[str, TrackerFn] = {"bytetrack": iou_tracker, "botsort": iou_tracker, "index": index_tracker}


def run_tracker(
    frames: DataFrame, detections: DataFrame, tracker_type: str = "bytetrack", trackers: dict[str, TrackerFn] | None = None
) -> DataFrame:
    """Track with the tracker of that name, from ``trackers`` (a user's own) or the known ones."""
    known = {**TRACKERS, **(trackers or {})}
    name = tracker_type.lower().strip()
    if name not in known:
        raise ValueError(f"unknown tracker_type: {tracker_type!r}")
    if known[name] is iou_tracker:
        logging.getLogger(__name__).info("tracker %s: the box tracker is used in its place", name)
    return known[name](frames, detections)


# --------------------------------------------------------------------------- id switches


class SwitchDetector:
    """Last position of every id lately seen, in the order the ids were (re)entered."""

    def __init__(self, seconds: float, px: float, memory: float, slots: list[list] | None = None):
        self.seconds, self.limit, self.memory = seconds, px * px, memory
        self.slots: dict[int, list[float]] = {int(s[0]): s[1:] for s in (slots or [])}

    def frame(self, now: float, people: list[tuple[int, float, float]]) -> list[tuple]:
        """(from, to, dx, dy, dt) of each switch; ``people`` are (track_id, x, y) in list order."""
        switches = []
        for track_id, x, y in people:
            for other, (px, py, at) in self.slots.items():
                near = (x - px) * (x - px) + (y - py) * (y - py) <= self.limit
                if other != track_id and now - at <= self.seconds and near:
                    switches.append((other, track_id, x - px, y - py, now - at))
                    del self.slots[other]
                    break
        if people:
            for track_id, x, y in people:
                self.slots[track_id] = [x, y, now]
            self.slots = {k: v for k, v in self.slots.items() if now - v[2] <= self.memory}
        return switches


_SWITCH_DDL = (
    "frame_idx bigint, ts double, ord bigint, from_track_id bigint, to_track_id bigint, "
    "dx double, dy double, dt double"
)


def _switch_step(seconds: float, px: float, memory: float, by_streak: bool = False):
    def step(pdf: pd.DataFrame, entry: str) -> pd.DataFrame:
        detector = SwitchDetector(seconds, px, memory, json.loads(entry))
        entered: dict[int, tuple] = {}
        rows = []
        pdf = pdf.sort_values(["frame_idx", "track_ord"], kind="stable")
        for frame_idx, ts, people in _frames_of(pdf, "track_ord", ["track_id", "x", "y", "__since", "__since_ord"]):
            if by_streak:
                entered.update({p[0]: p[3:] for p in people})
            found = detector.frame(ts, [p[:3] for p in people])
            rows += [(frame_idx, ts, i, *map(float, s)) for i, s in enumerate(found)]
        slots = list(detector.slots.items())
        if by_streak:
            slots.sort(key=lambda kv: entered[kv[0]])
        out = pd.DataFrame(
            rows, columns=["frame_idx", "ts", "ord", "from_track_id", "to_track_id", "dx", "dy", "dt"]
        )
        return _with_end(out, {"__state": json.dumps([[k, *map(float, v)] for k, v in slots])})

    return step


def id_switches(
    tracks: DataFrame, seconds: float = G.SWITCH_SECONDS, px: float = G.SWITCH_PX,
    memory_seconds: float = G.SWITCH_MEMORY_SECONDS, frames_per_stretch: int = FRAMES_PER_TASK,
    warm_up_frames: int = 300,
) -> DataFrame:
    """Hand-offs of a person from one id to another.

    A track that shows up within ``px`` of where another id was at most
    ``seconds`` ago takes that id's place, which is then free and cannot be
    taken again until the id comes back. One switch per track and frame, the
    id longest in memory first.
    """
    centre = G.geometric_center(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    seen = tracks.select(
        "stream_id", "frame_idx", "ts", "track_ord", "track_id", centre["x"].alias("x"), centre["y"].alias("y")
    )
    stretch = S.by_frames(F.col("frame_idx"), frames_per_stretch)
    # since when an id has been in memory, but for ids that were taken: good enough to guess with
    key, order = ["stream_id", "track_id"], ["frame_idx", "track_ord"]
    back = S.previous_row(seen, key, order, ["ts"], stretch, "__last_seen")
    fresh = F.col("__last_seen").isNull() | (F.col("ts") - F.col("__last_seen.ts") > F.lit(memory_seconds))
    streaks = S.last_known(back, key, order, F.when(fresh, S.at(order)), stretch, "__streak")
    rows = cut_lineage(streaks.select(
        *seen.columns, F.col("__streak.frame_idx").alias("__since"), F.col("__streak.track_ord").alias("__since_ord"),
        stretch.alias("__stretch"),
    ))
    near_end = F.pmod(F.col("frame_idx"), F.lit(frames_per_stretch)) >= F.lit(frames_per_stretch - warm_up_frames)
    runs = _guessed(
        rows, rows.select(*STRETCH).distinct(), near_end, _switch_step(seconds, px, memory_seconds), _SWITCH_DDL,
        per_repair(frames_per_stretch), _switch_step(seconds, px, memory_seconds, by_streak=True),
    )
    return runs.now.filter("not __end").select(
        "stream_id", "frame_idx", "ts", "ord", "from_track_id", "to_track_id", "dx", "dy", "dt"
    )
