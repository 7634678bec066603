"""One step of each stateful rule, as small functions on plain values.

A state is a JSON text, so that it can be kept in any state store.
"""

from __future__ import annotations

import bisect
import json
import math
from collections.abc import Callable

from paceline.functions.geometry import LINE_EPS


def side_change(prev: float, cur: float) -> str | None:
    if prev <= LINE_EPS < cur:
        return "left_to_right"
    if prev > LINE_EPS and cur <= -LINE_EPS:
        return "right_to_left"
    return None


def cross_wires(state: str | None, frame_idx: int, x: float, y: float, wires: list[dict]) -> tuple[str, list[tuple]]:
    """One sighting of one track: new state, and (tripwire_id, direction) of each counted crossing.

    State: last position, and where and when each wire was last counted.
    """
    memory = json.loads(state) if state else {"at": None, "counted": {}}
    out = []
    if memory["at"]:
        px, py = memory["at"]
        for w in wires:
            dx, dy = w["x2"] - w["x1"], w["y2"] - w["y1"]
            raw = side_change(dx * (py - w["y1"]) - dy * (px - w["x1"]), dx * (y - w["y1"]) - dy * (x - w["x1"]))
            if raw is None:
                continue
            last = memory["counted"].get(w["id"])
            if last and frame_idx - last[0] < w["frames"] and math.hypot(last[1] - x, last[2] - y) < w["px"]:
                continue
            memory["counted"][w["id"]] = [frame_idx, x, y]
            out.append((w["id"], "in" if raw == w["direction_in"] else "out"))
    memory["at"] = [x, y]
    # a count older than its wire's guard decides nothing any more
    guards = {w["id"]: w["frames"] for w in wires}
    memory["counted"] = {k: v for k, v in memory["counted"].items() if frame_idx - v[0] < guards.get(k, 0)}
    return json.dumps(memory), out


def crowd(state: str | None, ts: float, count: int, reset: bool, threshold: int, dwell: float, cooldown: float
          ) -> tuple[str, tuple | None]:
    """One count of one zone: new state, and (peak, dwell) if an alert is raised."""
    s = json.loads(state) if state else {"since": None, "peak": 0, "last": None, "fired": False}
    if reset:
        s["last"] = None
    if reset or count <= threshold:
        s.update(since=None, peak=0, fired=False)
        return json.dumps(s), None
    if s["since"] is None:
        s["since"] = ts
    s["peak"] = max(s["peak"], count)
    waited = ts - s["since"]
    if s["fired"] or waited < dwell or (s["last"] is not None and ts - s["last"] < cooldown):
        return json.dumps(s), None
    s.update(last=ts, fired=True)
    return json.dumps(s), (s["peak"], waited)


def cooled(state: str | None, ts: float, count: int, threshold: int, cooldown: float) -> tuple[str, bool]:
    last = json.loads(state) if state else 0.0
    fires = count > threshold and ts - last >= cooldown
    return json.dumps(ts if fires else last), fires


class AccessBook:
    """Scans and decided crossings of one zone, on pages of twice the access window each.

    ``load(page)`` gives the text that a store keeps of a page, or None. A window
    touches two pages at most, so a decision reads no more however many scans the
    zone has. A crossing tailgates if the one before it on its scan is within the
    window, so what a late row changes lies within a few windows around it.
    """

    def __init__(self, window: float, load: Callable[[int], str | None]):
        self.window, self.load = window, load
        self.pages: dict[int, dict] = {}
        self.changed: set[int] = set()

    def page_of(self, ts: float) -> int:
        return math.floor(ts / (2 * self.window))

    def page(self, number: int) -> dict:
        if number not in self.pages:
            text = self.load(number)
            self.pages[number] = json.loads(text) if text else {"scans": [], "crossings": []}
        return self.pages[number]

    def add_scan(self, ts: float, identity: str | None, arrival: int) -> bool:
        """Whether it is news: of scans at one time the last to arrive counts."""
        number = self.page_of(ts)
        scans = self.page(number)["scans"]
        at = bisect.bisect_left(scans, ts, key=lambda s: s[0])
        if at < len(scans) and scans[at][0] == ts:
            if arrival < scans[at][2]:
                return False
            scans[at] = [ts, identity, arrival]
        else:
            scans.insert(at, [ts, identity, arrival])
        self.changed.add(number)
        return True

    def add_crossing(self, ts: float, order: list, row: dict) -> None:
        number = self.page_of(ts)
        bisect.insort(self.page(number)["crossings"], {"ts": ts, "order": order, "row": row, "found": None, "revision": -1},
                      key=lambda c: c["order"])
        self.changed.add(number)

    def nearest(self, ts: float) -> list | None:
        near = []
        for number in range(self.page_of(ts - self.window), self.page_of(ts + self.window) + 1):
            scans = self.page(number)["scans"]
            at = bisect.bisect_left(scans, ts, key=lambda s: s[0])
            near += [s for s in scans[max(at - 1, 0):at + 1] if ts - self.window <= s[0] <= ts + self.window]
        return min(near, key=lambda s: (abs(s[0] - ts), s[0]), default=None)

    def settle(self, spans: list[tuple[float, float]]) -> list[dict]:
        """Decide the crossings within ``spans`` (again); those whose decision is new or has changed."""
        out = []
        for lo, hi in merged(spans):
            last: dict[float, float] = {}
            for number in range(self.page_of(lo - self.window), self.page_of(hi) + 1):
                for c in self.page(number)["crossings"]:
                    if not lo - self.window <= c["ts"] <= hi:
                        continue
                    if c["ts"] >= lo:
                        scan = self.nearest(c["ts"])
                        if scan is None:
                            found = ["unmatched", None, None]
                        else:
                            behind = scan[0] in last and abs(last[scan[0]] - c["ts"]) <= self.window
                            found = ["tailgating" if behind else "authorized", scan[0], scan[1]]
                        if found != c["found"]:
                            c.update(found=found, revision=c["revision"] + 1)
                            self.changed.add(number)
                            out.append(c)
                    if c["found"] and c["found"][1] is not None:
                        last[c["found"][1]] = c["ts"]
        return out


def merged(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out
