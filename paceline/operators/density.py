"""Crowd alerts: a zone that stays too full for too long."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.text import density_notes
from paceline.operators import stretches as S
from paceline.session import cut_lineage, release

ZONE = ["stream_id", "zone_id"]


def occupancy_snapshots(occupancy: DataFrame) -> DataFrame:
    """Zone counts as snapshots; entries without a zone or a count are left out."""
    return occupancy.filter("zone_id is not null and count is not null").select(
        F.col("ts").alias("timestamp"), "zone_id", F.col("count").cast("long").alias("count"), "stream_id"
    )


def constant_rule(occupancy: DataFrame, threshold: int, dwell_seconds: float, cooldown_seconds: float) -> DataFrame:
    """One rule for all cameras, as columns next to the counts."""
    if threshold <= 0:
        raise ValueError("threshold must be > 0")
    if dwell_seconds < 0 or cooldown_seconds < 0:
        raise ValueError("dwell_seconds and cooldown_seconds must be >= 0")
    return (
        occupancy.withColumn("threshold", F.lit(int(threshold)))
        .withColumn("dwell_required", F.lit(float(dwell_seconds)))
        .withColumn("cooldown", F.lit(float(cooldown_seconds)))
    )


def camera_rule(occupancy: DataFrame, cameras: DataFrame) -> DataFrame:
    """Each camera's own rule; a camera without a threshold raises no alerts."""
    rules = cameras.filter("max_density_threshold is not null").select(
        "stream_id", F.col("max_density_threshold").alias("threshold"),
        F.col("density_dwell_seconds").alias("dwell_required"),
        F.col("density_cooldown_seconds").alias("cooldown"),
    )
    return occupancy.join(rules, "stream_id")


def _above_rows(ruled: DataFrame, stretch: Column) -> DataFrame:
    """Rows above the threshold with ``run_start``, ``prev_ts`` and ``epoch`` (the reset they come after)."""
    has_reset = "reset" in ruled.columns
    named = [*ZONE, "ts", "count", "threshold", "dwell_required", "cooldown", *(["reset"] if has_reset else [])]
    ruled = ruled.select(*named)
    reset = F.coalesce(F.col("reset"), F.lit(False)) if has_reset else F.lit(False)
    rows = ruled.withColumn("__above", (F.col("count") > F.col("threshold")) & ~reset)
    order, never = ["ts"], F.lit(float("-inf"))
    if has_reset:
        # at one instant a reset comes before the count
        rows = rows.withColumn("__turn", F.when(reset, 0).otherwise(1))
        order = ["ts", "__turn"]
        rows = S.last_known(rows, ZONE, order, F.when(reset, F.col("ts")), stretch, "epoch").withColumn("epoch", F.coalesce("epoch", never))
    else:
        rows = rows.withColumn("epoch", never)
    # one pass in each stretch, and one small table of what it hands on: its last row, and the run that is open there
    part = [*ZONE, "__stretch"]
    inside = Window.partitionBy(*part).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__stretch", stretch).withColumn("__prev", F.lag(F.struct("__above", "ts")).over(inside))
    rows = cut_lineage(
        rows.withColumn("__start", F.last(F.when(F.col("__above") & ~F.col("__prev.__above"), F.col("ts")), True).over(upto))
        .withColumn("__broken", F.max(~F.col("__above")).over(upto)).withColumn("__first_ts", F.first("ts").over(upto)))
    ends = rows.groupBy(*part).agg(
        F.max_by(F.struct("__above", "ts", "__start", "__broken", "__first_ts"), S.at(order)).alias("e")).select(*part, "e.*")
    along = Window.partitionBy(*ZONE).orderBy("__stretch")
    handed = ends.withColumn("__before", F.lag(F.struct("__above", "ts")).over(along)).withColumn(
        "__opened", F.when(F.col("__broken"), F.struct(F.when(F.col("__above"), F.col("__start")).alias("at")))
        .when(~F.coalesce(F.col("__before.__above"), F.lit(False)), F.struct(F.coalesce("__start", "__first_ts").alias("at"))))
    carried = handed.select(*part, "__before", F.last("__opened", True).over(
        along.rowsBetween(Window.unboundedPreceding, -1)).alias("__open"))
    rows = rows.filter("__above").join(S.by_key(carried), part)
    goes_on = F.coalesce(F.col("__before.__above"), F.lit(False))
    rows = rows.withColumn("__prev", F.coalesce("__prev", "__before")).withColumn(
        "run_start", F.coalesce("__start", F.when(goes_on, F.col("__open.at")).otherwise(F.col("__first_ts"))))
    return (
        rows.withColumn("prev_ts", F.when(F.col("ts") > F.col("run_start"), F.col("__prev.ts")))
        .withColumn("dwell_seconds", F.col("ts") - F.col("run_start"))
        .drop("__above", "__prev", "__turn", "__start", "__broken", "__first_ts", "__before", "__open", "__stretch")
    )


def density_runs(ruled: DataFrame, seconds_per_stretch: float = S.SECONDS_PER_STRETCH) -> DataFrame:
    """Rows above the threshold with the run they belong to: its start, the time since, the peak so far."""
    stretch = S.by_seconds(F.col("ts"), seconds_per_stretch)
    rows = _above_rows(ruled, stretch)
    return S.running_max(rows, [*ZONE, "run_start"], ["ts"], F.col("count"), stretch, "peak").select(
        *ZONE, "ts", "count", "run_start", "dwell_seconds", "peak"
    )


def _may_fire(last, row, m):
    return (row["run_start"] != last["run_start"]) & (row["ts"] - last["ts"] >= row["cooldown"])


def density_alerts(ruled: DataFrame, seconds_per_stretch: float = S.SECONDS_PER_STRETCH) -> DataFrame:
    """At most one alert per run, at the first row that has dwelt long enough with the cooldown over.

    ``ruled`` has the counts of every frame (zeros included) and the rule's
    columns; rows with ``reset = true``, if there are any, end the run and
    forget the last alert. The last alert always lies before the run, so a run
    can fire no later than at its first row ``cooldown`` or ``dwell`` after its
    start; later rows of the run are left out before the rule is applied.
    """
    stretch = S.by_seconds(F.col("ts"), seconds_per_stretch)
    rows = _above_rows(ruled, stretch)
    rows = S.running_max(rows, [*ZONE, "run_start"], ["ts"], F.col("count"), stretch, "peak")
    latest = F.greatest("dwell_required", "cooldown")
    open_rows = rows.filter(
        (F.col("dwell_seconds") >= F.col("dwell_required"))
        & (
            (F.col("dwell_seconds") < latest)
            | F.coalesce(F.col("prev_ts") - F.col("run_start") < latest, F.lit(True))
        )
    )
    fired = S.accepted_rows(
        open_rows, [*ZONE, "epoch"], ["ts"], ["run_start", "dwell_seconds", "peak", "threshold", "cooldown"],
        stretch, _may_fire,
    )
    return fired.select(
        F.col("ts").alias("timestamp"), "stream_id", "zone_id", F.col("peak").alias("density_count"), "threshold",
        "dwell_seconds", density_notes(F.col("peak"), F.col("threshold"), F.col("dwell_seconds")).alias("notes"),
    )


def density_alert_rows(alerts: DataFrame) -> DataFrame:
    return alerts.select(
        "timestamp", "stream_id", "zone_id", F.col("density_count").cast("long").alias("density_count"),
        F.col("threshold").cast("int").alias("threshold"), "dwell_seconds", "notes",
    )


def _following(ts: np.ndarray, cooldown: float) -> np.ndarray:
    """For each of the rising times the place of the first one ``cooldown`` later; the length where there is none."""
    at = np.searchsorted(ts, ts + cooldown)
    while True:  # the rule is about differences, which round in another way than sums
        early = (at > 0) & (ts[np.maximum(at - 1, 0)] - ts >= cooldown)
        late = (at < len(ts)) & (ts[np.minimum(at, len(ts) - 1)] - ts < cooldown)
        if not (early | late).any():
            return at
        at = at - early + late


def _fired_from(ts: np.ndarray, first: int, following: np.ndarray) -> list[int]:
    places = []
    while first < len(ts):
        places.append(first)
        first = int(following[first])
    return places


def _exits(cooldown: float):
    """Per stretch: each row that can be the first to fire, and the last one that then does."""

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        ts = np.sort(pdf["ts"].to_numpy())
        following = _following(ts, cooldown)
        n = min(len(ts), int(following[0]) + 1)
        last = np.arange(n)
        while True:
            onward = following[last]
            move = onward < len(ts)
            if not move.any():
                break
            last = np.where(move, onward, last)
        return pd.DataFrame({
            "stream_id": pdf["stream_id"].iloc[0], "zone_id": pdf["zone_id"].iloc[0],
            "__stretch": pdf["__stretch"].iloc[0], "first": ts[:n], "exit": ts[last]})

    return task


def _firing(cooldown: float):
    def task(pdf: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("ts", ignore_index=True)
        places: list[int] = []
        if len(begin) and len(rows):
            ts = rows["ts"].to_numpy()
            first = int(np.searchsorted(ts, begin["first"].iloc[0]))
            places = _fired_from(ts, first, _following(ts, cooldown))
        return rows.loc[places, [*ZONE, "ts", "count"]]

    return task


def density_cooldown_alerts(
    occupancy: DataFrame, threshold: int = 8, cooldown_seconds: float = 10.0,
    seconds_per_stretch: float = S.SECONDS_PER_STRETCH,
) -> DataFrame:
    """The plain rule: above the threshold, and again every ``cooldown_seconds`` while it stays so.

    The clock starts at 0, as if an alert had been raised then. While a zone
    stays crowded each alert sets the time of the next, across any cut. Only a
    row within one cooldown of a stretch's start can be the first to fire in it,
    so each stretch is summed up by a small table: first to fire, last to fire.
    These tables are followed from the zone's first row in steps that double, so
    a zone that never empties takes as many rounds as its number of stretches has
    binary digits.
    """
    crowded = occupancy.filter(
        (F.col("count") > F.lit(int(threshold))) & (F.col("ts") >= F.lit(float(cooldown_seconds)))
    ).select(*ZONE, "ts", "count")
    if cooldown_seconds > 0:
        crowded = _every(crowded, float(cooldown_seconds), max(float(seconds_per_stretch), float(cooldown_seconds)))
    return crowded.select(
        F.col("ts").alias("timestamp"), "stream_id", "zone_id", F.col("count").alias("density_count"),
        F.lit(int(threshold)).alias("threshold"),
    )


def _every(crowded: DataFrame, cooldown: float, size: float) -> DataFrame:
    part = [*ZONE, "__stretch"]
    rows = cut_lineage(crowded.withColumn("__stretch", S.by_seconds(F.col("ts"), size)))
    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (*part, "ts", "count"))
    names = types.split(", ")
    nodes = cut_lineage(rows.groupBy(*part).applyInPandas(
        _exits(cooldown), ", ".join([*names[:3], "first double", "exit double"])))
    # a stretch is as long as the cooldown at least, so the next alert is in the next stretch with rows or opens the one after it
    along = Window.partitionBy(*ZONE).orderBy("__stretch")
    ahead = nodes.groupBy(*part).agg(F.sort_array(F.collect_list("first")).alias("__firsts")).select(
        *part, F.lead("__stretch").over(along).alias("__next"), F.lead("__firsts").over(along).alias("__next_firsts"),
        F.lead("__stretch", 2).over(along).alias("__then"), F.lead(F.col("__firsts")[0], 2).over(along).alias("__then_first"),
        F.row_number().over(along).alias("__nth"))
    fits = F.filter("__next_firsts", lambda t: t - F.col("exit") >= F.lit(cooldown))
    found = F.size(fits) > 0
    steps = nodes.join(S.by_key(ahead), part).select(
        *part, "first", F.when(found, F.col("__next")).otherwise(F.col("__then")).alias("to_stretch"),
        F.when(found, F.get(fits, F.lit(0))).otherwise(F.col("__then_first")).alias("to_first"), "__nth")
    jump = cut_lineage(steps.filter("to_stretch is not null").drop("__nth"))
    fired = cut_lineage(steps.filter("__nth = 1").groupBy(*part).agg(F.min("first").alias("first")))
    release(nodes)
    while not jump.isEmpty():
        onward = fired.join(S.by_key(jump), [*part, "first"]).select(
            *ZONE, F.col("to_stretch").alias("__stretch"), F.col("to_first").alias("first"))
        more = cut_lineage(fired.unionByName(onward).distinct())
        second = jump.select(
            *ZONE, F.col("__stretch").alias("to_stretch"), F.col("first").alias("to_first"),
            F.col("to_stretch").alias("__far"), F.col("to_first").alias("__far_first"))
        doubled = cut_lineage(jump.join(S.by_key(second), [*ZONE, "to_stretch", "to_first"]).select(
            *part, "first", F.col("__far").alias("to_stretch"), F.col("__far_first").alias("to_first")))
        release(fired, jump)
        fired, jump = more, doubled
    release(jump)
    return rows.groupBy(*part).cogroup(fired.groupBy(*part)).applyInPandas(
        _firing(cooldown), ", ".join([*names[:2], *names[3:]]))
