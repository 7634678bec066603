"""How good detections, tracks, crossings and violations are, against ground truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.functions import geometry as G
from paceline.operators import stretches as S

EPS = 1e-6
MATCH_IOU = 0.4


def _ratio(a: Column, b: Column) -> Column:
    return a / (b + F.lit(EPS))


def match_tracks_to_gt(tracks: DataFrame, truth: DataFrame, min_iou: float = MATCH_IOU) -> DataFrame:
    """Each track with the true person it overlaps most; ``gt_id`` is null at an overlap of ``min_iou`` or less.

    Two tracks may match one person. On equal overlap the first in
    ``gt_ord`` wins. Joined on scenario and frame, so a group is one frame.
    """
    box = lambda p: tuple(F.col(f"{p}{c}") for c in ("x1", "y1", "x2", "y2"))
    people = truth.select(
        "scenario", "frame_idx", F.col("gt_id").alias("__gt"), F.col("gt_ord").alias("__ord"),
        *[F.col(c).alias(f"__{c}") for c in ("x1", "y1", "x2", "y2")],
    )
    overlap = G.iou(box(""), box("__"))
    key = ["scenario", "frame_idx", "track_ord", "track_id"]
    best = (
        tracks.join(people, ["scenario", "frame_idx"], "left").withColumn("__iou", overlap)
        .groupBy(*key)
        .agg(F.max_by(F.struct("__iou", "__gt"), F.struct(F.col("__iou"), (-F.col("__ord")).alias("o"))).alias("__best"))
    )
    hit = F.col("__best.__iou") > F.lit(min_iou)
    return best.select(
        *key, F.when(hit, F.col("__best.__gt")).alias("gt_id"), F.when(hit, F.col("__best.__iou")).alias("iou"))


def missed_ground_truth(matches: DataFrame, truth: DataFrame) -> DataFrame:
    """True people no track matched."""
    found = matches.filter("gt_id is not null").select("scenario", "frame_idx", "gt_id")
    return truth.join(found, ["scenario", "frame_idx", "gt_id"], "left_anti")


def gt_id_switches(matches: DataFrame, frames_per_stretch: int = S.FRAMES_PER_STRETCH) -> DataFrame:
    """Matches whose track id differs from the person's match before."""
    found = matches.filter("gt_id is not null")
    with_prev = S.previous_row(
        found, ["scenario", "gt_id"], ["frame_idx", "track_ord"], ["track_id"],
        S.by_frames(F.col("frame_idx"), frames_per_stretch), "__last",
    )
    return with_prev.filter(F.col("__last.track_id") != F.col("track_id")).select(
        "scenario", "gt_id", "frame_idx", F.col("__last.track_id").alias("from_track_id"),
        F.col("track_id").alias("to_track_id"),
    )


def _scores(df: DataFrame) -> DataFrame:
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return (
        df.withColumn("precision", p).withColumn("recall", r)
        .withColumn("f1", F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + F.lit(EPS)))
    )


def detection_quality(matches: DataFrame, truth: DataFrame) -> DataFrame:
    """Per scenario: true and false positives, misses, precision, recall and F1."""
    hits = matches.groupBy("scenario").agg(
        F.count_if(F.col("gt_id").isNotNull()).alias("tp"), F.count_if(F.col("gt_id").isNull()).alias("fp"),
        F.count_distinct(F.when(F.col("gt_id").isNotNull(), F.struct("frame_idx", "gt_id"))).alias("__found"),
    )
    people = truth.groupBy("scenario").agg(F.count(F.lit(1)).alias("__people"))
    both = hits.join(people, "scenario", "full").na.fill(0, ["tp", "fp", "__found", "__people"])
    return _scores(both.withColumn("fn", F.col("__people") - F.col("__found")).drop("__people", "__found"))


def overall_quality(per_scenario: DataFrame, switches: DataFrame) -> DataFrame:
    """One row: counts summed over scenarios, scores from the sums, and all id switches."""
    sums = per_scenario.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    total = switches.agg(F.count(F.lit(1)).alias("id_switches")).scalar()
    return _scores(sums).withColumn("id_switches", total)


def id_switch_rate(switches: DataFrame, frames: DataFrame, fps: float = 30.0) -> DataFrame:
    """Id switches per minute of recording and scenario."""
    n = switches.groupBy("scenario").agg(F.count(F.lit(1)).alias("id_switches"))
    lengths = frames.groupBy("scenario").agg(F.count(F.lit(1)).alias("n_frames"))
    minutes = F.col("n_frames") / F.lit(float(fps)) / F.lit(60.0)
    return lengths.join(n, "scenario", "left").na.fill(0).withColumn(
        "switches_per_minute", F.col("id_switches") / (minutes + F.lit(EPS)))


def event_quality(detected: DataFrame, truth: DataFrame, keys: Sequence[str], slack_frames: int) -> DataFrame:
    """Per scenario: detected events against true ones with equal ``keys`` and at most ``slack_frames`` apart.

    A true event met at least once is found; each further detection of it is a
    double count; a detection that meets none is false. Joined on the keys and a
    bucket of frames.
    """
    width = slack_frames + 1
    bucket = lambda c: F.floor(F.col(c) / F.lit(width))
    on = ["scenario", *[k for k in keys if k != "scenario"]]
    det = detected.select(*on, F.col("frame_idx").alias("__det"))
    ref = truth.select(*on, F.col("frame_idx").alias("__ref"))
    pairs = (
        det.withColumn("__bucket", bucket("__det"))
        .join(ref.withColumn("__bucket", F.explode(F.sequence(bucket("__ref") - 1, bucket("__ref") + 1))), [*on, "__bucket"])
        .filter(F.abs(F.col("__det") - F.col("__ref")) <= slack_frames)
    )
    per_ref = pairs.groupBy(*on, "__ref").agg(F.count(F.lit(1)).alias("__n"))
    found = ref.join(per_ref, [*on, "__ref"], "left").groupBy("scenario").agg(
        F.count_if(F.col("__n").isNotNull()).alias("tp"), F.count_if(F.col("__n").isNull()).alias("fn"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("double_counts"))
    false = det.join(pairs.select(*on, "__det").distinct(), [*on, "__det"], "left_anti").groupBy("scenario").agg(
        F.count(F.lit(1)).alias("fp"))
    both = found.join(false, "scenario", "full").na.fill(0, ["tp", "fp", "fn", "double_counts"])
    return both.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn(
        "recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))


def crossing_quality(detected: DataFrame, truth: DataFrame, slack_frames: int = 2) -> DataFrame:
    return event_quality(detected, truth, ["tripwire_id", "gt_id", "direction"], slack_frames)


def violation_quality(detected: DataFrame, truth: DataFrame, slack_frames: int = 2) -> DataFrame:
    return event_quality(detected, truth, ["tripwire_id", "gt_id", "kind"], slack_frames)
