"""Counters and latency histograms from event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Upper bounds in seconds, and the counters with the column each is labelled by (fixed values).
LATENCY_BUCKETS = (0.001, 0.0025, 0.005, 0.010, 0.025, 0.050, 0.100, 0.250)
STAGES = ("detect", "track", "zone", "tripwire")
COUNTERS = {
    "frames_processed_total": "frame_processed",
    "frames_dropped_total": "frame_dropped",
    "stream_reconnects_total": "reconnect",
    "stream_build_failures_total": "build_failure",
    "id_switches_total": "id_switch",
    "violations_total": "violation",
    "stage_failures_total": "stage_failure",
}


def _named(events: DataFrame) -> DataFrame:
    name = F.create_map(*[F.lit(v) for pair in ((e, c) for c, e in COUNTERS.items()) for v in pair])
    return events.withColumn("counter", F.try_element_at(name, F.col("event"))).filter("counter is not null")


def event_counters(events: DataFrame) -> DataFrame:
    """Each counter's total (null label) and its value per label: the camera, the kind, or camera/stage."""
    label = (
        F.when(F.col("counter") == "violations_total", F.col("kind"))
        .when(F.col("counter") == "stage_failures_total", F.concat_ws("/", "stream_id", "stage"))
        .otherwise(F.col("stream_id"))
    )
    return (
        _named(events).select("counter", F.coalesce(label, F.lit("")).alias("label"))
        .rollup("counter", "label").agg(F.count(F.lit(1)).alias("value"))
        .filter("counter is not null")
    )


def _seconds_sum():
    """Sum of ``seconds`` to the nanosecond. Of decimals, so that it does not depend on the order the rows come in.

    Samples that are not finite count as samples, but add nothing.
    """
    finite = F.abs("seconds") < F.lit(float("inf"))
    return F.sum(F.when(finite & ~F.isnan("seconds"), F.col("seconds")).cast("decimal(28,9)")).cast("double")


def latency_histogram(samples: DataFrame) -> DataFrame:
    """Per stage and camera, and per stage over all cameras (null): cumulative counts by upper bound ``le``.

    ``samples`` are (stream_id, stage, seconds). Other stages are left out.
    """
    bounds = [F.count_if(F.col("seconds") <= F.lit(b)).alias(f"__{i}") for i, b in enumerate(LATENCY_BUCKETS)]
    wide = (
        samples.filter(F.col("stage").isin(*STAGES)).rollup("stage", "stream_id")
        .agg(F.count(F.lit(1)).alias("n"), _seconds_sum().alias("sum_seconds"), *bounds)
        .filter("stage is not null")
    )
    steps = [F.struct(F.lit(str(b)).alias("le"), F.col(f"__{i}").alias("cumulative")) for i, b in enumerate(LATENCY_BUCKETS)]
    steps.append(F.struct(F.lit("+Inf").alias("le"), F.col("n").alias("cumulative")))
    return wide.select("stage", "stream_id", "n", "sum_seconds", F.inline(F.array(*steps)))


def stage_latency_avg(samples: DataFrame) -> DataFrame:
    total = _seconds_sum()
    n = F.count(F.lit(1))
    return samples.filter(F.col("stage").isin(*STAGES)).groupBy("stream_id", "stage").agg(
        n.alias("n"), F.round(total / (n + F.lit(1e-6)) * F.lit(1000.0), 2).alias("avg_ms")
    )


def metrics_snapshot(events: DataFrame, samples: DataFrame) -> DataFrame:
    """One row: all counter totals and how many samples each stage has."""
    happened = events.select(F.concat(F.lit("e "), "event").alias("__what"))
    sampled = samples.select(F.concat(F.lit("s "), "stage").alias("__what"))
    counted = lambda what: F.count_if(F.col("__what") == F.lit(what))
    return happened.unionByName(sampled).agg(
        *[counted(f"e {event}").alias(counter) for counter, event in COUNTERS.items()],
        *[counted(f"s {s}").alias(f"{s}_count") for s in STAGES])


def stage_split(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames with per-stage error texts (``detect_error`` ... null where it went well), split in two.

    Good frames: those whose detect and track stages went well, with
    ``zones_ok`` and ``tripwires_ok`` telling which later results are empty.
    Failures: one row (stream_id, frame_idx, stage, reason, dropped) per failed stage
    reached; a frame dropped by an early stage does not get to the later ones.
    """
    dropped = F.col("detect_error").isNotNull() | F.col("track_error").isNotNull()
    good = frames.filter(~dropped).select(
        "stream_id", "frame_idx", "ts", F.col("zone_error").isNull().alias("zones_ok"),
        F.col("tripwire_error").isNull().alias("tripwires_ok"),
    )
    reached = {
        "detect": F.lit(True), "track": F.col("detect_error").isNull(), "zone": ~dropped, "tripwire": ~dropped,
    }
    entries = F.array(*[
        F.when(reached[s] & F.col(f"{s}_error").isNotNull(), F.struct(
            F.lit(s).alias("stage"), F.col(f"{s}_error").alias("reason"), F.lit(s in ("detect", "track")).alias("dropped")))
        for s in STAGES
    ])
    failures = frames.select("stream_id", "frame_idx", F.inline(F.filter(entries, lambda e: e.isNotNull())))
    return good, failures


def stage_failures(failures: DataFrame) -> DataFrame:
    return failures.groupBy("stream_id", "stage").agg(
        F.count(F.lit(1)).alias("n_failures"), F.count_if("dropped").alias("n_dropped_frames"))
