"""Badge scans: intake, deduplication, and look-up by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.functions.text import parse_timestamp
from paceline.operators import stretches as S

_PAYLOAD = "zone_id string, timestamp string, identity string"


def ingest_scans(payloads: DataFrame) -> DataFrame:
    """JSON payloads to scans; ``reason`` tells why a payload is rejected and is null on good ones."""
    body = F.from_json("payload", _PAYLOAD)
    parsed = payloads.withColumn("__body", body).select(
        "*",
        F.col("__body.zone_id").alias("zone_id"),
        parse_timestamp(F.col("__body.timestamp")).alias("ts"),
        F.col("__body.identity").alias("identity"),
        F.col("__body.timestamp").alias("__raw"),
    )
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reason = (
        F.when(F.col("__raw").isNull(), F.lit("missing timestamp"))
        .when(F.col("ts").isNull(), F.lit("bad timestamp"))
        .when(empty("zone_id"), F.lit("missing zone_id"))
        .when(empty("identity"), F.lit("missing identity"))
    )
    return parsed.withColumn("reason", reason).drop("__body", "__raw")


def valid_scans(ingested: DataFrame) -> DataFrame:
    return ingested.filter("reason is null").select("zone_id", "ts", "identity", "arrival")


def rejected_scans(ingested: DataFrame) -> DataFrame:
    return ingested.filter("reason is not null").select("payload", "arrival", "reason")


def dedup_scans(scans: DataFrame) -> DataFrame:
    """One scan per zone and time: the last to arrive wins. Combines map-side, so hot zones shrink early."""
    return scans.groupBy("zone_id", "ts").agg(
        F.max_by("identity", F.struct("arrival", "identity")).alias("identity"),
        F.max("arrival").alias("arrival"),
    )


def prune_scans(scans: DataFrame, before_ts: float) -> DataFrame:
    """Scans kept when everything earlier than ``before_ts`` is dropped."""
    return scans.filter(F.col("ts") >= F.lit(float(before_ts)))


def pruned_count(scans: DataFrame, before_ts: float) -> DataFrame:
    """How many scans ``prune_scans`` drops."""
    return scans.agg(F.count_if(F.col("ts") < F.lit(float(before_ts))).alias("n_pruned"))


def _bucket_width(window: float) -> float:
    if window < 0:
        raise ValueError("window must be >= 0")
    return max(window * 1.001, 0.001)


def scan_window_lookup(probes: DataFrame, scans: DataFrame, window: float) -> DataFrame:
    """Every scan of the probe's zone in ``[ts - window, ts + window]``, both ends included.

    Zones can be hot, so the join key is zone and time bucket: a probe has one
    bucket, a scan is sent to its own and the two next to it, and a pair meets
    once. The exact test follows.
    """
    width = F.lit(_bucket_width(window))
    own = F.floor(F.col("scan_ts") / width)
    spread = scans.select(
        "zone_id", F.col("ts").alias("scan_ts"), F.col("identity").alias("scan_identity")
    ).withColumn("__bucket", F.explode(F.sequence(own - 1, own + 1)))
    w = F.lit(float(window))
    return (
        probes.withColumn("__bucket", F.floor(F.col("ts") / width))
        .join(spread, ["zone_id", "__bucket"])
        .filter((F.col("scan_ts") >= F.col("ts") - w) & (F.col("scan_ts") <= F.col("ts") + w))
        .drop("__bucket")
    )


def scan_count_by_zone(scans: DataFrame) -> DataFrame:
    """Scans per zone, given deduplicated scans."""
    return scans.groupBy("zone_id").agg(F.count(F.lit(1)).alias("n_scans"))


def scan_count_near(
    probes: DataFrame, scans: DataFrame, window: float = 1.0,
    seconds_per_stretch: float = S.SECONDS_PER_STRETCH,
) -> DataFrame:
    """Scans within ``window`` of each probe ``(zone_id, ts)``; probes without any count 0.

    Counts come from running totals over probes and scans put on one time line
    (how many scans up to ``ts + window`` less how many before ``ts - window``),
    so no pair is ever formed.
    """
    w = F.lit(float(window))
    asked = probes.select("zone_id", "ts").distinct()
    lo = asked.select("zone_id", "ts", (F.col("ts") - w).alias("__at"), F.lit(0).alias("__kind"), F.lit(-1).alias("__sign"))
    hi = asked.select("zone_id", "ts", (F.col("ts") + w).alias("__at"), F.lit(2).alias("__kind"), F.lit(1).alias("__sign"))
    marks = scans.select(
        "zone_id", F.lit(None).cast("double").alias("ts"), F.col("ts").alias("__at"), F.lit(1).alias("__kind"),
        F.lit(0).alias("__sign"),
    )
    line = lo.unionByName(hi).unionByName(marks)
    counted = S.running_total(
        line, ["zone_id"], ["__at", "__kind"], F.when(F.col("__kind") == 1, 1).otherwise(0),
        S.by_seconds(F.col("__at"), seconds_per_stretch), "__upto",
    )
    return (
        counted.filter("__sign <> 0").groupBy("zone_id", "ts")
        .agg(F.sum(F.col("__sign") * F.col("__upto")).alias("n_scans"))
    )
