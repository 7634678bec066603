"""Crossings against badge scans: who passed without one, and who slipped in behind somebody else."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.text import violation_notes
from paceline.operators import stretches as S
from paceline.operators.scans import dedup_scans

IN_ORDER = ("ts", "stream_id", "frame_idx", "track_ord", "track_id", "tripwire_id")


def _filled(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def to_crossing_records(crossings: DataFrame, tripwire_zones: DataFrame | None = None) -> DataFrame:
    """Crossings with the zone their scans are posted under.

    A crossing without a zone takes the tripwire's id for it, or the zone that
    ``tripwire_zones`` (tripwire_id, zone_id) names; one without either is
    ``default``. A missing direction becomes ``unknown``.
    """
    have = set(crossings.columns)
    out = crossings
    for name in ("zone_id", "tripwire_id", "direction"):
        if name not in have:
            out = out.withColumn(name, F.lit(None).cast("string"))
    if "embedding" not in have:
        out = out.withColumn("embedding", F.lit(None).cast("binary"))
    if tripwire_zones is not None:
        mapped = tripwire_zones.select("tripwire_id", F.col("zone_id").alias("__mapped"))
        out = out.join(mapped, "tripwire_id", "left").withColumn(
            "zone_id", F.coalesce(_filled("zone_id"), "__mapped")
        ).drop("__mapped")
    return (
        out.withColumn("__zone", F.coalesce(_filled("zone_id"), _filled("tripwire_id"), F.lit("default")))
        .withColumn("__wire", F.coalesce(_filled("tripwire_id"), _filled("zone_id"), F.lit("default")))
        .withColumn("zone_id", F.col("__zone")).withColumn("tripwire_id", F.col("__wire"))
        .withColumn("direction", F.coalesce("direction", F.lit("unknown")))
        .withColumn("ts", F.col("ts").cast("double")).withColumn("track_id", F.col("track_id").cast("long"))
        .drop("__zone", "__wire")
    )


def nearest_scan(
    crossings: DataFrame, scans: DataFrame, window: float, seconds_per_stretch: float = S.SECONDS_PER_STRETCH
) -> DataFrame:
    """Add ``scan_ts, scan_identity``: the scan of the zone closest in time, if within ``window``; on a tie the earlier.

    ``scans`` are deduplicated. Both sides are put on one time line, cut by zone
    and stretch of time; a scan near a cut is present on both sides of it. The
    closest scan is either the last before or the first after the crossing, so
    every crossing looks at two scans however many there are.
    """
    size = max(float(seconds_per_stretch), 4.0 * float(window), 1.0)
    reach = F.lit(float(window) * 1.001 + 0.001)
    w = F.lit(float(window))
    marks = scans.select(
        "zone_id", "ts", F.struct(F.col("ts"), F.col("identity")).alias("__scan"), F.lit(0).alias("__kind"),
        F.explode(F.sequence(S.by_seconds(F.col("ts") - reach, size), S.by_seconds(F.col("ts") + reach, size)))
        .alias("__stretch"),
    )
    probes = crossings.withColumn("__kind", F.lit(1)).withColumn("__stretch", S.by_seconds(F.col("ts"), size))
    line = probes.unionByName(marks, allowMissingColumns=True)
    part = Window.partitionBy("zone_id", "__stretch")
    rows = (Window.unboundedPreceding, Window.currentRow)
    before = F.last("__scan", ignorenulls=True).over(part.orderBy(F.col("ts"), F.col("__kind")).rowsBetween(*rows))
    after = F.last("__scan", ignorenulls=True).over(
        part.orderBy(F.col("ts").desc(), F.col("__kind").desc()).rowsBetween(*rows)
    )
    both = (
        line.withColumn("__before", before).withColumn("__after", after).filter("__kind = 1")
        .withColumn("__before", F.when(F.col("__before.ts") >= F.col("ts") - w, F.col("__before")))
        .withColumn("__after", F.when(F.col("__after.ts") <= F.col("ts") + w, F.col("__after")))
    )
    closer = F.abs(F.col("__after.ts") - F.col("ts")) < F.abs(F.col("__before.ts") - F.col("ts"))
    best = F.when(
        F.col("__before").isNull() | closer, F.col("__after")
    ).otherwise(F.col("__before"))
    return (
        both.withColumn("__best", best)
        .withColumn("scan_ts", F.col("__best.ts")).withColumn("scan_identity", F.col("__best.identity"))
        .drop("__scan", "__kind", "__stretch", "__before", "__after", "__best")
    )


def unmatched_crossings(crossings: DataFrame, scans: DataFrame, window: float) -> DataFrame:
    """Crossings with no scan of their zone within ``window``."""
    return nearest_scan(crossings, dedup_scans(scans), window).filter("scan_ts is null").drop("scan_ts", "scan_identity")


def consumption_ordinal(matched: DataFrame, order: Sequence[str] = IN_ORDER) -> DataFrame:
    """Add ``ordinal`` (1, 2, ... among the crossings on one scan) and ``prev_on_scan_ts``.

    All crossings on a scan lie within the access window around it. A crossing
    without a scan is a group of its own time.
    """
    on_scan = Window.partitionBy("zone_id", F.coalesce("scan_ts", "ts"), "scan_identity").orderBy(*order)
    return (
        matched.withColumn("ordinal", F.row_number().over(on_scan).cast("long"))
        .withColumn("prev_on_scan_ts", F.lag("ts").over(on_scan))
        .withColumn("ordinal", F.when(F.col("scan_ts").isNotNull(), F.col("ordinal")))
        .withColumn("prev_on_scan_ts", F.when(F.col("scan_ts").isNotNull(), F.col("prev_on_scan_ts")))
    )


def access_decisions(
    crossings: DataFrame, scans: DataFrame, window: float, order: Sequence[str] = IN_ORDER,
    seconds_per_stretch: float = S.SECONDS_PER_STRETCH, occupancy: DataFrame | None = None,
) -> DataFrame:
    """Every crossing record with ``kind`` authorized / tailgating / unmatched.

    Crossings are taken in time order. Each one that reaches a scan is noted on
    it, so "somebody used this scan within the window" is the same as "the one
    before did". With ``occupancy`` the zone's count at the crossing is added; it
    decides nothing.
    """
    if occupancy is not None:
        crossings = occupancy_asof(crossings, occupancy, seconds_per_stretch)
    if window <= 0:
        raise ValueError("window must be > 0")
    used = consumption_ordinal(nearest_scan(crossings, dedup_scans(scans), window, seconds_per_stretch), order)
    behind = F.abs(F.col("prev_on_scan_ts") - F.col("ts")) <= F.lit(float(window))
    kind = (
        F.when(F.col("scan_ts").isNull(), F.lit("unmatched"))
        .when(F.coalesce(behind, F.lit(False)), F.lit("tailgating"))
        .otherwise(F.lit("authorized"))
    )
    return (
        used.withColumn("kind", kind)
        .withColumn("authorized", F.col("kind") == "authorized")
        .withColumn("prior_crossings", F.col("ordinal") - 1)
        .withColumn("notes", violation_notes(F.col("kind"), F.col("ordinal")))
        .drop("prev_on_scan_ts")
    )


def tailgating(crossings: DataFrame, scans: DataFrame, window: float) -> DataFrame:
    return access_decisions(crossings, scans, window).filter("kind = 'tailgating'")


def access_violations(
    crossings: DataFrame, scans: DataFrame, window: float, order: Sequence[str] = IN_ORDER,
    seconds_per_stretch: float = S.SECONDS_PER_STRETCH,
) -> DataFrame:
    """The crossings that are violations, with the scan they were held against."""
    bad = access_decisions(crossings, scans, window, order, seconds_per_stretch).filter("not authorized")
    scan = F.when(
        F.col("scan_ts").isNotNull(),
        F.struct("zone_id", F.col("scan_ts").alias("timestamp"), F.col("scan_identity").alias("identity")),
    )
    return bad.select(
        F.col("ts").alias("timestamp"), "stream_id", "zone_id", "tripwire_id", "track_id", "direction", "embedding",
        "kind", scan.alias("matching_scan"), "prior_crossings", "notes",
    )


def violation_rows(violations: DataFrame) -> DataFrame:
    """Violations flattened to the columns of the log."""
    return violations.select(
        "timestamp", "stream_id", "zone_id", "tripwire_id", "track_id", "direction", "embedding", "kind",
        F.col("matching_scan.identity").alias("matching_identity"),
        F.col("matching_scan.timestamp").alias("matching_scan_ts"), "notes",
    )


def occupancy_asof(
    crossings: DataFrame, occupancy: DataFrame, seconds_per_stretch: float = S.SECONDS_PER_STRETCH
) -> DataFrame:
    """Add ``occupancy_at_crossing``: the zone's latest count at or before the crossing, null if none."""
    facts = occupancy.select("stream_id", "zone_id", "ts", F.col("count").alias("__count"), F.lit(0).alias("__kind"))
    line = crossings.withColumn("__kind", F.lit(1)).unionByName(facts, allowMissingColumns=True)
    return (
        S.last_known(
            line, ["stream_id", "zone_id"], ["ts", "__kind"], F.col("__count"),
            S.by_seconds(F.col("ts"), seconds_per_stretch), "occupancy_at_crossing",
        )
        .filter("__kind = 1").drop("__kind", "__count")
    )


def late_scan_reevaluation(crossings: DataFrame, scans: DataFrame, window: float, known_at: int) -> DataFrame:
    """Decisions that change between the scans known at arrival number ``known_at`` and all scans."""
    key = ["zone_id", "stream_id", "tripwire_id", "track_id", "frame_idx", "ts"]
    then = access_decisions(crossings, scans.filter(F.col("arrival") <= known_at), window)
    final = access_decisions(crossings, scans, window)
    return (
        then.select(*key, F.col("kind").alias("kind_then"))
        .join(final.select(*key, F.col("kind").alias("kind_final")), key, "full")
        .filter(~F.col("kind_then").eqNullSafe(F.col("kind_final")))
    )
