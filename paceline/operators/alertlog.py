"""The logs of violations and crowd alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline import schemas
from paceline.operators import stretches as S


# Alerts are numbered minute by minute, so that a day of all cameras is many tasks; the minutes' offsets are a small table.
SECONDS_NUMBERED = 60.0


def _known_columns(rows: DataFrame, ddl: str) -> list[Column]:
    wanted = T.StructType.fromDDL(ddl)
    have = set(rows.columns)
    return [
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted
    ]


def _numbered(rows: DataFrame, existing: DataFrame | None, order: list[str], ddl: str, created_at: Column | None) -> DataFrame:
    """``rows`` with the log's columns and ids that go on after the largest one in ``existing``."""
    plain = rows.drop("id", "clip_path", "clip_url")
    numbered = S.running_number(plain, [], order, S.by_seconds(F.col("timestamp"), SECONDS_NUMBERED), "id")
    if existing is not None:
        last = existing.agg(F.coalesce(F.max("id"), F.lit(0).cast("long")).alias("last")).scalar()
        numbered = numbered.withColumn("id", F.col("id") + last)
    stamp = created_at if created_at is not None else F.current_timestamp()
    return numbered.withColumn("created_at", stamp).select(*_known_columns(
        numbered.withColumn("created_at", stamp), ddl))


VIOLATION_ORDER = ["timestamp", "stream_id", "tripwire_id", "track_id", "zone_id"]
DENSITY_ORDER = ["timestamp", "stream_id", "zone_id"]


def record_violations(rows: DataFrame, existing: DataFrame | None = None, created_at: Column | None = None) -> DataFrame:
    """Flat violation rows as new log rows: next ids, no clip yet, unknown columns left out."""
    return _numbered(rows, existing, VIOLATION_ORDER, schemas.VIOLATIONS, created_at)


def record_density_alerts(rows: DataFrame, existing: DataFrame | None = None, created_at: Column | None = None) -> DataFrame:
    return _numbered(rows, existing, DENSITY_ORDER, schemas.DENSITY_ALERTS, created_at)


def attach_clip(log: DataFrame, clips: DataFrame) -> DataFrame:
    """The log with ``clip_path`` and ``clip_url`` of ``clips`` (id, clip_path, clip_url) set; ids not in the log do nothing."""
    new = clips.groupBy("id").agg(
        F.max_by(F.struct("clip_path", "clip_url"), F.struct("clip_path", "clip_url")).alias("__clip"))
    joined = log.join(new, "id", "left")
    set_ = lambda c: F.when(F.col("__clip").isNotNull(), F.col(f"__clip.{c}")).otherwise(F.col(c))
    return joined.select(*[
        set_(c).alias(c) if c in ("clip_path", "clip_url") else F.col(c) for c in log.columns
    ])


def recent(log: DataFrame, zone_id: str | None = None, limit: int = 100) -> DataFrame:
    """Newest first; rows of one time in the order they were recorded."""
    rows = log if zone_id is None else log.filter(F.col("zone_id") == zone_id)
    return rows.orderBy(F.col("timestamp").desc(), F.col("id").asc()).limit(limit)


recent_violations = recent
recent_density_alerts = recent


def dashboard_alerts(log: DataFrame) -> DataFrame:
    return recent(log, limit=20)


def all_alerts(violations: DataFrame, density: DataFrame) -> DataFrame:
    """Both logs on one time line; crowd alerts have the kind ``high_density``."""
    return violations.unionByName(density.withColumn("kind", F.lit("high_density")), allowMissingColumns=True)
