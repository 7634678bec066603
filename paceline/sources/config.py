"""Camera configuration as dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.schemas import CAMERA_DEFAULTS, TRIPWIRE_DEFAULTS

# One configured camera as it is written down; everything but id and source may be missing.
CAMERA_DOC = (
    "id string, source string, model_size string, tracker_type string, use_appearance boolean, "
    "buffer_seconds int, fps_fallback int, display_conf double, centroid_mode string, frame_size array<double>, "
    "zones array<struct<id:string,polygon:array<array<double>>>>, "
    "tripwires array<struct<id:string,p1:array<double>,p2:array<double>,direction_in:string,"
    "recycle_after_frames:int,recycle_distance_px:double>>, "
    "max_density_threshold int, density_dwell_seconds double, density_cooldown_seconds double"
)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file with a ``streams`` list, as one row per camera."""
    docs = spark.read.schema(f"streams array<struct<{_as_struct(CAMERA_DOC)}>>").json(path, multiLine=True)
    return docs.select(F.inline("streams"))


def _as_struct(ddl: str) -> str:
    fields, depth, start = [], 0, 0
    for i, ch in enumerate(ddl + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = ddl[start:i].strip().split(" ", 1)
            fields.append(f"{name}:{kind}")
            start = i + 1
    return ",".join(fields)


def parse_config(docs: DataFrame, column: str = "doc") -> DataFrame:
    """The same from a text column with one camera per row."""
    return docs.select(F.from_json(F.col(column), CAMERA_DOC).alias("__doc")).select("__doc.*")


def _or_default(name: str, defaults: dict) -> F.Column:
    return F.coalesce(F.col(name), F.lit(defaults[name])) if name in defaults else F.col(name)


def load_cameras(config: DataFrame) -> DataFrame:
    d = lambda n: _or_default(n, CAMERA_DEFAULTS)
    return config.select(
        F.coalesce("id", F.lit("")).alias("stream_id"), F.coalesce("source", F.lit("")).alias("source"),
        d("model_size").alias("model_size"), F.lower(F.trim(d("tracker_type"))).alias("tracker_type"),
        d("use_appearance").alias("use_appearance"), d("buffer_seconds").alias("buffer_seconds"),
        d("fps_fallback").alias("fps_fallback"), d("display_conf").alias("display_conf"),
        F.lower(F.trim(d("centroid_mode"))).alias("centroid_mode"),
        F.get("frame_size", F.lit(0)).cast("int").alias("frame_w"),
        F.get("frame_size", F.lit(1)).cast("int").alias("frame_h"), "max_density_threshold",
        d("density_dwell_seconds").alias("density_dwell_seconds"),
        d("density_cooldown_seconds").alias("density_cooldown_seconds"),
    )


def _point(c: F.Column) -> F.Column:
    return F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y"))


def load_zones(config: DataFrame) -> DataFrame:
    return config.select(F.coalesce("id", F.lit("")).alias("stream_id"), F.posexplode("zones").alias("zone_ord", "__z")).select(
        "stream_id", F.coalesce("__z.id", F.lit("")).alias("zone_id"), "zone_ord",
        F.transform("__z.polygon", _point).alias("polygon"),
        F.exists("__z.polygon", lambda p: F.size(p) != 2).alias("bad_points"),
    )


def load_tripwires(config: DataFrame) -> DataFrame:
    """Tripwires with defaults, and the frame size of their camera for checks."""
    rows = config.select(
        F.coalesce("id", F.lit("")).alias("stream_id"), F.col("frame_size").alias("__size"),
        F.posexplode("tripwires").alias("tw_ord", "__t"),
    ).select("stream_id", "tw_ord", "__size", "__t.*")
    d = lambda n: _or_default(n, TRIPWIRE_DEFAULTS)
    return rows.select(
        "stream_id", F.coalesce("id", F.lit("")).alias("tripwire_id"), "tw_ord", _point(F.col("p1")).alias("p1"),
        _point(F.col("p2")).alias("p2"), d("direction_in").alias("direction_in"),
        d("recycle_after_frames").alias("recycle_after_frames"),
        d("recycle_distance_px").alias("recycle_distance_px"),
        ((F.coalesce(F.size("p1"), F.lit(0)) != 2) | (F.coalesce(F.size("p2"), F.lit(0)) != 2)).alias("bad_points"),
        F.get("__size", F.lit(0)).alias("frame_w"), F.get("__size", F.lit(1)).alias("frame_h"),
    )
