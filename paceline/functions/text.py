"""Texts and times the reports carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
_OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"


def parse_timestamp(raw: Column) -> Column:
    """Epoch seconds from a number, a numeric text or an ISO date-time; null where it is none.

    An ISO text without an offset is taken as UTC, whatever the session's zone.
    Numbers are plain decimals with or without exponent, blanks around them are
    put away; type suffixes (``1.5d``), hexadecimal and underscored numbers,
    ``true`` and words like ``NaN`` are no times.
    """
    text = F.trim(raw.cast("string"))
    is_iso = text.rlike(_ISO)
    clock = F.regexp_replace(F.regexp_replace(text, ",", "."), r"([+-]\d{2})(\d{2})$", "$1:$2")
    has_time = F.length(text) > 10
    absolute = (
        F.when(~has_time, F.concat(text, F.lit("T00:00:00Z")))
        .when(F.substring(text, 11, 100).rlike(_OFFSET), clock)
        .otherwise(F.concat(clock, F.lit("Z")))
    )
    micros = F.unix_micros(F.when(is_iso, F.try_to_timestamp(absolute)))
    return F.coalesce(micros / F.lit(1e6), F.when(text.rlike(_NUMBER), text.try_cast("double")))


def utc_date(ts: Column) -> Column:
    """``yyyy-MM-dd`` of an epoch second, in UTC whatever the session's zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts / F.lit(86400.0)).cast("int")).cast("string")


def clip_path(base_dir: str, stream_id: Column, ts: Column, alert_id: Column) -> Column:
    return F.concat_ws("/", F.lit(base_dir.rstrip("/")), stream_id, utc_date(ts), F.concat(alert_id.cast("string"), F.lit(".mp4")))


def clip_url(base_dir: str, stream_id: Column, ts: Column, alert_id: Column, backend: str = "local") -> Column:
    if backend == "noop":
        return F.concat(F.lit("noop://"), stream_id, F.lit("/"), alert_id.cast("string"))
    # a file URI keeps these characters as they are and percent-encodes all others
    path = F.url_encode(clip_path(base_dir, stream_id, ts, alert_id))
    kept = (("%2F", "/"), ("\\+", "%20"), ("%7E", "~"))
    for pattern, plain in kept:
        path = F.regexp_replace(path, pattern, plain)
    return F.concat(F.lit("file://"), path)


def density_notes(peak: Column, threshold: Column, dwell: Column) -> Column:
    return F.format_string(
        "count peaked at %d (threshold %d) for %.2fs", peak.cast("long"), threshold.cast("long"), dwell
    )


def violation_notes(kind: Column, ordinal: Column) -> Column:
    """The remark on a violation; ``ordinal`` is the place of the crossing among those on its scan."""
    return F.when(kind == "unmatched", F.lit("no scan in window")).when(
        kind == "tailgating",
        F.format_string("scan already authorized for %d prior crossing(s)", ordinal.cast("long")),
    )


def join_notes(*notes: Column) -> Column:
    return F.concat_ws(" | ", *notes)
