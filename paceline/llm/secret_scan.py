"""Secrets in the notes of alerts, weighed by how many cameras own the same value."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import spread_join
from paceline.session import cut_lineage, release

#: Kinds in the order in which spans of one start are listed. Fixed values.
KINDS = ("assign", "access", "hex", "live")
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
WIDE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
#: What a value that stands for a secret often contains.
PLACEHOLDER = re.compile(r"(?i)example|sample|dummy|changeme|placeholder|your|xxxx|1234567|abcdef0|(.)\1{5}")

MIN_ASSIGN, MIN_ACCESS = 6, 20
#: Owners from which on a value counts as a copied example.
COPIED_OWNERS = 3
#: Bits per character from which on a value looks random.
MIN_ENTROPY = 3.0
MIN_WIDE_ENTROPY = 3.7


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def looks_live(value: str, least: float = MIN_ENTROPY) -> bool:
    return entropy(value) >= least and not PLACEHOLDER.search(value)


def base_spans(notes: str) -> list[tuple[str, int, int, str]]:
    """``kind, start, end, value`` by the three fixed patterns, by start, then kind."""
    found = []
    low = notes.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(notes) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in notes:
        found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(notes) if len(m[0]) >= MIN_ACCESS]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(notes)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def wide_candidates(notes: str, taken: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Long random-looking strings of mixed letters and digits outside the spans that are ``taken``."""
    found = []
    for m in WIDE.finditer(notes):
        value = m[0]
        mixed = any(c.isdigit() for c in value) and any(c.isupper() for c in value) and any(c.islower() for c in value)
        if mixed and not any(s < m.end() and m.start() < e for _, s, e, _ in taken) and looks_live(
                value, MIN_WIDE_ENTROPY):
            found.append(("live", m.start(), m.end(), value))
    return found


def _digest(value: str) -> bytes:
    return hashlib.sha256(value.encode()).digest()[:16]


SPAN = "struct<kind:string,start:bigint,end:bigint,value:binary,random:boolean>"


def find_candidates(alerts: DataFrame) -> DataFrame:
    """``id, stream_id, zone_id, found``: spans of each alert, values as digests; a secret itself is never put out."""
    types = {f.name: f.dataType.simpleString() for f in alerts.schema}
    span = pa.list_(pa.struct([
        ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.binary()),
        ("random", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for notes in batch.column("notes"):
                text = notes.as_py() or ""
                base = base_spans(text)
                rows.append([
                    {"kind": k, "start": s, "end": e, "value": _digest(v), "random": looks_live(v)}
                    for k, s, e, v in [*base, *wide_candidates(text, base)]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("stream_id"), batch.column("zone_id"), pa.array(rows, span)],
                names=["id", "stream_id", "zone_id", "found"])

    return alerts.select("id", "stream_id", "zone_id", "notes").mapInArrow(
        run, f"id {types['id']}, stream_id {types['stream_id']}, zone_id {types['zone_id']}, found array<{SPAN}>")


def ownership(candidates: DataFrame) -> DataFrame:
    """``value, n_spans, n_zones, n_streams``: where each value occurs, over all alerts.

    ``candidates`` has ``stream_id, zone_id, value``. Rows are counted per value
    and zone first, so that a value in very many alerts is a few rows per camera.
    """
    by_zone = candidates.groupBy("value", "stream_id", "zone_id").agg(F.count(F.lit(1)).alias("n"))
    by_stream = by_zone.groupBy("value", "stream_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("zones"))
    return by_stream.groupBy("value").agg(
        F.sum("n").alias("n_spans"), F.sum("zones").alias("n_zones"), F.count(F.lit(1)).alias("n_streams"))


def scan_secrets(alerts: DataFrame, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """Secrets in the notes of alerts, and which of them seem to be in use.

    ``alerts`` has ``id, stream_id, zone_id, notes``; other columns are not read.
    A camera (``stream_id``) is an owner, a zone of it (``zone_id``) is a place of
    storage, a repository. Base spans come from three fixed patterns: values
    assigned to a password word (``assign``), access keys (``access``) and long
    hexadecimal numbers (``hex``). The value of every span and of other long
    random-looking strings is counted over the whole log by the cameras and zones
    it occurs in: a value of ``copied_owners`` cameras or more is a copied example,
    a random-looking value of a single camera seems live. Of the other strings
    those with a single owner are added as spans of kind ``live``.

    Returns a row per alert (null notes: empty, null cameras and zones count as
    one each): ``id, spans`` (array of kind, start, end in code points, n_streams,
    n_zones, live), and ``n_assign, n_access, n_hex, n_added, n_live, n_copied``.
    Repeated rows stay repeated, an empty log gives no rows.
    """
    found = cut_lineage(find_candidates(alerts).withColumn("row", F.monotonically_increasing_id()))
    spans = found.select("row", "stream_id", "zone_id", F.inline("found"))
    owners = cut_lineage(ownership(spans), narrow=True)
    known = spread_join(
        spans, owners.withColumn("weight", F.col("n_spans")), ["value"], "weight",
        ["n_spans", "n_zones", "n_streams"], F.struct("row", "start"))
    judged = known.select(
        "row", F.struct(
            "start", F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).alias("rank"), "kind", "end",
            "n_streams", "n_zones", (F.col("random") & (F.col("n_streams") == 1)).alias("live")).alias("span")
    ).filter("span.kind != 'live' or span.live")
    by_row = judged.groupBy(F.col("row").alias("__row")).agg(F.sort_array(F.collect_list("span")).alias("spans"))
    none = F.array().cast(by_row.schema["spans"].dataType)
    whole = found.select("id", "row").join(by_row, F.col("row") == F.col("__row"), "left").withColumn(
        "spans", F.coalesce("spans", none))

    def many(test):
        return F.size(F.filter("spans", test)).cast("long")

    def of(kind):
        return many(lambda s: s["kind"] == kind)

    return whole.select(
        "id",
        F.transform("spans", lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            s["n_streams"].alias("n_streams"), s["n_zones"].alias("n_zones"), s["live"].alias("live"))).alias("spans"),
        *[of(kind).alias(f"n_{kind}") for kind in KINDS[:3]], of("live").alias("n_added"), many(lambda s: s["live"]).alias("n_live"),
        many(lambda s: s["n_streams"] >= copied_owners).alias("n_copied"))
