"""Near copies among the notes of alerts, by SimHash fingerprints and covering-code anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import spread_join
from paceline.llm.components import components
from paceline.session import cut_lineage, release

#: Differing bits up to which two fingerprints are linked. The anchors below are made for this number.
MAX_BITS = 3
SEED = 42
#: Fingerprints at home with one anchor above which the anchor's group is split.
HOT_ANCHOR = 4_096
#: Hashes that are counted at a time.
BLOCK = 1 << 16


# ---- fingerprints


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def shingles(text: str | None, words: int) -> np.ndarray:
    """The hashes of all shingles in order, repeats included; a shorter text is one shingle, one without words has none."""
    # bytes.lower and bytes.split know ASCII only, which is what is asked for
    parts = (text or "").encode().lower().split()
    last = max(1, len(parts) - words + 1) if parts else 0
    return np.fromiter(
        (xxhash.xxh64_intdigest(b" ".join(parts[i:i + words]), SEED) for i in range(last)), np.uint64, last)


def fingerprint_of(hashes: np.ndarray) -> int:
    """64 bits: each is 1 if it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        counts += _bit_counts(hashes[at:at + BLOCK])
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int) -> int:
    """The text's 64 bits, over its shingles; zero without words."""
    return fingerprint_of(shingles(text, words))


def fingerprint_notes(alerts: DataFrame, words: int = 5) -> DataFrame:
    """``id, fingerprint`` (bigint, the 64 bits as they are) of each alert's whole ``notes``; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(
                (fingerprint(text.as_py(), words) for text in batch.column("notes")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(found.view(np.int64))], names=["id", "fingerprint"])

    kind = alerts.schema["id"].dataType.simpleString()
    return alerts.select("id", "notes").mapInArrow(run, f"id {kind}, fingerprint bigint")


# ---- anchors


def _syndrome(word: Column) -> Column:
    """Of the [31, 26] Hamming code: the exclusive or of the places (1 to 31) of all set bits."""
    found = F.lit(0)
    for j in range(5):
        mask = sum(1 << (place - 1) for place in range(1, 32) if place >> j & 1)
        found = found + F.pmod(F.bit_count(word.bitwiseAND(F.lit(mask))), F.lit(2)) * F.lit(1 << j)
    return found.cast("int")


def _flip(place: Column) -> Column:
    return F.when(place > 0, F.expr("1L") * F.pow(F.lit(2.0), place - 1).cast("long")).otherwise(F.lit(0).cast("long"))


def anchor_rows(fingerprints: DataFrame) -> DataFrame:
    """``anchor, home, fp``: each fingerprint at every anchor within covering radius plus threshold.

    Of two fingerprints with 3 differing bits at most, one of the two halves has
    1 at most, so each half is covered by itself with threshold 1. Anchors of a
    half are the words of the perfect [31, 26] Hamming code on its lower 31 bits
    with either value of bit 31: a code of covering radius 1. A fingerprint is at
    *home* with the anchor within 1, and is copied to all within 1 + 1 (2 or 17).
    Two halves that differ in one bit meet at the home of either.
    """
    halves = fingerprints.select("fp", F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("side"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("half")),
        F.struct(F.lit(1).cast("long").alias("side"), F.shiftrightunsigned("fp", 32).alias("half")))).alias("h")
    ).select("fp", "h.*")
    parts = halves.select(
        "fp", "side", "half", _syndrome(F.col("half").bitwiseAND(F.lit(0x7FFFFFFF))).alias("syn"))
    # pairs of places whose exclusive or is the syndrome; place 0 is no flip, so (0, syndrome) leads home
    places = F.expr(
        "if(syn = 0, array(0, -1), concat(filter(sequence(0, 31), v -> v < (v ^ syn)), array(-1)))")
    copied = parts.withColumn("v", F.explode(places))
    first, second = F.col("v"), F.col("v").bitwiseXOR(F.col("syn"))
    word = F.when(
        F.col("v") < 0, F.col("half").bitwiseXOR(_flip(F.col("syn"))).bitwiseXOR(F.lit(1 << 31))
    ).when(F.col("syn") == 0, F.col("half")).otherwise(
        F.col("half").bitwiseXOR(_flip(first)).bitwiseXOR(_flip(second)))
    return copied.select(
        F.shiftleft(F.col("side"), 32).bitwiseOR(word).alias("anchor"), (F.col("v") == 0).alias("home"), "fp")


def _split_hot(rows: DataFrame, limit: int) -> DataFrame:
    """``anchor, part, fp``: groups of anchors with over ``limit`` fingerprints at home are cut, without losing a pair.

    The other half of a linked pair differs in 3 bits at most, so one of its four
    bytes is the same: a hot group is dealt by (byte, value) to 1,024 parts.
    """
    hot = cut_lineage(
        rows.filter("home").groupBy("anchor").agg(F.count(F.lit(1)).alias("homes"))
        .filter(F.col("homes") > limit).select("anchor", F.lit(True).alias("hot")), narrow=True)
    if hot.isEmpty():
        release(hot)
        return rows.select("anchor", F.lit(0).cast("long").alias("part"), "fp")
    # without a hint: a small table is broadcast by its size, a large one is joined by key
    marked = rows.join(hot, "anchor", "left")
    other = F.when(F.shiftright("anchor", 32) == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp"))
    parts = F.expr(
        "transform(sequence(0, 3), b -> 1 + (b * 256L) + (shiftrightunsigned(__other, b * 8) & 255L))")
    return marked.withColumn("__other", other).select(
        "anchor", F.explode(F.when(F.col("hot"), parts).otherwise(F.array(F.lit(0).cast("long")))).alias("part"), "fp")


# ---- comparison within an anchor's group


def _tree(group: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that hold together what is linked in the group: a spanning tree of each component, never all pairs."""
    waiting, found = np.unique(group), []
    while len(waiting) > 1:
        queue, waiting = [waiting[:1]], waiting[1:]
        while queue and len(waiting):
            heads = queue.pop()
            for head in heads:
                near = np.bitwise_count(waiting ^ head) <= bits
                if near.any():
                    new = waiting[near]
                    found.append((np.full(len(new), head), new))
                    queue.append(new)
                    waiting = waiting[~near]
                    if not len(waiting):
                        break
    return found


def _links(keys: np.ndarray, fps: np.ndarray, bits: int, near: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal ``keys``: small groups all at once by shifted comparison, larger ones one by one."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    small = np.repeat(sizes <= near, sizes)
    a, b = [], []
    for shift in range(1, near):
        if len(keys) <= shift:
            break
        hit = np.flatnonzero(
            (keys[shift:] == keys[:-shift]) & small[shift:] & (fps[shift:] != fps[:-shift])
            & (np.bitwise_count(fps[shift:] ^ fps[:-shift]) <= bits))
        a.append(fps[hit])
        b.append(fps[hit + shift])
    for start, size in zip(starts[sizes > near], sizes[sizes > near], strict=True):
        for one, two in _tree(fps[start:start + size], bits):
            a.append(one)
            b.append(two)
    empty = np.empty(0, np.uint64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def _compare(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out(rows):
            anchor, part, fps = (np.concatenate(x) for x in zip(*rows, strict=True))
            # one number for each (anchor, part), as they come sorted
            new = np.r_[False, (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])]
            a, b = _links(np.cumsum(new), fps, bits)
            return pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, part, fps = (batch.column(i).to_numpy() for i in range(3))
            fps = fps.view(np.uint64)
            # the last group may go on in the next batch
            last = (anchor == anchor[-1]) & (part == part[-1])
            cut = int(np.argmax(last))
            if cut:
                yield out([*held, (anchor[:cut], part[:cut], fps[:cut])])
                held = []
            held.append((anchor[cut:], part[cut:], fps[cut:]))
            if len(held) > 1 and (held[0][0][0], held[0][1][0]) != (anchor[-1], part[-1]):
                yield out(held[:-1])
                held = held[-1:]
        if held:
            yield out(held)

    return run


def fingerprint_links(fingerprints: DataFrame, bits: int = MAX_BITS, hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """``a, b``: links enough to connect all distinct ``fp`` that are ``bits`` (3 at most) apart or less."""
    if not 0 <= bits <= MAX_BITS:
        raise ValueError(f"the anchors cover up to {MAX_BITS} differing bits")
    rows = _split_hot(anchor_rows(fingerprints), hot_anchor)
    return rows.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(
        _compare(bits), "a bigint, b bigint")


def near_duplicates(
    alerts: DataFrame, words: int = 5, bits: int = MAX_BITS, hot_anchor: int = HOT_ANCHOR,
) -> DataFrame:
    """Groups of alerts whose notes nearly say the same.

    ``alerts`` has ``id`` and ``notes`` (violation or density alert log); other
    columns are not read. A note's fingerprint is the SimHash of its shingles of
    ``words`` words (ASCII upper case lowered, a shorter note is one shingle, one
    without words has fingerprint zero and is linked like any other). Notes are
    linked at ``bits`` differing bits or fewer; 3 bits of 64 stand for a cosine
    of about 0.99 between shingle sets, well above a similarity of 0.8.

    Returns a row per alert, ``id, fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id it reaches through links, itself included
    (null ids are passed over; null if there is no other). Null notes count as
    empty, rows that repeat are a group, an empty log gives no rows.

    Copies fall together first, so anchors hold distinct fingerprints only, and
    within an anchor's group only a spanning tree of the links is put out.
    """
    marked = cut_lineage(fingerprint_notes(alerts, words))
    distinct = cut_lineage(marked.groupBy(F.col("fingerprint").alias("fp")).agg(
        F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")), narrow=True)
    roots = components(fingerprint_links(distinct.select("fp"), bits, hot_anchor))
    rooted = cut_lineage(
        distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root")), narrow=True)
    release(distinct)
    # the number of fingerprints under a root is what its key weighs in the join
    least = cut_lineage(
        rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("weight")), narrow=True)
    named = cut_lineage(
        spread_join(rooted, least, ["root"], "weight", ["component_id"], F.col("fp"))
        .select(F.col("fp").alias("fingerprint"), "component_id", "n"), narrow=True)
    release(rooted, least)
    return spread_join(marked, named, ["fingerprint"], "n", ["component_id"], F.col("id")).select(
        "id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
