"""Notes rewritten for fill-in-the-middle training, cut between tokens, and back again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Per cent of notes from which on they stay plain, and up to which of the others the suffix comes first.
PLAIN_FROM, SUFFIX_FIRST = 90, 20
#: Bytes of notes that are put out together, about.
OUT_BYTES = 1 << 23

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class WideIndex:
    """Where a UTF-8 text is not ASCII: places and excess bytes of its multibyte characters, and nothing else.

    Between two of them a code point is a byte, so a place in one count becomes
    a place in the other by the excess of the multibyte characters before it,
    found with a binary search. A text of ASCII alone has an empty index.
    """

    def __init__(self, data: np.ndarray):
        self.bytes = np.flatnonzero(data >= 0xC0)
        lead = data[self.bytes]
        excess = np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))
        self.excess = np.concatenate([[0], excess])
        self.points = self.bytes - self.excess[:-1]

    def to_points(self, places: np.ndarray) -> np.ndarray:
        """Byte places (at the start of a character or at the end) as numbers of code points before them."""
        return places - self.excess[np.searchsorted(self.bytes, places, "left")]

    def to_bytes(self, places: np.ndarray) -> np.ndarray:
        return places + self.excess[np.searchsorted(self.points, places, "left")]


def token_starts(data: np.ndarray) -> np.ndarray:
    """Byte places of the tokens ``[A-Za-z]+|[^A-Za-z]``: a run of letters, or one other character."""
    letter = _LETTER[data]
    start = ~letter & ((data & 0xC0) != 0x80)
    start |= letter & ~np.concatenate([[False], letter[:-1]])
    return np.flatnonzero(start)


def _draws(record_id: object, seed: int) -> tuple[int, int, int, int]:
    text = f"{seed}:{'' if record_id is None else record_id}"
    found = hashlib.sha256(text.encode()).hexdigest()
    return tuple(int(found[k:k + 8], 16) for k in range(0, 32, 8))


def rewrite(text: bytes, record_id: object, seed: int, unit: str) -> tuple[int, str, tuple[int, int] | None, bytes]:
    """``n, form, (code points of the prefix, of the middle), output`` of one note in UTF-8."""
    data = np.frombuffer(text, np.uint8)
    index = WideIndex(data)
    if unit == "token":
        starts = token_starts(data)
        n = len(starts)
    else:
        n = len(data) - int(index.excess[-1])
    one, two, plain, first = _draws(record_id, seed)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or plain % 100 >= PLAIN_FROM:
        return n, "plain", None, text
    cuts = np.array(sorted((one % (n + 1), two % (n + 1))))
    if unit == "token":
        at = np.concatenate([starts, [len(data)]])[cuts]
        points = index.to_points(at)
    else:
        points, at = cuts, index.to_bytes(cuts)
    a, b = (int(x) for x in at)
    head, middle, tail = text[:a], text[a:b], text[b:]
    chars = (int(points[0]), int(points[1] - points[0]))
    if first % 100 < SUFFIX_FIRST:
        return n, "spm", chars, b"".join((SUFFIX, tail, PREFIX, head, MIDDLE, middle))
    return n, "psm", chars, b"".join((PREFIX, head, SUFFIX, tail, MIDDLE, middle))


def fill_in_middle(alerts: DataFrame, seed: int = 1, unit: str = "token") -> DataFrame:
    """Cut each alert's notes into prefix, middle and suffix, and put the middle last.

    ``alerts`` has ``id`` and ``notes`` (violation or density alert log); other
    columns are not read. The two cuts lie between units, drawn evenly from the
    SHA-256 of ``seed:id`` (nothing after the colon where the id is null): tokens
    (``unit="token"``, runs of ASCII letters or one other character each) or code
    points (``unit="char"``). Of the notes that can be cut about one in ten stays
    plain, and of the others one in five has the suffix first.

    Returns a row per alert: ``id``, ``n`` (units of the whole note), ``form``
    (``plain``, ``psm`` or ``spm``), ``prefix_chars`` and ``middle_chars`` (code
    points, null if plain) and ``filled``: ``<P>``prefix``<S>``suffix``<M>``middle,
    or ``<S>``suffix``<P>``prefix``<M>``middle. Null notes count as empty. An empty
    note and one that contains a mark itself stay plain, which keeps the way back
    (``unfilled``) exact. Rows that repeat give equal rows; an empty log gives none.

    Whole notes are cut as bytes, one at a time; only multibyte characters take
    room in the index from bytes to code points. Nothing is shuffled.
    """
    if unit not in ("token", "char"):
        raise ValueError("unit is token or char")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, notes, begin, size, rows = batch.column("id"), batch.column("notes"), 0, 0, []
            for k in range(batch.num_rows):
                text = notes[k].as_py() or b""
                rows.append(rewrite(text, ids[k].as_py(), seed, unit))
                size += len(text)
                if size >= OUT_BYTES or k + 1 == batch.num_rows:
                    n, form, chars, filled = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([
                        ids.slice(begin, len(rows)), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                        pa.array([c and c[0] for c in chars], pa.int64()),
                        pa.array([c and c[1] for c in chars], pa.int64()),
                        pa.array(filled, pa.binary()).view(pa.string())],
                        names=["id", "n", "form", "prefix_chars", "middle_chars", "filled"])
                    begin, size, rows = k + 1, 0, []

    kind = alerts.schema["id"].dataType.simpleString()
    return alerts.select("id", F.col("notes").cast("binary").alias("notes")).mapInArrow(
        run, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, filled string")


def unfilled(filled: Column, form: Column) -> Column:
    """The notes as they were before ``fill_in_middle``."""
    # pieces hold no mark, and no mark can begin inside another, so this finds the three marks only
    part = F.split(filled, "<[PSM]>", -1)
    one, two, three = (F.get(part, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(filled)
