"""Packing tokenised notes into sequences of fixed capacity, best fit first."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.session import cut_lineage

CAPACITY = 2_048
END_ID = 0
#: Pieces that one tree of bins takes, on average: thousands, so that hardly a bin per group is left less full.
PIECES_PER_GROUP = 4_096

# ---- tokens


#: Words whose tokens are remembered in a Python worker; when there are more, the older half goes.
REMEMBERED = 600_000
#: A word of plain Latin letters (such that have one lower-case letter each), with ASCII punctuation behind or none.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ž]+)([!-/:-@\[-`{-~]*)")
_TOGETHER = 256
#: Texts of these characters alone read the same in lower case, and with a full stop or comma set off from letters.
_COMMON = re.compile(r"[\x00-\x7FÀ-ÖØ-öø-įı-ž]*")
_STOP = re.compile(r"[.,](?=[ \n])(?<=[a-z0-9à-öø-įı-ž][.,])")


def _words(text: str) -> list[str]:
    if "<|" not in text and _COMMON.fullmatch(text):  # else it may hold a special token, which has its own case
        text = _STOP.sub(r" \g<0>", text.lower())
    return text.replace("\n", " ").split(" ")


class WordTokens:
    """Token ids of texts as bytes (little-endian, 32 bits each), remembered word by word.

    For tokenizers that put white space away and never join what it separates
    (as word-level BPE does): then a text's ids are those of its words, one after
    the other. Only spaces and line feeds are cut at here; anything between two
    of these goes to the tokenizer as it is.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remembered, self.new, self.old = remembered, {}, {}
        suffix = self.tokenizer.model.end_of_word_suffix
        vocabulary = self.tokenizer.get_vocab()
        self.ends = None
        if suffix:
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for word, i in vocabulary.items() if word.endswith(suffix)]] = True

    def _one_by_one(self, words: list[str]) -> None:
        for word, found in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.new[word] = np.array(found.ids, "<u4").tobytes()

    def _together(self, words: list[str]) -> None:
        """Words of plain letters in one go: the marks at word ends tell where each one's ids stop."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):  # not such words after all
            self._one_by_one(words)
            return
        start, raw = 0, ids.tobytes()
        for word, stop in zip(words, (4 * stops).tolist(), strict=True):
            self.new[word] = raw[start:stop]
            start = stop

    def learn(self, texts: list[list[str]]) -> None:
        """Make sure that all words of the texts are remembered."""
        if len(self.new) > self.remembered // 2:
            self.old, self.new = self.new, {}
        unknown: set[str] = set()
        for words in texts:
            unknown.update(set(words).difference(self.new))
        for word in [w for w in unknown if w in self.old]:
            self.new[word] = self.old[word]
            unknown.discard(word)
        # a plain word's ids are those of its letters in lower case, then those of the punctuation behind them
        plain, bases, tails, rest = [], [], [], []
        for word in unknown:
            parts = self.ends is not None and _PLAIN.fullmatch(word)
            if parts:
                plain.append(word)
                bases.append(parts[1].lower())
                tails.append(parts[2])
            else:
                rest.append(word)
        needed = list(set(bases).difference(self.new))
        for at in range(0, len(needed), _TOGETHER):
            self._together(needed[at:at + _TOGETHER])
        rest += set(tails).difference(self.new, rest)
        if rest:
            self._one_by_one(rest)
        new = self.new
        new.update(zip(plain, [new[base] + new[tail] for base, tail in zip(bases, tails, strict=True)], strict=True))

    def encode(self, texts: list[str], block: int = 1 << 21) -> Iterator[bytes]:
        """Ids of each text, in order; texts are split about ``block`` characters at a time."""
        held, chars = [], 0
        for text in texts:
            held.append(_words(text))
            chars += len(text)
            if chars >= block:
                yield from self._flush(held)
                held, chars = [], 0
        yield from self._flush(held)

    def _flush(self, held: list[list[str]]) -> Iterator[bytes]:
        self.learn(held)
        for words in held:
            yield b"".join(map(self.new.__getitem__, words))


_LOADED: dict[str, WordTokens] = {}


def _tokens(path: str) -> WordTokens:
    # once per worker: it serves many tasks
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]


def note_pieces(
    alerts: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False,
) -> DataFrame:
    """The notes as pieces of ``capacity`` tokens: ``id, piece, start, length, ids_crc32`` and, if asked, ``ids``.

    ``tokenizer`` is the path of a tokenizer file at every executor, see
    ``WordTokens`` for which ones. An alert's ids are those of its whole ``notes``
    without special tokens (null: empty), then ``end_id``. Only notes with more
    than ``capacity`` ids are cut; the last piece may be shorter. ``ids`` holds
    the ids as bytes (unsigned, little-endian, 32 bits), ``ids_crc32`` their check
    number, and ``start`` the number of the note's ids before the piece.
    """
    end = np.array([end_id], "<u4").tobytes()
    kind = alerts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column("notes").to_pylist()]
            rows, pieces, starts, lengths, checks, own = [], [], [], [], [], []
            for at, ids in enumerate(tokens.encode(texts)):
                ids += end
                for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start:start + 4 * capacity]
                    rows.append(at)
                    pieces.append(k)
                    starts.append(start // 4)
                    lengths.append(len(part) // 4)
                    checks.append(zlib.crc32(part))
                    if with_ids:
                        own.append(part)
            columns = [batch.column("id").take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()),
                       pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(checks, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(own, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return alerts.select("id", "notes").mapInArrow(
        run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


# ---- bins


class OpenBins:
    """Open bins by remaining capacity, in a segment tree that tells which capacities have a bin."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.some = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, number: int) -> None:
        self.bins[room].append(number)
        if len(self.bins[room]) == 1:
            self._mark(room, 1)

    def _mark(self, room: int, value: int) -> None:
        at = room + self.size
        self.some[at] = value
        while at > 1:
            at //= 2
            value = self.some[2 * at] | self.some[2 * at + 1]
            if self.some[at] == value:
                break
            self.some[at] = value

    def take(self, length: int) -> tuple[int, int] | None:
        """Room and number of the tightest bin with ``length`` left at least, taken out; None if there is none."""
        some, at = self.some, length + self.size
        if not some[at]:
            # up until a subtree on the right has a bin, then down its left-most one
            while at > 1 and (at & 1 or not some[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if some[2 * at] else 2 * at + 1
        room = at - self.size
        number = self.bins[room].pop()
        if not self.bins[room]:
            self._mark(room, 0)
        return room, number


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; the lengths have to fall."""
    bins, offsets, opened = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    tree = OpenBins(capacity)
    for at, length in enumerate(lengths.tolist()):
        found = tree.take(length) if length <= capacity else None
        if found is None:
            room, number = max(capacity, length), opened
            opened += 1
        else:
            room, number = found
        bins[at], offsets[at] = number, capacity - room if length <= capacity else 0
        if room - length > 0:
            tree.add(room - length, number)
    return bins, offsets


def pack_pieces(
    pieces: DataFrame, capacity: int = CAPACITY, pieces_per_group: int = PIECES_PER_GROUP,
) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; sequences are gapless from 0 and hold ``capacity`` at most.

    ``pieces`` is a written table with ``id, piece, length`` (as ``note_pieces``
    gives, without the ids: only numbers are shuffled). Its rows are dealt by hash
    to groups of about ``pieces_per_group``, whatever their source, and each group
    is packed by best fit decreasing: the longest piece first, each to the
    tightest open bin that holds it, found in a segment tree over the remaining
    capacities in log2(capacity) steps. Within some thousand pieces this is near
    the least number of bins, and joining groups could save one bin each at most.
    """
    groups = max(1, round(pieces.count() / pieces_per_group))

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(
            rows, sort_keys=[("length", "descending"), ("id", "ascending"), ("piece", "ascending")]))
        bins, offsets = best_fit_decreasing(rows["length"].to_numpy(), capacity)
        numbers = bins * groups + rows["__group"].to_numpy()
        return rows.drop_columns(["__group"]).append_column("sequence_id", pa.array(numbers)).append_column(
            "offset", pa.array(offsets))

    plain = pieces.drop("sequence_id", "offset")
    dealt = plain.withColumn("__group", F.pmod(F.xxhash64("id", "piece", "length"), F.lit(groups)).cast("int"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return dealt.groupBy("__group").applyInArrow(pack, f"{fields}, sequence_id bigint, offset bigint")


def pack_notes(
    alerts: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
    pieces_per_group: int = PIECES_PER_GROUP,
) -> DataFrame:
    """Pack the notes of alerts (``id, notes``) into sequences of ``capacity`` tokens, as few as best fit finds.

    Returns a row per piece: ``id, piece, start, length, ids_crc32, sequence_id,
    offset``. Null and empty notes are a piece of one id; repeated rows are packed
    each; an empty log gives no rows; other columns are not read. See
    ``note_pieces`` and ``pack_pieces``.
    """
    return pack_pieces(cut_lineage(note_pieces(alerts, tokenizer, capacity, end_id)), capacity, pieces_per_group)
