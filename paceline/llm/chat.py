"""Dialogues of typed parts as one marked-up text, turn by turn, and back."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
#: Role whose texts are trained on.
LOSS_ROLE = "assistant"

# ---- control strings


_HEAD, _MID, _END = "<|turn|>", "<|text|>", "<|end|>\n"
#: What would be read as control where it stood in a text: the marks here, sentence marks and instruction brackets.
_CONTROL = re.compile(r"<(?=\||/?s>)|\[(?=/?INST\])")


def escape(text: str) -> str:
    """Every backslash doubled, and one set behind the first character of any control string, which so is none."""
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


# ---- parts


@dataclass
class PartVisitor:
    """Flattens the parts of a turn in order: text is escaped, other parts become numbered placeholders.

    ``attachments`` collects for each placeholder its kind, number in the
    dialogue, reference and the tokens that it stands for when it is expanded.
    """

    patch: int = 28
    audio_tokens_per_second: float = 25.0
    tokens_per_page: int = 768
    next_number: int = 0
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> str:
        method = getattr(self, f"visit_{part['kind'] or 'text'}", None)
        if method is None:
            raise ValueError(f"unknown kind of part: {part['kind']}")
        return method(part)

    def visit_text(self, part: dict) -> str:
        return escape(part["text"] or "")

    def visit_image(self, part: dict) -> str:
        across, down = (max(1, math.ceil((part[side] or 0) / self.patch)) for side in ("width", "height"))
        return self._placeholder("image", part, across * down)

    def visit_audio(self, part: dict) -> str:
        return self._placeholder("audio", part, max(1, math.ceil((part["seconds"] or 0.0) * self.audio_tokens_per_second)))

    def visit_document(self, part: dict) -> str:
        return self._placeholder("document", part, max(1, part["pages"] or 0) * self.tokens_per_page)

    def _placeholder(self, kind: str, part: dict, tokens: int) -> str:
        number, self.next_number = self.next_number, self.next_number + 1
        self.attachments.append({"number": number, "kind": kind, "uri": part["uri"], "tokens": tokens})
        return f"<|{kind}:{number}|>"


ATTACHMENT = pa.struct([("number", pa.int32()), ("kind", pa.string()), ("uri", pa.string()), ("tokens", pa.int64())])


def _in_order(turns: DataFrame) -> DataFrame:
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn")


def format_dialogues(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """Dialogues as marked-up text, one row per turn; the turns' texts in order are the dialogue's whole text.

    ``turns`` has ``conv_id, turn, role`` and ``parts`` (array of ``PART``); other
    columns are not read. The reference data of this library has no dialogues, so
    this is general: a dialogue about an alert would have its notes as text parts,
    frames of its evidence clip as image parts with the clip's address as ``uri``,
    and its report as a document part.

    Returns ``conv_id, turn, role, formatted`` (the turn as text: its role, the
    flattened parts, an end mark), ``start`` (its place in the dialogue's text, in
    code points), ``loss_start, loss_end`` (the part of the dialogue's text under
    the loss mask: what a turn of ``loss_role`` says; null for other turns),
    ``attachments`` (number, kind, uri, tokens of each placeholder) and
    ``tokens_expanded`` (sum of these tokens).

    Null roles and texts count as empty, a null part list as no parts, turns of a
    null dialogue as one dialogue; turns of equal number stay in any order. Rows
    stream through the tasks in order, so a dialogue may be of any length; no
    dialogue is held as a whole.
    """
    kinds = {f.name: f.dataType.simpleString() for f in turns.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place, visitor = object(), 0, PartVisitor()
        for batch in batches:
            out: dict[str, list] = {
                n: [] for n in ("role", "formatted", "start", "loss_start", "loss_end", "attachments", "tokens_expanded")}
            for conv, role, parts in zip(*(batch.column(n) for n in ("conv_id", "role", "parts")), strict=True):
                if (conv := conv.as_py()) != now:
                    now, place, visitor = conv, 0, PartVisitor()
                role, visitor.attachments = role.as_py() or "", []
                head = f"{_HEAD}{escape(role)}{_MID}"
                body = "".join(visitor.visit(p) for p in parts.as_py() or [] if p is not None)
                text, masked = f"{head}{body}{_END}", role == loss_role
                out["role"].append(role)
                out["formatted"].append(text)
                out["start"].append(place)
                out["loss_start"].append(place + len(head) if masked else None)
                out["loss_end"].append(place + len(head) + len(body) if masked else None)
                out["attachments"].append(visitor.attachments)
                out["tokens_expanded"].append(sum(a["tokens"] for a in visitor.attachments))
                place += len(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), pa.array(out["role"], pa.string()),
                 pa.array(out["formatted"], pa.string()),
                 *[pa.array(out[n], pa.int64()) for n in ("start", "loss_start", "loss_end")],
                 pa.array(out["attachments"], pa.list_(ATTACHMENT)), pa.array(out["tokens_expanded"], pa.int64())],
                names=["conv_id", "turn", *out])

    return _in_order(turns.select("conv_id", "turn", "role", "parts")).mapInArrow(
        run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, formatted string, start bigint, "
        "loss_start bigint, loss_end bigint, "
        "attachments array<struct<number:int,kind:string,uri:string,tokens:bigint>>, tokens_expanded bigint")


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn, placeholders as they are."""
    if not (formatted.startswith(_HEAD) and formatted.endswith(_END)):
        raise ValueError("not a formatted turn")
    role, mid, text = formatted[len(_HEAD):-len(_END)].partition(_MID)
    if not mid:
        raise ValueError("not a formatted turn")
    return unescape(role), unescape(text)


@dataclass
class _Digest:
    turns: int = 0
    chars: int = 0
    loss_chars: int = 0
    every: object = field(default_factory=hashlib.sha256)
    loss: object = field(default_factory=hashlib.sha256)


def read_back(formatted: DataFrame) -> DataFrame:
    """Check numbers of each dialogue, read back from the output of ``format_dialogues``.

    Returns ``conv_id, n_turns, turns_sha256`` (of role, line feed, text, line feed
    of every turn), ``loss_chars, loss_sha256`` (of all unescaped text under the
    loss mask, taken out of the formatted text by the mask) and
    ``formatted_chars``. Digests are kept up turn by turn, so memory does not grow
    with a dialogue.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(conv, d: _Digest) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], conv_type), *[pa.array([v]) for v in (
                    d.turns, d.every.hexdigest(), d.loss_chars, d.loss.hexdigest(), d.chars)]],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        now, digest, conv_type, any_row = None, _Digest(), None, False
        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for conv, text, start, first, last in zip(*(
                    batch.column(n).to_pylist() for n in ("conv_id", "formatted", "start", "loss_start", "loss_end")),
                    strict=True):
                if any_row and conv != now:
                    yield out(now, digest)
                    digest = _Digest()
                now, any_row = conv, True
                role, said = read_turn(text)
                digest.turns += 1
                digest.chars += len(text)
                digest.every.update(f"{role}\n{said}\n".encode())
                if first is not None:
                    masked = unescape(text[first - start:last - start])
                    digest.loss_chars += len(masked)
                    digest.loss.update(masked.encode())
        if any_row:
            yield out(now, digest)

    rows = formatted.select("conv_id", "turn", "formatted", "start", "loss_start", "loss_end")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "start").mapInArrow(
        run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint")


def text_part(text: Column) -> Column:
    """A column of text as the only part of its turn."""
    return F.array(F.struct(
        F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("uri"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))
