"""Personal data in the notes of alerts: proposed by patterns, confirmed by checksums, weighed by the words around."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

BASE, ADDED = ("email", "ip", "card", "phone"), ("iban", "number")
KINDS = BASE + ADDED

#: What the form alone says, what a checksum adds, and what words nearby add or take.
FORM = {"email": 0.7, "ip": 0.4, "card": 0.3, "phone": 0.5, "iban": 0.4, "number": 0.3}
CONFIRMED = {"ip": 0.2, "card": 0.4, "iban": 0.4}
NEAR = 0.3
#: Added kinds are put out from this score on. Base kinds always are.
LEAST = 0.6
#: Code points before a span, and after it, in which words count.
BEFORE, AFTER = 48, 24

# ---- fixed values: words that speak for a kind in English, German, French and Spanish, and against any number
WORDS = {
    "email": {"mail", "email", "e-mail", "contact", "contacto", "kontakt", "correo", "courriel"},
    "ip": {"ip", "host", "server", "client", "address", "adresse", "serveur", "servidor", "dirección"},
    "card": {"card", "credit", "debit", "visa", "mastercard", "karte", "kreditkarte", "carte", "tarjeta"},
    "phone": {"phone", "telephone", "tel", "mobile", "call", "fax", "telefon", "handy", "téléphone", "teléfono", "móvil"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta"},
}
WORDS["number"] = WORDS["phone"]
AGAINST = {"version", "invoice", "order", "ticket", "isbn", "serial", "rechnung", "facture", "factura", "commande", "pedido"}
#: Code points of an account number by country.
IBAN_SIZES = {
    "AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "HU": 28,
    "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24,
}

# the patterns start only where a run of their characters does, and never go back into one: linear in the text
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
_NUMBER = re.compile(r"(?<![A-Za-z0-9+.])\(?[0-9][0-9\x20()./-]{4,22}[0-9](?![A-Za-z0-9])")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            free = m.end()


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        # three digits at most, but for zeros in front
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = _digits(m[0]) if m.end() - m.start() <= 37 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        size = IBAN_SIZES.get(m[0][:2])
        if size is None:
            continue
        at, found = m.end(), m[0]
        while len(found) < size and at < len(text):
            step = 1 + (text[at] == " ")
            c = text[at + step - 1:at + step]
            if not ("0" <= c <= "9" or "A" <= c <= "Z"):
                break
            found, at = found + c, at + step
        ends = at == len(text) or not (text[at].isascii() and text[at].isalnum())
        if len(found) == size and ends and mod97(found):
            yield m.start(), at


def _numbers(text: str) -> Iterator[tuple[int, int]]:
    for m in _NUMBER.finditer(text):
        if 7 <= sum("0" <= c <= "9" for c in m[0]) <= 12:
            yield m.span()


_FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "number": _numbers}


def _score(text: str, kind: str, start: int, end: int) -> float:
    around = _WORD.findall(text[max(0, start - BEFORE):start].lower()) + _WORD.findall(text[end:end + AFTER].lower())
    tuned = NEAR * (not WORDS[kind].isdisjoint(around)) - NEAR * (not AGAINST.isdisjoint(around))
    return round(min(1.0, max(0.0, FORM[kind] + CONFIRMED.get(kind, 0.0) + tuned)), 3)


def find_spans(text: str) -> list[Span]:
    """All spans of one text, by kind as listed and then by start."""
    found = []
    for kind in BASE:
        found += [Span(kind, a, b, _score(text, kind, a, b)) for a, b in _FINDERS[kind](text)]
    taken = sorted((s.start, s.end) for s in found)
    starts, ends, most = [s for s, _ in taken], [], 0
    for _, end in taken:  # base spans of different kinds may overlap
        most = max(most, end)
        ends.append(most)
    for kind in ADDED:
        fresh = []
        for a, b in _FINDERS[kind](text):
            before = bisect_left(starts, b)
            score = _score(text, kind, a, b)
            if score >= LEAST and not (before and ends[before - 1] > a):
                fresh.append(Span(kind, a, b, score))
        found += fresh
    return found


def scan_personal_data(alerts: DataFrame) -> DataFrame:
    """Spans of personal data in the alerts' notes.

    ``alerts`` has ``id`` and ``notes`` (violation or density alert log); other
    columns are not read. Patterns propose spans, leftmost and without overlap
    within a kind: mail addresses, IP addresses, card numbers (13 to 19 digits)
    and phone numbers (``+``, 9 to 15 digits). Validators confirm them: parts of
    an IP address up to 255, Luhn's sum for cards, numbers of digits; what fails
    is dropped and not tried again in another length. Two kinds are added where
    no span of these four lies: account numbers (``iban``: length by country, sum
    modulo 97) and numbers in national form (``number``, 7 to 12 digits).

    Each span has a score of 0 to 1: what its form says, more if a sum confirms
    it, more if one of the kind's words stands nearby, less if a word for another
    sort of number does. The four base kinds are put out whatever their score,
    added kinds from ``LEAST`` on; a national number needs a word in its favour.

    Returns a row per alert: ``id``, ``n_email, n_ip, n_card, n_phone, n_added`` and
    ``spans``, an array of ``kind, start, end, score`` (code points, end
    exclusive) by kind as listed, then start. Null notes count as empty, rows that
    repeat give equal rows, an empty log gives none. Work is linear in a note.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [find_spans(text.as_py() or "") for text in batch.column("notes")]
            counts = [[sum(s.kind == kind for s in one) for one in spans] for kind in BASE]
            added = [sum(s.kind in ADDED for s in one) for one in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array(c, pa.int64()) for c in (*counts, added)],
                 pa.array([[s._asdict() for s in one] for one in spans], pa.list_(pa.struct(
                     [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))],
                names=["id", "n_email", "n_ip", "n_card", "n_phone", "n_added", "spans"])

    kind = alerts.schema["id"].dataType.simpleString()
    return alerts.select("id", "notes").mapInArrow(
        run, f"id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, n_added bigint, "
             "spans array<struct<kind: string, start: bigint, end: bigint, score: double>>")
