"""Personal data: anchors found by an Aho-Corasick automaton, expanded and validated by local parsers.

One automaton pass over a text finds at-signs, schemes and identifier cues. Each anchor has a parser that looks only
at its surroundings: e-mail grows left and right of the at-sign, a web address right of its scheme, an account right of its cue.
Addresses and numbers made of digits have no other anchor than their digits; texts without a digit skip those parsers.

Defined results: a null or empty text has no span. Spans of one kind never overlap; spans of different kinds may. Repeated rows
give repeated rows. Offsets are code points, ends are exclusive. Time is linear in the length of a text, also for long runs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("url", "account", "secret")
KINDS = BASE_KINDS + EXTRA_KINDS

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins: inside one, the same dots would follow. This keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_URL = re.compile(r"[^\x00-\x20\"'<>]+")
_ACCOUNT = re.compile(r"(?:\x20?(?:number|no|nr|id)\b)?[\x20:=#.\"']{0,4}([A-Za-z0-9][A-Za-z0-9-]{5,}+)")
#: Printed in groups; where it ends is told by its check digits.
_IBAN = re.compile(r"(?:\x20?(?:number|no|nr|id)\b)?[\x20:=#.\"']{0,4}([A-Za-z]{2}[0-9]{2}(?:[\x20\xa0]?[A-Za-z0-9]){11,30})")
_SECRET = re.compile(r"[\x20:=\"']{1,4}([A-Za-z0-9_/+-]{20,}+)")
#: Lower case that never changes the length; with the two letters of other alphabets that become i and k.
_LOW = {**{c: c + 32 for c in range(65, 91)}, 0x130: 0x69, 0x212A: 0x6B}

#: Anchors and the parser each one starts. Cues of identifiers are compared without case.
ANCHORS = {"@": "email", "://": "url", "www.": "url", "iban": "account", "account": "account", "ssn": "account", "passport": "account", "token": "secret", "api_key": "secret", "apikey": "secret", "secret": "secret", "password": "secret"}
SCHEMES = ("https", "http", "ftps", "ftp")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in ANCHORS.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    """Whether the last digit is the Luhn check digit of the others."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def iban_end(text: str, start: int, end: int) -> int | None:
    """The last end of a group, up to ``end``, where the account number has valid check digits."""
    value = "".join(c for c in text[start:end] if c.isalnum())
    while end > start and len(value) >= 15:
        if not text[end : end + 1].isalnum() and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1:
            return end
        end -= 1
        while not text[end - 1].isalnum():
            end -= 1
        value = value[:-1]
    return None


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str, signs: list[int]) -> Iterator[tuple[int, int]]:
    """E-mail around each at-sign, left to right; a local part does not reach into the match before it."""
    floor = 0
    for at in signs:
        if at < floor:
            continue
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            floor = m.end()
            yield start, floor
        else:
            floor = max(floor, at)  # what stands before a failed sign cannot start a later match


def _urls(text: str, anchors: list[tuple[int, str]]) -> Iterator[tuple[int, int]]:
    floor = 0
    for at, word in anchors:
        if at < floor:
            continue
        start = at
        if word == "://":
            scheme = next((s for s in SCHEMES if text[max(0, at - len(s)) : at].lower() == s), None)
            if scheme is None:
                continue
            start = at - len(scheme)
        elif at and text[at - 1].isalnum():
            continue
        m = _URL.match(text, at + len(word))
        end = m.end() if m else at
        while m and end > m.start() and text[end - 1] in ".,;:!?)]}":
            end -= 1
        if m and end > m.start():
            floor = end
            yield start, end


def _cued(text: str, ends: list[int], rule: re.Pattern, needs_digit: bool) -> Iterator[tuple[int, int]]:
    floor = done = 0
    for at in ends:
        if at + 12 < done:  # within a run that was looked at: no later value begins there (12: what may stand before a value)
            continue
        if needs_digit and (m := _IBAN.match(text, at)) and m.start(1) >= floor and (end := iban_end(text, *m.span(1))):
            floor = done = end
            yield m.start(1), end
            continue
        m = rule.match(text, at)
        done = max(done, m.end(1) if m else 0)
        if m and m.start(1) >= floor and (not needs_digit or sum("0" <= c <= "9" for c in m.group(1)) >= 5):
            floor = m.end(1)
            yield m.span(1)


class Finder:
    """All spans of a text; one per task."""

    def __init__(self) -> None:
        self.automaton = _automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then kind as listed, then end."""
        found: list[tuple[str, int, int]] = []
        signs, urls, accounts, secrets = [], [], [], []
        low = text.lower()
        if len(low) != len(text):  # one capital becomes two letters
            low = text.translate(_LOW)
        for end, (kind, length) in self.automaton.iter(low):
            if kind == "email":
                signs.append(end)
            elif kind == "url":
                urls.append((end - length + 1, "://" if length == 3 else "www."))
            else:
                start = end - length
                if start < 0 or not text[start].isalnum():
                    (accounts if kind == "account" else secrets).append(end + 1)
        found += [("email", *s) for s in _emails(text, signs)]
        if _DIGIT.search(text):
            found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") < 256 for p in m.group().split("."))]
            found += [("card", *m.span()) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
            found += [("account", *s) for s in _cued(text, accounts, _ACCOUNT, True)]
        found += [("url", *s) for s in _urls(text, urls)]
        found += [("secret", *s) for s in _cued(text, secrets, _SECRET, False)]
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, done = [], 0
    k = 0
    while k < len(spans):
        kind, start, end = spans[k]
        while k + 1 < len(spans) and spans[k + 1][1] < end:
            k += 1
            end = max(end, spans[k][2])
        out += [text[done:start], f"[{kind.upper()}]"]
        done, k = end, k + 1
    return "".join(out) + text[done:] if out else text


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array<struct<kind, start, end>> of every row of (doc_id, text); one pass, no shuffle."""
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(kind))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in finder.spans(t or "")] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, schema.field(1).type)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, "doc_id long, spans array<struct<kind string, start long, end long>>")


def redact_pii(docs: DataFrame) -> DataFrame:
    """The same columns with all spans replaced in ``text``; null texts stay null, every row stays."""
    names = docs.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            at = names.index("text")
            texts = [None if t is None else redact(t, finder.spans(t)) for t in (x.as_py() for x in batch.column(at))]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(task, docs.schema)


def pii_report(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans in text form, from ``find_pii``: column functions only."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return find_pii(docs).select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", text), ",").alias("spans"))


def span_digest(spans: list[tuple[str, int, int]]) -> str:
    """Digest of the base spans, as ``pii_report`` writes it."""
    return hashlib.sha256(joined([s for s in spans if s[0] in BASE_KINDS]).encode()).hexdigest()
