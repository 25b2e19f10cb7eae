"""Personal data by anchor expansion.

One Aho-Corasick automaton finds, in a single pass over a text, the anchors of all kinds at once: at-signs, plus signs, digits,
schemes and account cues. At each anchor a local parser walks out to the boundaries of the email, number, address or account
and validates what it found. The base kinds are exactly the leftmost non-overlapping matches of their patterns;
urls and accounts come on top.

Scale: a map over the documents, each on its own; no shuffle, nothing broadcast but the code.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, own_columns

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
SCHEMES = ("http://", "https://", "ftp://", "mailto:", "tel:")
CUES = ("iban", "account", "acct", "routing", "passport")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'|{}\\^`]+")
_ACCOUNT = re.compile(r"(?:\s+(?:number|no\.?|nr\.?|id))?\s?[:#=]?\s?(?P<id>[A-Z]{0,2}[0-9](?:[\x20-]?[A-Z0-9]){5,33})(?![A-Za-z0-9])")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in DIGITS:
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    for kind, words in (("scheme", SCHEMES), ("cue", CUES)):
        for w in words:
            for form in {w, w.upper(), w.capitalize()}:
                a.add_word(form, (kind, len(w)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    """Whether the digits' checksum is right: every second one from the right doubled, the sum a multiple of ten."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


class Finder:
    """find(text): the spans of each kind, as (start, end) in code points, in order."""

    def __init__(self) -> None:
        self.anchors = _automaton()

    def find(self, text: str) -> dict[str, list[tuple[int, int]]]:
        out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        done = dict.fromkeys(KINDS, 0)  # where the last match of the kind ended, dropped ones too
        for end, (anchor, n) in self.anchors.iter(text):
            at = end + 1 - n
            if anchor == "digit":
                if at >= done["ip"] and (at == done["ip"] or text[at - 1] not in DIGITS):
                    self._ip(text, at, out, done)
                if at >= done["card"]:
                    self._card(text, at, out, done)
            elif anchor == "at":
                self._email(text, at, out, done)
            elif anchor == "plus":
                if at >= done["phone"] and (m := _PHONE.match(text, at)):
                    done["phone"] = m.end()
                    if 9 <= sum(map(DIGITS.__contains__, m[0])) <= 15:
                        out["phone"].append(m.span())
            elif anchor == "scheme":
                self._url(text, at, n, out, done)
            else:
                self._account(text, at, n, out, done)
        return out

    @staticmethod
    def _email(text: str, at: int, out: dict, done: dict) -> None:
        start, least = at, done["email"]
        while start > least and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            done["email"] = m.end()
            out["email"].append((start, m.end()))

    @staticmethod
    def _ip(text: str, at: int, out: dict, done: dict) -> None:
        if m := _IP.match(text, at):
            done["ip"] = m.end()
            if all(map(_small, m.groups())):
                out["ip"].append(m.span())

    @staticmethod
    def _card(text: str, at: int, out: dict, done: dict) -> None:
        if m := _CARD.match(text, at):
            done["card"] = m.end()
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())

    @staticmethod
    def _url(text: str, at: int, n: int, out: dict, done: dict) -> None:
        if at < done["url"] or at and text[at - 1].isalnum():
            return
        if m := _URL.match(text, at + n):
            end = m.end()
            while end > at + n and text[end - 1] in ".,;:!?)]":
                end -= 1
            if end > at + n:
                done["url"] = end
                out["url"].append((at, end))

    @staticmethod
    def _account(text: str, at: int, n: int, out: dict, done: dict) -> None:
        if at < done["account"] or at and text[at - 1].isalnum():
            return
        if (m := _ACCOUNT.match(text, at + n)) and sum(map(DIGITS.__contains__, m["id"])) >= 6:
            done["account"] = m.end("id")
            out["account"].append(m.span("id"))


def listed(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def scan(docs: DataFrame) -> DataFrame:
    """Each row's doc_id, counts of the base kinds, SHA-256 of its base spans, and all spans as kind:start:end, comma-joined.

    A null text counts as an empty one: no spans, and the digest of nothing. Repeated rows get the same answer; other columns take
    no part. Offsets are code points, ends exclusive.
    """

    def make():
        finder = Finder()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [finder.find(t.as_py() or "") for t in batch.column("text")]
            counts = [pa.array([len(f[k]) for f in found], pa.int64()) for k in BASE]
            digests = [hashlib.sha256(listed(f, BASE).encode()).hexdigest() for f in found]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array([listed(f, KINDS) for f in found], pa.string())],
                ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
            )

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), make, f"doc_id {kind}, {', '.join(f'n_{k} bigint' for k in BASE)}, base_sha256 string, spans string")


@own_columns
def redact(docs: DataFrame) -> DataFrame:
    """docs, in their own columns, with each span of the text replaced by its kind in brackets; of overlapping ones the first, longest wins."""

    def make():
        finder = Finder()

        def clean(text: str | None) -> str | None:
            if not text:
                return text
            spans = sorted((a, -b, k) for k, all_ in finder.find(text).items() for a, b in all_)
            out, done = [], 0
            for a, b, k in spans:
                if a >= done:
                    out += [text[done:a], f"[{k.upper()}]"]
                    done = -b
            return "".join([*out, text[done:]])

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = batch.schema.get_field_index("text")
            return batch.set_column(at, "text", pa.array([clean(t.as_py()) for t in batch.column("text")], pa.string()))

        return each

    return map_arrow(docs, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
