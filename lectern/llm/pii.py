"""Personal data in whole texts: plain identifiers, and disguised ones found through an offset-preserving normalisation.

Base spans are the leftmost non-overlapping matches of a pattern for each kind; matches that fail the kind's check are
dropped and not tried again. Then transducers rewrite the text: look-alike characters and digits of other scripts become
ASCII, characters of no width go, runs of spelled digits become digits, and written-out at, dot and plus signs become the
signs. Each character of the rewritten text keeps the range of source characters it stands for. Identifiers found in the
rewritten text that rest on a rewritten character, and don't overlap a base span of their kind, are mapped back to the
source and added. Offsets are code points, end exclusive.

All searches take time in proportion to the text, also on runs of a million spaces, digits, dots or letters: base matches
are found from the sign, dot or plus that they need, each run of characters being read once, and the disguised forms have
bounds (labels of 63 characters, names of 64, three spaces between their parts).

Null texts count as empty and have no spans; equal rows give equal results; texts are read whole, however long; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import string
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import texts

KINDS = ("email", "ip", "card", "phone")
#: What the base patterns find, apart from their checks; `emails` and `addresses` give the same matches in linear time.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NAME_CHARACTERS = string.ascii_letters + string.digits + "._%+-"
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# any numbers with single dots between them: too few are no match, but a run of digits is read just once
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
# any run of digits with single spaces or hyphens between them: of one digit it is no match, and too short to be valid
_CARD = re.compile(r"[0-9]+(?:[\x20-][0-9]+)*")
_PHONE = re.compile(PATTERNS["phone"])
SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"

# Letters of other scripts that look like ASCII letters, and words for digits and signs in four languages.
LOOKALIKES = dict(zip("аеорсухіјѕԁһӏԛԝгпкмтвнАВЕКМНОРСТУХІЈЅαορνικτυεχΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɡ", "aeopcyxijsdhlqwrnkmtbhABEKMHOPCTYXIJSaopviktuexABEZHIKMNOPTYXig", strict=True))
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Last labels that a host needs where no sign is bracketed, lest "look at the dot on" be one.
ENDINGS = "com|org|net|edu|gov|info|biz|io|co|dev|ai|app|me|uk|de|fr|es|it|nl|eu|ch|at|us|ca|au|mx|ar|br|in|jp|test|example|invalid"
AT, DOT, PLUS = "at|arroba|arobase|klammeraffe", "dot|punkt|punto|point|period", "plus|más"

_WIDTHLESS = "­​‌‍⁠﻿"
_DASHES = "‐‑‒–—−"
_DIGIT = "|".join(sorted(DIGITS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?i)(?<!\w)(?:{_DIGIT})(?:[\x20-]{{1,2}}(?:{_DIGIT}|[0-9]+)(?!\w))*(?!\w)")
# A spelled digit next to a digit, another spelled one or a written sign: no identifier rests on any other.
_SPELLED_HINT = re.compile(rf"(?i)\b(?:{_DIGIT})\b[\x20().-]*(?:[0-9]|(?:{_DIGIT}|{DOT})\b)|[0-9+][\x20().-]*(?:{_DIGIT})\b|\b(?:{DOT}|{PLUS})\x20*(?:{_DIGIT})\b")
_DIGIT_WORD = re.compile(rf"(?i)(?:{_DIGIT})|[0-9]+")
_BRACKETED = re.compile(rf"(?i)(?:\x20{{1,3}}|(?<!\x20)|(?<=\x20\x20\x20))[\[({{<_]\x20{{0,3}}(?:({AT}|@)|({DOT}|\.))\x20{{0,3}}[\])}}>_]\x20{{0,3}}")
_NAMED = re.compile(rf"(?i)(?<![\w.%+@-])([a-z0-9._%+-]{{1,64}})\x20{{1,3}}(?:{AT}|@)\x20{{1,3}}([a-z0-9-]{{1,63}})((?:(?:\x20{{1,3}}(?:{DOT})\x20{{1,3}}|\.)[a-z0-9-]{{1,63}}){{0,8}}(?:\x20{{1,3}}(?:{DOT})\x20{{1,3}}|\.)(?:{ENDINGS}))(?![\w@])")
_NAMED_HINT = re.compile(rf"(?i)\x20(?:{AT}|@|{DOT})\x20")
_SIGN_WORD = re.compile(rf"(?i)\x20{{1,3}}(?:({AT}|@)|({DOT}))\x20{{1,3}}")
_HALF = re.compile(rf"(?i)(?<![\w.%+-])[a-z0-9._%+-]{{1,64}}@[a-z0-9-]{{1,63}}(?:\.[a-z0-9-]{{1,63}}){{0,8}}(?:\x20{{1,3}}(?:{DOT})\x20{{1,3}}[a-z0-9-]{{1,63}}){{1,8}}")
_DIGIT_DOT = re.compile(rf"(?i)(?<=[0-9])\x20{{0,3}}(?:{DOT})\x20{{0,3}}(?=[0-9])")
_PLUS = re.compile(rf"(?i)(?<!\w)(?:{PLUS})\x20{{0,3}}(?=[0-9])")
_ODD = re.compile("[" + "".join(LOOKALIKES) + _WIDTHLESS + _DASHES + r"  ！-～٠-٩۰-۹०-९․﹒﹫⁰-⁹₀-₉①-⑨\U0001d400-\U0001d7ff]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _valid(kind: str, s: str) -> bool:
    if kind == "ip":
        # by length first: a part may have any number of digits
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))
    if kind == "card":
        d = _digits(s) if len(s) < 38 else ""
        return 16 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 8 <= len(_digits(s)) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of the email pattern: for each sign that no match took, the name before it back to the last match, and
    the host after it."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(_NAME_CHARACTERS))
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
        free = host.end() if host else at + 1
        at = text.find("@", free)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """The matches of the ip pattern: four by four of the numbers that single dots join."""
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[i : i + 4])) + 3
            yield at, at + size
            at += size + 1


def matches(kind: str, text: str) -> Iterator[tuple[int, int]]:
    if kind == "email":
        return emails(text)
    if kind == "ip":
        return addresses(text)
    return (m.span() for m in (_CARD if kind == "card" else _PHONE).finditer(text))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind in KINDS:
        if kind == "phone" and "+" not in text:
            continue
        # a match shorter than the least number of digits can't be valid, so it needn't be looked at
        least = 16 if kind == "card" else 0
        out += [(kind, i, j) for i, j in matches(kind, text) if j - i >= least and _valid(kind, text[i:j])]
    return out


class Rewritten:
    """A text with, for each character, the source range it stands for and whether it was rewritten."""

    def __init__(self, text: str, first: np.ndarray | None = None, end: np.ndarray | None = None, changed: np.ndarray | None = None):
        self.text = text
        self.first = np.arange(len(text), dtype=np.int32) if first is None else first
        self.end = self.first + np.int32(1) if end is None else end
        self.changed = np.zeros(len(text), dtype=bool) if changed is None else changed

    def copy(self) -> Rewritten:
        return Rewritten(self.text, self.first, self.end, self.changed)

    def apply(self, pattern: re.Pattern, to: Callable[[re.Match], list[tuple[str, int, int]]]) -> None:
        """Replaces each match by characters (character, first, end), places in the text as it is."""
        out, last = [], 0
        # of each new character the first and last character it stands for, and whether it is another one
        begin, until, fresh = array("i"), array("i"), bytearray()
        for m in pattern.finditer(self.text):
            if last < m.start():
                out.append(self.text[last : m.start()])
                begin.extend(range(last, m.start()))
                until.extend(range(last, m.start()))
                fresh.extend(bytes(m.start() - last))
            for c, i, j in to(m):
                out.append(c)
                begin.append(i)
                until.append(j - 1)
                fresh.append(j - i != 1 or self.text[i] != c)
            last = m.end()
        if last:
            rest = np.arange(last, len(self.text), dtype=np.int32)
            a, b = (np.concatenate([np.frombuffer(x, dtype=np.int32), rest]) for x in (begin, until))
            self.text = "".join([*out, self.text[last:]])
            self.first, self.end, self.changed = self.first[a], self.end[b], self.changed[a] | np.concatenate([np.frombuffer(bytes(fresh), dtype=bool), np.zeros(len(rest), dtype=bool)])

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        i, j = int(self.first[start]), int(self.end[end - 1])
        return i, j, bool(self.changed[start:end].any()) or j - i != end - start


def _plain(c: str) -> str:
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c in _WIDTHLESS:
        return ""
    if c in _DASHES:
        return "-"
    return unicodedata.normalize("NFKC", c)[:1]


def _odd(m: re.Match) -> list[tuple[str, int, int]]:
    c = _plain(m[0])
    return [(c, m.start(), m.end())] if c else []


def _spell(m: re.Match) -> list[tuple[str, int, int]]:
    words = list(_DIGIT_WORD.finditer(m[0]))
    if len(words) < 2 and len(m[0]) > 1 and not m[0][0].isdigit():
        return [(DIGITS[m[0].lower()], m.start(), m.end())]
    out = []
    for w in words:
        if w[0].isdigit():
            out += [(c, m.start() + w.start() + i, m.start() + w.start() + i + 1) for i, c in enumerate(w[0])]
        else:
            out.append((DIGITS[w[0].lower()], m.start() + w.start(), m.start() + w.end()))
    return out


def _signs(m: re.Match) -> list[tuple[str, int, int]]:
    """A match whose written-out signs become signs; all else stays."""
    out, last, at = [], 0, m.start()
    for s in _SIGN_WORD.finditer(m[0]):
        out += [(c, at + last + i, at + last + i + 1) for i, c in enumerate(m[0][last : s.start()])]
        out.append(("@" if s[1] else ".", at + s.start(), at + s.end()))
        last = s.end()
    return out + [(c, at + last + i, at + last + i + 1) for i, c in enumerate(m[0][last:])]


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    odd = not text.isascii() and _ODD.search(text)
    bracketed = _BRACKETED.search(text)
    named = _NAMED_HINT.search(text) and (_NAMED.search(text) or "@" in text and _HALF.search(text))
    r = None
    if odd or bracketed or named:
        r = Rewritten(text)
        if odd:
            r.apply(_ODD, _odd)
        r.apply(_BRACKETED, lambda m: [("@" if m[1] else ".", m.start(), m.end())])
        r.apply(_NAMED, _signs)
        r.apply(_HALF, _signs)
    # what the digit view would rewrite is looked for in the text that it would rewrite
    body = r.text if r else text
    spelled = odd or _SPELLED_HINT.search(body) or _DIGIT_DOT.search(body) or _PLUS.search(body)
    if not (r or spelled):
        return []
    r = r or Rewritten(text)
    views = [r]
    if spelled:
        digits = r.copy()
        digits.apply(_SPELLED, _spell)
        digits.apply(_DIGIT_DOT, lambda m: [(".", m.start(), m.end())])
        digits.apply(_PLUS, lambda m: [("+", m.start(), m.end())])
        views.append(digits)
    found: list[tuple[str, int, int]] = []
    taken: dict[str, list[tuple[int, int]]] = {k: sorted((s, e) for kind, s, e in base if kind == k) for k in KINDS}
    for view in views:
        for kind, i, j in base_spans(view.text):
            start, end, changed = view.source(i, j)
            # spans of a kind don't overlap, so only the neighbours in their order can
            beside, at = taken[kind], bisect_left(taken[kind], (start, end))
            if changed and not any(start < e and s < end for s, e in beside[max(0, at - 1) : at + 1]):
                found.append((kind, start, end))
                beside.insert(at, (start, end))
    return found


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all) and n_added of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            sha, spans, added = [], [], []
            for text in b.column("text").to_pylist():
                base = base_spans(text)
                more = added_spans(text, base)
                for k in KINDS:
                    counts[k].append(sum(x[0] == k for x in base))
                sha.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(base + more))
                added.append(len(more))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return texts(docs).select("doc_id", "text").mapInArrow(run, SCHEMA)


def redact(docs: DataFrame) -> DataFrame:
    """docs whose text has every span replaced by its kind in brackets; a null text stays null."""
    @F.pandas_udf("string")
    def clean(text: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            base = base_spans(t)
            last, out = 0, []
            for k, s, e in sorted(base + added_spans(t, base), key=lambda x: (x[1], -x[2])):
                if s >= last:
                    out += [t[last:s], f"[{k}]"]
                    last = e
            return "".join(out) + t[last:]

        return text.map(one)

    return docs.withColumn("text", clean(F.col("text").cast("string")))
