"""Personal data: plain detectors, and the same detectors on a deobfuscated text.

Transducers rewrite look-alike characters, spelled digits and disguised at signs and dots, and
remember what each rewritten stretch stood for. Identifiers found in the rewritten text are
mapped back to code points of the source.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match begun inside a run of digits fails as the run's own match does, so it isn't tried.
ADDRESS = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters of other scripts that look like a Latin one.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s",
    "ԁ": "d", "һ": "h", "ո": "n", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "α": "a", "ο": "o", "ρ": "p",
    "ν": "v", "ι": "i", "κ": "k", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I",
    "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "ı": "i", "ⅼ": "l", "ɡ": "g",
}
# Digits as words, in English, German, French and Spanish.
DIGIT_WORDS = (
    ("zero", "null", "zéro", "cero", "oh"),
    ("one", "eins", "un", "uno"),
    ("two", "zwei", "deux", "dos"),
    ("three", "drei", "trois", "tres"),
    ("four", "vier", "quatre", "cuatro"),
    ("five", "fünf", "cinq", "cinco"),
    ("six", "sechs", "six", "seis"),
    ("seven", "sieben", "sept", "siete"),
    ("eight", "acht", "huit", "ocho"),
    ("nine", "neun", "neuf", "nueve"),
)
INVISIBLE = "­​‌‍⁠﻿"
DASHES = "‐‑‒–—−"


def _rewrites() -> dict[int, str]:
    """Characters rewritten one for one: look-alikes, digits of any script, wide forms, dashes."""
    table = {ord(k): v for k, v in LOOK_ALIKES.items()}
    for code in range(0x80, 0x1FBFA):
        c = chr(code)
        if unicodedata.category(c) == "Nd":
            table[code] = str(unicodedata.digit(c))
        elif 0xFF01 <= code <= 0xFF5E or 0x1D400 <= code <= 0x1D7FF:
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and plain.isascii():
                table[code] = plain
    table |= {ord(c): "-" for c in DASHES} | {0xA0: " ", 0x3002: ".", 0xFE52: ".", 0xFE6B: "@"}
    return table


REWRITES = _rewrites()
_REWRITTEN = set(map(chr, REWRITES))
_DIGIT = {w: str(n) for n, words in enumerate(DIGIT_WORDS) for w in words}
_WORD = "(?:" + "|".join(sorted(_DIGIT, key=len, reverse=True)) + ")"
_DOT = r"(?:dot|punkt|point|punto)"
SPELLED = re.compile(
    rf"(?<!\w)(?:plus[ -])?(?:{_WORD}|[0-9]+)(?:(?:[ ,-]{{1,2}}|[ -]{_DOT}[ -])(?:{_WORD}|[0-9]+)){{6,}}(?!\w)", re.I
)
# Three dots, spoken, in brackets or plain, between groups of one to three digits, spelled or not.
_GROUP = rf"(?:[0-9]{{1,3}}(?![0-9])|{_WORD}(?:[ -](?:{_WORD}|[0-9](?![0-9]))){{0,2}}(?![ -](?:{_WORD}|[0-9]+)(?!\w)))"
_GROUP_DOT = rf"(?:[ -]{_DOT}[ -]|[ ]?[\[({{<][ ]?(?:{_DOT}|\.)[ ]?[\])}}>][ ]?|\.)"
SPELLED_ADDRESS = re.compile(rf"(?<![\w.]){_GROUP}(?:{_GROUP_DOT}{_GROUP}){{3}}(?!\w)", re.I)
GROUP_DOT = re.compile(_GROUP_DOT, re.I)
A_GROUP_DOT = re.compile(rf"(?:[ -]{_DOT}[ -]|[\])}}>.][ ]?)(?:{_WORD}|[0-9])", re.I)
SPELLED_PART = re.compile(rf"(plus)|({_DOT})|({_WORD})(?!\w)|([0-9]+)|[ ,-]+", re.I)
A_DIGIT_WORD = re.compile(rf"(?<!\w){_WORD}[ ,-]{{1,2}}(?:{_DOT}[ -])?(?:{_WORD}|[0-9])", re.I)
BRACKET_AT = re.compile(r"[ ]?[\[({<][ ]?(?:at|@|arroba|ät)[ ]?[\])}>][ ]?", re.I)
BRACKET_DOT = re.compile(rf"[ ]?[\[({{<][ ]?(?:{_DOT}|\.)[ ]?[\])}}>][ ]?", re.I)
_AT = r"(?: at | @ |@|[ ]?[\[({<][ ]?(?:at|@|arroba|ät)[ ]?[\])}>][ ]?)"
_DOTS = rf"(?: {_DOT} | \. |[ ]?[\[({{<][ ]?(?:{_DOT}|\.)[ ]?[\])}}>][ ]?)"
SPOKEN = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?:{_DOTS}[A-Za-z0-9_-]+)*{_AT}(?!(?:the|a|an|this|that|my|your|our)\b)[A-Za-z0-9-]+"
    rf"(?:(?:{_DOTS}|\.)[A-Za-z0-9-]+)*{_DOTS}[A-Za-z]{{2,}}(?![A-Za-z0-9-])",
    re.I,
)
A_DOT = re.compile(rf"{_DOTS}[A-Za-z]", re.I)
SPACED_AT = re.compile(r"(?<=[A-Za-z0-9._%+-]) @ (?=(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}(?![A-Za-z0-9-]))")
SPOKEN_PART = re.compile(rf"({_AT})|{_DOTS}", re.I)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Grows the local part leftwards from each at sign, so a long run of letters costs nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            end = domain.end()
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        total += digit if place % 2 == 0 else digit * 2 - 9 * (digit > 4)
    return total % 10 == 0


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every identifier written plainly, by start and kind."""
    found = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    for m in ADDRESS.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = re.sub("[^0-9]", "", m[0])
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _spelled(stretch: str) -> str:
    out = []
    for part in SPELLED_PART.finditer(stretch):
        plus, dot, word, digits = part.groups()
        out.append("+" if plus else "." if dot else _DIGIT[word.lower()] if word else digits or "")
    return "".join(out)


def _address(m: re.Match) -> str:
    return ".".join(_spelled(group) for group in GROUP_DOT.split(m[0]))


def rewritten(text: str) -> tuple[str, list[tuple[int, int, int, int]], set[int]]:
    """The text without disguises; (start, end, source start, source end) of each stretch that
    was replaced, in order; and the places in the source where a look-alike stood."""
    odd = _REWRITTEN.intersection(text)
    places: set[int] = set()
    plain = text
    if odd:
        plain = text.translate(REWRITES)
        places = {i for i, c in enumerate(text) if c in odd}
    edits: list[tuple[int, int, str]] = []
    if any(c in plain for c in INVISIBLE):
        edits += [(i, i + 1, "") for i, c in enumerate(plain) if c in INVISIBLE]
    if A_DIGIT_WORD.search(plain):
        edits += [(m.start(), m.end(), _spelled(m[0])) for m in SPELLED.finditer(plain) if re.search(r"[^\W\d]", m[0])]
    if A_GROUP_DOT.search(plain):
        edits += [(m.start(), m.end(), _address(m)) for m in SPELLED_ADDRESS.finditer(plain) if re.search(r"[^\W\d]", m[0])]
    if " @ " in plain:
        edits += [(m.start(), m.end(), "@") for m in SPACED_AT.finditer(plain)]
    if any(b in plain for b in "[({<"):
        edits += [(m.start(), m.end(), "@") for m in BRACKET_AT.finditer(plain)]
        edits += [(m.start(), m.end(), ".") for m in BRACKET_DOT.finditer(plain)]
    for m in SPOKEN.finditer(plain) if A_DOT.search(plain) else ():
        for part in SPOKEN_PART.finditer(plain, m.start(), m.end()):
            edits.append((part.start(), part.end(), "@" if part[1] else "."))
    edits.sort()
    out, stretches, at, size = [], [], 0, 0
    for start, end, new in edits:
        if start < at:
            continue
        out += [plain[at:start], new]
        size += start - at
        stretches.append((size, size + len(new), start, end))
        size += len(new)
        at = end
    out.append(plain[at:])
    return "".join(out), stretches, places


def hidden_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in the source of identifiers that only the rewritten text shows."""
    clear, stretches, places = rewritten(text)
    if not stretches and not places:
        return []
    starts = [s[0] for s in stretches]
    ordered = sorted(places)

    def source(at: int, last: bool) -> int:
        """Source place of the character at ``at``; of a replaced stretch its start or its end."""
        i = bisect.bisect_right(starts, at) - 1
        if i < 0:
            return at + last
        new_start, new_end, old_start, old_end = stretches[i]
        if new_start <= at < new_end:
            return old_end if last else old_start
        return old_end + at - new_end + last

    out = []
    for start, kind, end in plain_spans(clear):
        a, b = source(start, False), source(end - 1, True)
        i = bisect.bisect_left(ordered, a)
        touched = i < len(ordered) and ordered[i] < b
        touched |= any(s[2] < b and s[3] > a for s in stretches[max(0, bisect.bisect_left(starts, start) - 1) :][: end - start + 2])
        if not touched:
            continue
        if kind == 0 and not re.search(r"\.[A-Za-z]{2,}$", clear[start:end]):
            continue
        out.append((a, kind, b))
    return out


def find(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Plain spans, and all spans; a hidden span inside a plain one of its kind is dropped."""
    text = text or ""
    base = plain_spans(text)
    more = []
    for a, kind, b in hidden_spans(text):
        if not any(k == kind and s <= a and b <= e for s, k, e in base):
            more.append((a, kind, b))
    return base, sorted({*base, *more})


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_personal(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, counts of plain spans by kind, hash and list of spans.

    Spans count code points, end exclusive. A null text is taken as empty and has no spans; null
    and repeated ids stay as they are; other columns are not looked at.
    """
    source = docs.select(docs[id_column].alias("doc_id"), docs[text_column].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)]
            hashes = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(hashes, pa.string()), pa.array([written(x) for _, x in found], pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return source.mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string")
