"""Personal data with offset-preserving deobfuscation.

Base identifiers are found in the text as it stands. Then transducers rewrite
disguised stretches and remember which source characters every piece of output
came from:

- homoglyphs: fullwidth forms, look-alike Cyrillic and Greek letters and other
  decimal digits become ASCII; invisible characters become nothing;
- "(at)", "[dot]" and the like become "@" and "."; so do bare "dot" in the domain
  behind an at-sign of any form, bare "at" before a domain with a disguised dot,
  or before a plain domain where the local part holds a digit or an inner "." or
  "_", and bare "dot" between numbers; the forms may be mixed;
- runs of spelled digits (at least three) become digits, "plus" before them "+".
  Every run is looked at by itself, whatever else the text holds.

The detectors run again on what the transducers wrote; a match that holds a
rewritten piece is mapped back to source characters, whole pieces at a time,
and added unless a base span of its kind contains it. A run of 10 to 15 spelled
digits, four different ones at least, counts as a phone number without a "+"
as well; a word said over and over does not.

Offsets are code points, ends exclusive. Null texts count as empty and have no
spans. Null ids, repeated rows and texts of any length are handled like any
other row; other columns are not looked at. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import quoted

# The kinds in their order and the patterns of base identifiers.
KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A run of digits is tried once, from its start: a match from inside it would need the same dot behind it.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Look-alike letters; fullwidth forms and decimal digits follow from their code points.
LOOKALIKES = dict(
    zip(
        "аеорсухіјѕһԁԛԝАВЕКМНОРСТХІЈЅοαερνικτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧɑɡ∙․。＠﹫",
        "aeopcyxijshdqwABEKMHOPCTXIJSoaepviktuABEZHIKMNOPTYXag...@@",
        strict=True,
    )
)
INVISIBLE = "­​‌‍⁠﻿"
SPELLED = {
    word: str(digit)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for digit, word in enumerate(words.split())
} | {"oh": "0"}
_WORD = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
AT_WORD, DOT_WORD = "(?:at|arroba|arobase)", "(?:dot|punkt|punto|point)"
OPEN, CLOSE = r"[\[({<][ \t]*", r"[ \t]*[\])}>]"
BRACKETED = re.compile(rf"{OPEN}(?:(?P<at>@|{AT_WORD})|(?P<dot>\.|{DOT_WORD})){CLOSE}[ \t]*", re.I | re.A)
IN_BRACKETS = rf"[ \t]*{OPEN}(?:\.|{DOT_WORD}){CLOSE}[ \t]*"
# A dot in any form between two labels or numbers.
ANY_DOT = rf"(?:[.∙․。．]|{IN_BRACKETS}|[ \t]+{DOT_WORD}[ \t]+)"
AT_SIGN = re.compile("[@＠﹫]")
BARE_AT = re.compile(rf"(?<=[ \t]){AT_WORD}(?=[ \t])", re.A)
BARE_DOT = re.compile(rf"[ \t]+{DOT_WORD}[ \t]+(?=[A-Za-z0-9-])", re.I | re.A)
CHAIN = re.compile(rf"[A-Za-z0-9-]+(?:{ANY_DOT}[A-Za-z0-9-]+)+", re.I | re.A)
PLAIN_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
MARKED = re.compile(r"[0-9]|[A-Za-z0-9][._]+[A-Za-z0-9]")
NUMBERS = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:{ANY_DOT}[0-9]{{1,3}}){{3}}(?![0-9])", re.I | re.A)
RUN = re.compile(
    rf"(?<!\w)(?:\+[ ]?|plus[ ]+)?(?:{_WORD}|[0-9]+)(?:(?:{IN_BRACKETS}|[\s().,-]{{1,3}}|[\s]+{DOT_WORD}[\s]+)(?:{_WORD}|[0-9]+))+(?!\w)", re.I
)
TOKEN = re.compile(rf"(?P<word>{_WORD})|(?P<dot>{IN_BRACKETS}|\s+{DOT_WORD}\s+)|(?P<plus>\+[ ]?|plus[ ]+)|(?P<digits>[0-9]+)|(?P<gap>[\s().,-]+)", re.I)
GATE_ODD = re.compile("[" + re.escape("".join(c for c in LOOKALIKES if ord(c) > 127) + INVISIBLE) + "！-～]|[^\\W\\x00-\\x7fa-zA-Z_](?<=\\d)")
#: What a chain of labels holds besides letters, digits, hyphens and plain dots where one of its dots is disguised.
ODD_DOT_CHARS = frozenset(" \t[](){}<>∙․。．")
GATE_MARKS = ("dot", "punkt", "punto", "point")
# Letters that match i and s where case is ignored.
ODD_CASE = str.maketrans("İıſ", "iis")


def digit_of(word: str) -> str:
    return SPELLED[word.translate(ODD_CASE).lower()]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: the run of local characters before an @ and a domain after it."""
    after = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            after = domain.end()
            at = text.find("@", after)
        else:
            at = text.find("@", at + 1)


def said_over_and_over(digits: str) -> bool:
    """One word repeated is no number."""
    return len({c for c in digits if c.isdigit()}) < 2


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def at_most_255(digits: str) -> bool:
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of all base identifiers, by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(at_most_255(p) for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def plain(char: str) -> str | None:
    """ASCII for a disguised character; None where it is not one."""
    if char in LOOKALIKES:
        return LOOKALIKES[char]
    if char in INVISIBLE:
        return ""
    if "！" <= char <= "～":
        return chr(ord(char) - 0xFEE0)
    digit = unicodedata.decimal(char, None)
    return None if digit is None or char.isascii() else str(digit)


def bare_dots(text: str, stretch: re.Match | None) -> list[tuple[int, int, str]]:
    """Edits of the bare dots inside a domain or an address of numbers."""
    if stretch is None:
        return []
    return [(d.start(), d.end(), ".") for d in BARE_DOT.finditer(text, stretch.start(), stretch.end())]


def marked_local(text: str, end: int) -> bool:
    """Whether the local characters before `end` hold a digit or an inner dot or underscore, unlike a word."""
    start = end
    while start and text[start - 1] in LOCAL_CHARS:
        start -= 1
    return MARKED.search(text, start, end) is not None


def edits_of(text: str, low: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Rewritten pieces (start, end, output), and runs of spelled digits (start, end, their digits)."""
    found: list[tuple[int, int, str]] = []
    runs: list[tuple[int, int, str]] = []
    if not text.isascii():
        found += [(m.start(), m.end(), plain(m.group())) for m in GATE_ODD.finditer(text) if plain(m.group()) is not None]
    for m in BRACKETED.finditer(text):
        start = m.start()
        while start and text[start - 1] in " \t":
            start -= 1
        found.append((start, m.end(), "@" if m["at"] else "."))
        if m["at"]:
            found += bare_dots(text, CHAIN.match(text, m.end()))
    if any(g in low for g in GATE_MARKS):
        for m in AT_SIGN.finditer(text):
            found += bare_dots(text, CHAIN.match(text, m.end()))
        for n in NUMBERS.finditer(text):
            found += bare_dots(text, n)
    for m in BARE_AT.finditer(low):
        start, end = m.span()
        while start and text[start - 1] in " \t":
            start -= 1
        while end < len(text) and text[end] in " \t":
            end += 1
        chain = CHAIN.match(text, end) if start and text[start - 1].isascii() and text[start - 1].isalnum() else None
        if not chain:
            continue
        if set(chain.group()) & ODD_DOT_CHARS or marked_local(text, start) and PLAIN_DOMAIN.match(text, end):
            found.append((start, end, "@"))
            found += bare_dots(text, chain)
    for run in RUN.finditer(text):
        tokens = list(TOKEN.finditer(text, run.start(), run.end()))
        if sum(t["word"] is not None for t in tokens) < 3:
            continue
        written = []
        for t in tokens:
            if t["word"]:
                written.append((t.start(), t.end(), digit_of(t.group())))
            elif t["dot"]:
                written.append((t.start(), t.end(), "."))
            elif t["plus"]:
                written.append((t.start(), t.end(), "+"))
            elif t["gap"]:
                written.append((t.start(), t.end(), ""))
        found += written
        digits = "".join(digit_of(t.group()) if t["word"] else t.group() if t["digits"] else "" for t in tokens)
        runs.append((run.start(), run.end(), digits))
    kept, end = [], 0
    for edit in sorted(found, key=lambda e: (e[0], -e[1])):
        if edit[0] >= end:
            kept.append(edit)
            end = edit[1]
    return kept, runs


def added(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that only the transducers uncover, in source characters."""
    # lower case of the same length, so that places agree
    low = text.lower()
    edits, runs = edits_of(text, low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text))
    if not edits:
        return []
    out, pieces, at, size = [], [], 0, 0  # pieces: (place in the output, place in the source, source end, rewritten)
    for start, end, new in edits:
        for a, b, s, rewritten in ((at, start, text[at:start], False), (start, end, new, True)):
            if b > a:
                pieces.append((size, a, b, rewritten))
                out.append(s)
                size += len(s)
        at = end
    pieces.append((size, at, len(text), False))
    out.append(text[at:])
    written = "".join(out)
    starts = [p[0] for p in pieces]
    rewritten_at = [p[0] for p in pieces if p[3]]
    spans = set()

    def source(place: int, is_end: bool) -> int:
        k = bisect_right(starts, place) - 1
        if is_end and place == pieces[k][0]:
            # an end lies behind the last piece that wrote something before it
            while k and pieces[k][0] == place:
                k -= 1
        elif not is_end:
            while pieces[k][3] and k + 1 < len(pieces) and pieces[k + 1][0] == pieces[k][0]:
                k += 1
        p = pieces[k]
        if p[3]:
            return p[2] if is_end else p[1]
        return p[1] + place - p[0]

    for kind, a, b in detect(written):
        k = bisect_right(rewritten_at, a - 1)
        if k < len(rewritten_at) and rewritten_at[k] < b and not (kind == 2 and said_over_and_over(written[a:b])):
            spans.add((kind, source(a, False), source(b, True)))
    for a, b, digits in runs:
        if 16 <= len(digits) <= 19 and luhn(digits) and not said_over_and_over(digits):
            spans.add((2, a, b))
        elif 10 <= len(digits) <= 15 and len(set(digits)) >= 4 and not any(k in (1, 3) and x < b and a < y for k, x, y in spans):
            spans.add((3, a, b))
    return [s for s in spans if not any(k == s[0] and a <= s[1] and s[2] <= b for k, a, b in base)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, base spans and added spans, each a list of (kind, start, end)."""
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base_rows, added_rows = [], []
            for text in batch.column(1).cast(pa.string()).to_pylist():
                base = detect(text) if text else []
                more = sorted(added(text, base)) if text else []
                for rows, spans in ((base_rows, base), (added_rows, more)):
                    rows.append([{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base_rows, spans_type), pa.array(added_rows, spans_type)], names=[id_col, "base", "added"]
            )

    source = docs.select(quoted(id_col), quoted(text_col).cast("string").alias("text_"))
    spans = "array<struct<kind: string, start: bigint, end: bigint>>"
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, base {spans}, added {spans}")


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
