"""Personal data in texts, plain and disguised, with spans of the source text.

Plain identifiers are found in the text as it is. Then three transducers rewrite a copy: homoglyphs (characters that
look like ASCII, invisible ones), spelled digits in runs, and at/dot disguises. Each keeps, for every character
it gives out, the source characters that it stands for, so that an identifier found in the rewritten copy maps back to a
span of the source. Such a span is added if the rewriting changed something inside and no plain span of
its kind overlaps it.

Plain kinds, leftmost without overlap, and dropped without another try if their check fails: email; ip (four parts up to
255); card (13 to 19 digits passing Luhn); phone (a plus sign and 9 to 15 digits).

Defined results: null and empty texts have no spans; a text of any length is read whole, in time that grows with its
length; repeated rows are read each; an empty table gives an empty table. Columns other than doc_id and text are
never read.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import map_batches

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a digit cannot start a match that the digit before it did not start, so runs are tried once
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of local@domain: the run of local characters before an @ starts at its first one or where the last match ended."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        match = _DOMAIN.match(text, at)
        if match:
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, match.end()))
                last = match.end()
        at = text.find("@", max(at + 1, last))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def plain_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of every kind in a text as it stands."""
    out = {"email": _emails(text) if "@" in text else [], "ip": [], "card": [], "phone": []}
    if _DIGIT.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for match in _CARD.finditer(text):
            if 13 <= match.end() - match.start() <= 37:
                digits = match[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(match.span())
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# Letters of other scripts that look like ASCII letters.
_LOOKALIKES = str.maketrans(
    "аеорсухіѕјԁһԛԝԍӏАВЕКМНОРСТХІЅЈοανρικτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeopcyxisjdhqwglABEKMHOPCTXISJoavpiktuABEZHIKMNOPTYX",
)
_INVISIBLE = "​‌‍⁠﻿­"
_DASHES = "‐‑‒–—−"
_DOTS = "。｡․"


def _homoglyphs() -> dict[str, str]:
    """Non-ASCII characters and the ASCII character that each stands for ('' for invisible ones)."""
    out = {chr(k): chr(v) for k, v in _LOOKALIKES.items()}
    for k in range(0x80, 0x1FBFA):
        c = chr(k)
        digit = unicodedata.digit(c, None)
        plain = str(digit) if digit is not None else unicodedata.normalize("NFKC", c)
        if len(plain) == 1 and (plain.isascii() and plain.isalnum() or plain in "@.+-_ ()[]{}") and c not in out:
            out[c] = plain
    return out | dict.fromkeys(_INVISIBLE, "") | dict.fromkeys(_DASHES, "-") | dict.fromkeys(_DOTS, ".")


_GLYPHS: dict[str, str] = {}
_GLYPH = re.compile("(?!)")


def _glyph_pattern() -> re.Pattern:
    """Built once per worker."""
    global _GLYPH
    if not _GLYPHS:
        _GLYPHS.update(_homoglyphs())
        codes, parts = sorted(map(ord, _GLYPHS)), []
        for c in codes:
            if parts and parts[-1][1] == c - 1:
                parts[-1][1] = c
            else:
                parts.append([c, c])
        _GLYPH = re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in parts) + "]")
    return _GLYPH


class Rewritten:
    """A text whose characters know the source characters that they stand for."""

    def __init__(self, text: str):
        self.text = text
        self.starts = list(range(len(text)))
        self.ends = list(range(1, len(text) + 1))

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Put new text for [start, end), in order and without overlap; each new character stands for all of the old ones."""
        parts, starts, ends, last = [], [], [], 0
        for a, b, new in edits:
            parts += [self.text[last:a], new]
            starts += self.starts[last:a] + [self.starts[a]] * len(new)
            ends += self.ends[last:a] + [self.ends[b - 1]] * len(new)
            last = b
        self.text = "".join(parts) + self.text[last:]
        self.starts = starts + self.starts[last:]
        self.ends = ends + self.ends[last:]


# The ten digits in four languages.
_SPELLED = {
    word: str(n)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for n, word in enumerate(words.split())
}
_WORD = "(?:" + "|".join(sorted(_SPELLED, key=len, reverse=True)) + ")"
_STEP = rf"(?:[ ,_-]+(?:(?:dot|point|punto|punkt)[ _-]+)?|\.)(?:\b{_WORD}\b|[0-9]+)"
_RUN = re.compile(rf"(?:(?:\bplus[ _-]+|\+ ?))?\b(?:{_WORD}\b|[0-9]+){_STEP}(?:{_STEP})+", re.IGNORECASE)
_UNIT = re.compile(rf"\bplus[ _-]+|[ ,_-]+(?:dot|point|punto|punkt)[ _-]+|\b{_WORD}\b|[ ,_-]+", re.IGNORECASE)
_HAS_WORD = re.compile(rf"\b{_WORD}\b", re.IGNORECASE)
_JOINERS = {"dot", "point", "punto", "punkt"}

_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
# starts with one of few characters, so that the search skips all others; blanks around are added to a match
_AT = re.compile(rf"{_OPEN}\s*(?:[aA][tT]|@)\s*{_CLOSE}|[ _][aA][tT](?=[ _])|@")
_BLANK = " \t\n\x0b\x0c\r"
_DOT = rf"(?:\s*{_OPEN}\s*(?:dot|punto|point|punkt|\.)\s*{_CLOSE}\s*|[ _]+(?:dot|punto|point|punkt)[ _]+|\.)"
_HOST = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.IGNORECASE)
_DOT_UNIT = re.compile(_DOT, re.IGNORECASE)
# disguised dots, each tried from the first of its blanks only
_NAME_DOT = re.compile(rf"(?<!\s)\s*{_OPEN}\s*(?:dot|punto|point|punkt|\.)\s*{_CLOSE}\s*|(?<![ _])[ _]+(?:dot|punto|point|punkt)[ _]+", re.IGNORECASE)
_LABEL = re.compile(r"(?:[A-Za-z]{2,6})$")


def _glyph_edits(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), _GLYPHS[m[0]]) for m in _glyph_pattern().finditer(text)]


def _digit_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for run in _RUN.finditer(text):
        if _HAS_WORD.search(run[0]):
            for m in _UNIT.finditer(text, run.start(), run.end()):
                unit = m[0].lower()
                new = _SPELLED.get(unit) or ("+" if unit.startswith("plus") else "." if unit.strip(" ,_-") else "")
                edits.append((m.start(), m.end(), new))
    return edits


def _name_start(text: str, first: int, end: int, dots: dict[int, int]) -> int:
    """Start of the name that ends at `end`: runs of local characters joined by disguised dots (end -> start), none before `first`."""
    name = start = at = end
    while True:
        while at > first and text[at - 1] in _LOCAL:
            at -= 1
        if at == start:  # nothing before the last dot
            return name
        name = start = at
        if dots.get(at, -1) < first:
            return name
        start = at = dots[at]


def _at_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits of disguised addresses: name, at, host. A bare word "at" needs a disguised dot or a name with a digit, dot or underscore."""
    edits, last, all_dots = [], 0, None
    for at in _AT.finditer(text):
        start, end = at.span()
        bare = at[0][-1] in "tT"
        blanks = _BLANK + "_" if bare else _BLANK
        while start > last and text[start - 1] in blanks:
            start -= 1
        while end < len(text) and text[end] in blanks:
            end += 1
        if start < last or at[0] == "@" and end - start == 1:
            continue
        host = _HOST.match(text, end)
        if not host or start == last or text[start - 1] not in _LOCAL or not _LABEL.search(re.split("[^A-Za-z0-9]+", host[0])[-1]):
            continue
        if all_dots is None:
            all_dots = {m.end(): m.start() for m in _NAME_DOT.finditer(text)}
        name = _name_start(text, last, start, all_dots)
        dots = [m for m in _DOT_UNIT.finditer(host[0]) if m[0] != "."]
        joins = [m for m in _DOT_UNIT.finditer(text, name, start) if m[0] != "."]
        # a name of several words only if the host is disguised in the same way
        first = name if dots else max([name, *(m.end() for m in joins)])
        if bare and not dots and not re.search("[0-9._]", text[first:start]):
            continue
        edits += [(m.start(), m.end(), ".") for m in joins if m.start() >= first]
        edits.append((start, end, "@"))
        edits += [(host.start() + m.start(), host.start() + m.end(), ".") for m in dots]
        last = host.end()
    return edits


def _spelled_near(text: str) -> bool:
    """Whether a spelled digit stands beside another, a figure or a spelled dot."""
    words = text.lower().replace(",", " ").replace(".", " ").replace("-", " ").replace("_", " ").split()
    for i, word in enumerate(words):
        if word in _SPELLED:
            for other in words[max(i - 1, 0) : i] + words[i + 1 : i + 2]:
                if other in _SPELLED or other in _JOINERS or other[0].isdigit():
                    return True
    return False


def find_spans(text: str | None) -> list[tuple[str, int, int, str, bool]]:
    """(kind, start, end, identifier, added) of a text, by kind and start; end is exclusive, in code points."""
    if not text:
        return []
    plain = plain_spans(text)
    out = {kind: [(kind, a, b, text[a:b], False) for a, b in plain[kind]] for kind in KINDS}
    copy = None
    for edits_of, wanted in ((_glyph_edits, not text.isascii()), (_digit_edits, True), (_at_edits, True)):
        current = copy.text if copy else text
        edits = edits_of(current) if wanted and (edits_of is not _digit_edits or _spelled_near(current)) else []
        if edits:
            copy = copy or Rewritten(text)
            copy.replace(edits)
    if copy:
        for kind, found in plain_spans(copy.text).items():
            for a, b in found:
                start, end = copy.starts[a], copy.ends[b - 1]
                if text[start:end] != copy.text[a:b] and not any(x < end and start < y for x, y in plain[kind]):
                    out[kind].append((kind, start, end, copy.text[a:b], True))
    return [s for kind in KINDS for s in sorted(out[kind], key=lambda s: s[1:3])]


def personal_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row; spans: kind, start, end (code points, end exclusive), identifier, added."""
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("identifier", pa.string()), ("added", pa.bool_())])

    def build():
        names = [f.name for f in kind]

        def work(batch):
            spans = [[dict(zip(names, s, strict=True)) for s in find_spans(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(kind))], names=["doc_id", "spans"])

        return work

    schema = "doc_id long, spans array<struct<kind: string, start: long, end: long, identifier: string, added: boolean>>"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), build, schema)
