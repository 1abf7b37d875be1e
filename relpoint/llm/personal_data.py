"""Personal data: detectors on the text and on a deobfuscated text whose characters know where they come from."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relpoint.llm.common import arrow_map, fresh, read, small_batches, texts

KINDS = ("email", "ip", "card", "phone")

# Letters of other scripts that look like Latin ones, and signs that look like ASCII ones.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I",
    # Greek
    "ο": "o", "α": "a", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "υ": "u",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X",
    # Signs
    "․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ",
    " ": " ", " ": " ", "　": " ",
}

#: Blocks whose characters count as the ASCII character that they are compatible with.
COMPATIBLE = ((0xFF01, 0xFF5E), (0xFE50, 0xFE6B), (0x1D400, 0x1D7FF), (0x2460, 0x24FF))

# Digits as words.
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8",
    "nine": "9", "oh": "0",
}

INVISIBLE = re.compile("[­​-‍⁠﻿]+")
_DIGIT = f"(?:{'|'.join(SPELLED)})"
_OPEN, _CLOSE = r"[ \t]*[\[({<][ \t]*", r"[ \t]*[\])}>][ \t]*"
_DOT = rf"(?:{_OPEN}(?:dot|\.){_CLOSE}|[ \t]+dot[ \t]+)"


class Span(NamedTuple):
    """Characters [start, end) of a text."""

    kind: str
    start: int
    end: int


# -- detectors; each is linear in the text, whatever it holds --

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ANY_DIGIT = re.compile("[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every match of the address pattern has one @, so it is found from there to both sides."""
    low = at = 0
    while (at := text.find("@", at)) >= 0:
        start, domain = at, _DOMAIN.match(text, at + 1)
        at += 1
        if domain:
            while start > low and text[start - 1] in _LOCAL:
                start -= 1
            if text[start] != "@":
                yield start, domain.end()
                low = at = domain.end()


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text) if _ANY_DIGIT.search(text) else ():
        if all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in m.group().split(".")):
            yield m.span()


def checks(digits: str) -> bool:
    """Luhn's sum."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text) if _ANY_DIGIT.search(text) else ():
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and checks(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


DETECTORS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = dict(
    zip(KINDS, (emails, addresses, cards, phones))
)


def detect(text: str) -> list[Span]:
    """Spans by kind, then place."""
    return [Span(kind, a, b) for kind, find in DETECTORS.items() for a, b in find(text)]


# -- transducers: a text, and where its characters come from --


class Mapped(NamedTuple):
    """Output of a transducer: the places that differ from the source are listed as edits.

    ``at``: start of each edit in the output; ``edits``: (output end, source start, source end).
    """

    text: str
    at: list[int]
    edits: list[tuple[int, int, int]]

    def source(self, start: int, end: int) -> tuple[int, int]:
        """Source characters of the output characters [start, end)."""
        return self._place(start)[0], self._place(end - 1)[1]

    def _place(self, i: int) -> tuple[int, int]:
        k = bisect_right(self.at, i) - 1
        # Edits without output lie before the character that follows them.
        if k < 0:
            return i, i + 1
        stop, first, last = self.edits[k]
        return (first, last) if i < stop else (last + i - stop, last + i - stop + 1)


def rewrite(text: str, rule: re.Pattern, output: Callable[[re.Match], str]) -> Mapped:
    pieces, at, edits, done, size = [], [], [], 0, 0
    for m in rule.finditer(text):
        new = output(m)
        if new == m.group():
            continue
        size += m.start() - done
        pieces += [text[done : m.start()], new]
        at.append(size)
        size += len(new)
        edits.append((size, m.start(), m.end()))
        done = m.end()
    return Mapped("".join([*pieces, text[done:]]), at, edits)


@cache
def folds() -> tuple[frozenset[str], dict[int, str]]:
    """Characters that stand for an ASCII one, and that one for each."""
    table = {ord(a): b for a, b in LOOKALIKES.items()}
    for first, last in COMPATIBLE:
        for code in range(first, last + 1):
            plain = unicodedata.normalize("NFKC", chr(code))
            if len(plain) == 1 and plain.isascii():
                table[code] = plain
    # Decimal digits of all scripts.
    table |= {code: str(unicodedata.decimal(chr(code))) for code in range(0x660, 0x1FC00) if chr(code).isdecimal()}
    return frozenset(map(chr, table)), table


DISGUISES = re.compile(
    rf"(?P<at>{_OPEN}(?:at|@){_CLOSE}|(?<=[a-z0-9])[ \t]+at[ \t]+(?=[a-z0-9-]+{_DOT}[a-z0-9]))"
    rf"|(?P<dot>(?<=[a-z0-9]){_DOT}(?=[a-z0-9]))"
    rf"|(?P<plus>\bplus[ -]+(?=[0-9]|{_DIGIT}\b))"
    rf"|(?P<digits>\b{_DIGIT}(?:[ -]{_DIGIT})+\b|(?<=[0-9][ -]){_DIGIT}\b|(?<=dot ){_DIGIT}\b|\b{_DIGIT}(?=[ \t]+dot\b))",
    re.I | re.A,
)
_SPELLED = re.compile(_DIGIT, re.I)
# What a text has to hold, in lower case, before it is worth the larger pattern.
_BRACKETED = re.compile(r"[\[({<][ \t]*(?:at|@|dot|\.)")
_RUN = re.compile(f"{_DIGIT}[ -]{_DIGIT}|[0-9][ -]{_DIGIT}")


def _plain_form(m: re.Match) -> str:
    kind = m.lastgroup
    if kind == "digits":
        return "".join(SPELLED[w.lower()] for w in _SPELLED.findall(m.group()))
    return {"at": "@", "dot": ".", "plus": "+"}[kind]


def deobfuscated(text: str) -> tuple[str, list[Mapped]]:
    """The plain form of a text, and the transducers' outputs that lead back to it (last one first).

    Invisible characters go, look-alikes and digits of other scripts become ASCII (one for one), then spelled
    digits, ``[at]``, ``(dot)``, `` dot ``, `` at `` before a dotted name, and ``plus`` before a digit get
    their signs.
    """
    steps = []
    if not text.isascii():
        if INVISIBLE.search(text):
            steps.append(rewrite(text, INVISIBLE, lambda m: ""))
            text = steps[-1].text
        known, table = folds()
        if not known.isdisjoint(set(text)):
            text = text.translate(table)
    lower = text.lower()
    if "dot" in lower or "plus" in lower or _BRACKETED.search(lower) or _RUN.search(lower):
        step = rewrite(text, DISGUISES, _plain_form)
        if step.edits:
            steps.append(step)
            text = step.text
    return text, steps[::-1]


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """(spans of the text as it stands, further spans found in its plain form)."""
    base = detect(text)
    plain, steps = deobfuscated(text)
    if plain == text:
        return base, []
    known = {kind: [s for s in base if s.kind == kind] for kind in KINDS}
    added = []
    for span in detect(plain):
        start, end = span.start, span.end
        for step in steps:
            start, end = step.source(start, end)
        # Known spans don't overlap, so the last that starts no later decides.
        k = bisect_right(known[span.kind], start, key=lambda s: s.start) - 1
        if k < 0 or known[span.kind][k].end < end:
            added.append(Span(span.kind, start, end))
    return base, added


SPANS = "array<struct<kind:string,start:long,end:long>>"


def with_personal_data(docs: DataFrame, base: str = "base", added: str = "added", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of each whole text as it stands, and those only its plain form shows.

    Places count code points, the end is exclusive; spans are ordered by kind (email, ip, card, phone) and
    place. Spans of one kind within ``base`` don't overlap; an added one is never inside a base one of its kind.
    A null, empty or blank text has none. Rows are scanned one by one, so repeated rows and ties don't matter, and
    texts of any length are read whole in linear time. An empty table gives no rows. ``base`` and ``added`` must
    be names that ``docs`` lacks (``fresh`` finds some).
    """
    small_batches(docs.sparkSession)
    place = docs.columns.index(text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def each(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [scan(text.decode("utf-8", "replace")) for text in texts(batch.column(place))]
        return [pa.array([[s._asdict() for s in x[k]] for x in found], kind) for k in (0, 1)]

    return arrow_map(docs, each, f"`{base}` {SPANS}, `{added}` {SPANS}", docs.columns)


def without_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; overlapping ones by that of the first.

    Null texts stay null and texts without spans stay as they are, as do all other columns.
    """
    names = fresh(docs, "base", "added", "masked")
    found = with_personal_data(docs, names[0], names[1], text_col)
    at = {c: i for i, c in enumerate(found.columns)}

    def each(batch: pa.RecordBatch) -> list[pa.Array]:
        column, masked = batch.column(at[text_col]), []
        spans = zip(*(batch.column(at[n]).to_pylist() for n in names[:2]))
        for text, (base, added) in zip(column.to_pylist(), spans):
            pieces, done = [], 0
            for s in sorted(base + added, key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= done:
                    pieces += [text[done : s["start"]], f"<{s['kind']}>"]
                done = max(done, s["end"])
            masked.append(text if text is None else "".join([*pieces, text[done:]]))
        return [pa.array(masked, pa.string())]

    done = arrow_map(found, each, f"`{names[2]}` string", docs.columns)
    return done.select(*[F.col(f"`{names[2]}`").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, by kind as listed and place, joined by commas."""
    order = F.array(*map(F.lit, KINDS))
    keyed = F.transform(
        spans, lambda s: F.struct(F.array_position(order, s["kind"]).alias("k"), s["start"].alias("a"), s["end"].alias("b"))
    )
    return F.array_join(
        F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", F.get(order, (s["k"] - 1).cast("int")), s["a"], s["b"])), ","
    )


def _equals(kind: str) -> Callable[[Column], Column]:
    return lambda x: x == kind


def op13_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = with_personal_data(read(spark, folder, "documents").select("doc_id", "text"))
    counts = (F.size(F.filter(F.col("base.kind"), _equals(k))).cast("long").alias(f"n_{k}") for k in KINDS)
    return found.select(
        "doc_id",
        *counts,
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


QUERIES = {"op13_personal_data": op13_personal_data}
#: Leftmost matches with checks, and transducers, aren't in SQL.
SQL: dict[str, str] = {}
