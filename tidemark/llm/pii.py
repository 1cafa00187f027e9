"""Personal data: plain identifiers by fixed patterns, and disguised ones by offset-preserving deobfuscation.

Base spans follow the contract's patterns, leftmost and non-overlapping per kind; the scanners here give what a backtracking engine gives, in linear time.
For disguises, transducers rewrite the text and keep for every character where it came from: look-alike letters and foreign digits become ASCII and
invisible characters go; "at" and "dot" in words or brackets become signs where they join the parts of an address; spelled digits, and O or l among
digits, become digits; disguised dots between four short numbers, however written, become dots. The same scanners then run over the rewritten text, and spans that hold a rewritten character and touch no base span are mapped
back to the source and added.

What counts as a disguise is kept narrow, so that prose stays clean: the bare word "at" needs before it a name with a digit or sign, or
after it a bracketed dot, or the bare word "dot" and a common ending; a run of digit words needs seven digits; four numbers with dots need two digits that
are no letters, or a disguised dot and one; the result must pass the kind's own test.

Defined cases: a null or empty text has no spans; repeated rows are scanned each on their own; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import arrow_map, table

KINDS = ("email", "ip", "card", "phone")

Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> list[Span]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            out.append((start, last))
        else:
            last = at + 1
        at = text.find("@", last)
    return out


def ips(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]


_SCANNERS: tuple[Callable[[str], list[Span]], ...] = (emails, ips, cards, phones)


def base_spans(text: str) -> list[list[Span]]:
    return [f(text) for f in _SCANNERS]


# Letters that look like an ASCII letter.
_ALIKE = {
    "а": "a", "в": "B", "е": "e", "к": "k", "м": "M", "н": "H", "о": "o", "р": "p", "с": "c", "т": "T", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "ս": "u", "օ": "o", "․": ".", "。": ".", "·": ".", "‐": "-", "‑": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
# Characters that don't show.
_HIDDEN = "­​‌‍⁠﻿"


def _glyphs() -> dict[str, str]:
    """The look-alikes above, and by rule every compatibility form of a printable ASCII character and every decimal digit."""
    out = dict.fromkeys(_HIDDEN, "") | _ALIKE
    for block in ((0x2460, 0x24FF), (0x1D400, 0x1D7FF), (0xFE50, 0xFE6F), (0xFF01, 0xFF5E), (0x2070, 0x209F)):
        for k in range(block[0], block[1] + 1):
            flat = unicodedata.normalize("NFKC", chr(k))
            if len(flat) == 1 and "!" <= flat <= "~":
                out[chr(k)] = flat
    for start in (0x660, 0x6F0, 0x966, 0x9E6, 0xE50):
        out |= {chr(start + d): str(d) for d in range(10)}
    return out


_GLYPHS = _glyphs()
_GLYPH = re.compile("[" + "".join(map(re.escape, _GLYPHS)) + "]")
_GLYPH_SET = frozenset(_GLYPHS)

# The digits' names in the corpus languages, from 0 on.
_NAMES = (
    "zero one two three four five six seven eight nine".split(),
    "zéro un deux trois quatre cinq six sept huit neuf".split(),
    "null eins zwei drei vier fünf sechs sieben acht neun".split(),
    "cero uno dos tres cuatro cinco seis siete ocho nueve".split(),
    ["oh"],
)
_VALUE = {w: str(d) for names in _NAMES for d, w in enumerate(names)}
_WORD = "(?:" + "|".join(sorted(_VALUE, key=len, reverse=True)) + ")"
_POINT = r"(?: ?[\[({] ?(?:dot|punkt|point|punto|\.) ?[\])}] ?| (?:dot|punkt|point|punto) )"
_SPELLED = re.compile(rf"(?:\bplus[ -]+|\+ ?)?(?<!\w)(?:{_WORD}|[0-9]+)(?:(?:[ ,-]{{1,3}}|{_POINT}|\.)(?:{_WORD}|[0-9]+)(?!\w)){{3,}}", re.I)
_SPELLED_PART = re.compile(rf"(?P<p>{_POINT}|\.)|(?P<w>{_WORD})|(?P<d>[0-9])|(?P<plus>plus|\+)|(?P<s>[ ,-])", re.I)
_WORDS = re.compile(r"\w+")
_POINT_WORDS = frozenset("dot punkt point punto".split())
_LETTERED = re.compile(r"(?<![0-9A-Za-z])\+?[0-9OolI](?:[ .-]?[0-9OolI]){7,}(?![0-9A-Za-z])")
_LETTER_DIGITS = str.maketrans("OolI", "0011")
_QUAD_WORDS = "(?i:dot|punkt|point|punto)"
_QUAD_BRACKETED = rf"[\[({{<]\s?(?:{_QUAD_WORDS}|\.)\s?[\])}}>]"
_QUAD_DOT = rf"(?:\s?{_QUAD_BRACKETED}\s?|\s{_QUAD_WORDS}\s|\.)"
_QUAD_NUMBER = rf"(?:[0-9OolI]{{1,3}}|(?i:{_WORD}(?:[ ,-]{{1,3}}{_WORD}){{0,2}}))"
_QUAD = re.compile(rf"(?<![0-9A-Za-z]){_QUAD_NUMBER}(?:{_QUAD_DOT}{_QUAD_NUMBER}){{3}}(?!\w)")
_QUAD_PART = re.compile(rf"(?P<dot>{_QUAD_DOT})|(?P<w>(?i:{_WORD}))|(?P<d>[0-9OolI])|(?P<s>[ ,-])")
_QUAD_SOON = re.compile(rf"{_QUAD_BRACKETED}|\s{_QUAD_WORDS}\s{_QUAD_NUMBER}(?!\w)|\.{_QUAD_NUMBER}\.[0-9OolIa-zA-Z]")

_AT = r"(?:\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|\sat\s|@)"
_DOT = r"(?:\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s|\.)"
_ADDRESS = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]+(?:{_DOT}[A-Za-z0-9_%+-]+)*(?P<at>{_AT})[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}(?![A-Za-z0-9])", re.I)
_ADDRESS_SOON = re.compile(r"\s[aA][tT]\s[A-Za-z0-9-]+(?:\s?[\[({<]|\s[dD][oO][tT]\s|\.[A-Za-z0-9])|[\[({<]\s?(?:[aA][tT]|@)\s?[\])}>]|@[^\s@]*(?:\s?[\[({<]\s?(?:[dD][oO][tT]|\.)\s?[\])}>]|\s[dD][oO][tT]\s)")
_SOME_DIGITS = re.compile(r"[0-9][OolI .-]{0,6}[0-9]")
# Endings that make bare "at" and "dot" an address.
_ENDINGS = frozenset("com org net edu gov mil int info biz name io co ai app dev me tv uk de fr es it nl be at ch eu us ca au nz jp cn in br mx se no dk fi pl pt ru ie".split())
_ADDRESS_PART = re.compile(rf"(?P<a>{_AT})|(?P<d>{_DOT})", re.I)


class Mapped:
    """A rewritten text; for each character its first and last source position, and whether it was rewritten."""

    def __init__(self, text: str):
        self.text, self.first, self.last = text, list(range(len(text))), list(range(len(text)))
        self.new = bytearray(len(text))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces stretches of the text as it is now, in rising order. What a stretch becomes is one character or more, each from the whole stretch, or nothing."""
        text, first, last, new, at = [], [], [], bytearray(), 0
        for start, end, to in edits:
            text += [self.text[at:start], to]
            first += self.first[at:start] + [self.first[start]] * len(to)
            last += self.last[at:start] + [self.last[end - 1]] * len(to)
            new += self.new[at:start] + b"\1" * len(to)
            at = end
        self.text = "".join([*text, self.text[at:]])
        self.first, self.last, self.new = first + self.first[at:], last + self.last[at:], new + self.new[at:]


def _spelled(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for run in _SPELLED.finditer(text):
        parts = list(_SPELLED_PART.finditer(text, run.start(), run.end()))
        digits, named = sum(m.lastgroup in "wd" for m in parts), sum(m.lastgroup == "w" for m in parts)
        if named < 3 or digits < 7 and sum(m.lastgroup == "p" for m in parts) != 3:
            continue
        for m in parts:
            to = {"p": ".", "w": _VALUE.get(m[0].lower(), ""), "d": m[0], "plus": "+", "s": ""}[m.lastgroup]
            if to != m[0]:
                edits.append((*m.span(), to))
    return edits


def _lettered(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _LETTERED.finditer(text):
        wrong = [i for i in range(m.start(), m.end()) if text[i] in "OolI"]
        if wrong and 2 * len(wrong) <= sum(c.isdigit() for c in m[0]):
            edits += [(i, i + 1, text[i].translate(_LETTER_DIGITS)) for i in wrong]
    return edits


def _quads(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for run in _QUAD.finditer(text):
        parts = list(_QUAD_PART.finditer(text, *run.span()))
        found = [(m.span(), m[0], {"dot": ".", "w": _VALUE.get(m[0].lower(), ""), "d": m[0].translate(_LETTER_DIGITS), "s": ""}[m.lastgroup]) for m in parts]
        sure = sum(m.lastgroup == "w" or m[0].isdigit() for m in parts)
        hidden = any(m.lastgroup == "dot" and m[0] != "." for m in parts)
        if sure >= (1 if hidden else 2) and all(int(p or 256) <= 255 for p in "".join(to for _, _, to in found).split(".")):
            edits += [(*at, to) for at, was, to in found if to != was]
    return edits


def _addresses(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _ADDRESS.finditer(text):
        at, parts = m["at"], [x for x in _ADDRESS_PART.finditer(text, *m.span()) if x[0] not in ("@", ".")]
        dots = [x[0].strip().lower() for x in parts if x["d"] and x.start() > m.start("at")]
        if at.strip().lower() == "at" and not re.search(r"[0-9._%+-]", text[m.start() : m.start("at")]):
            if not dots or set(dots) == {"dot"} and re.split(r"[\s.\])}>]", m[0])[-1].lower() not in _ENDINGS:
                continue
        for x in parts:
            if x["d"] or x.start() == m.start("at"):
                edits.append((*x.span(), "." if x["d"] else "@"))
    return edits


def _touches(span: Span, found: list[Span]) -> bool:
    return any(a < span[1] and span[0] < b for a, b in found)


def _spelled_soon(text: str) -> bool:
    """Whether a digit's name stands before another, a number, or a point; a run of names has such a place."""
    words = _WORDS.findall(text.lower().replace("ſ", "s").replace("ı", "i"))
    if _VALUE.keys().isdisjoint(words):
        return False
    named = False
    for w in words:
        if named and (w in _VALUE or w[0] in "0123456789" or w in _POINT_WORDS):
            return True
        named = w in _VALUE
    return False


def disguised_spans(text: str, base: list[list[Span]]) -> list[list[Span]]:
    """The spans that only deobfuscation shows, by kind."""
    m = None
    if not text.isascii() and not _GLYPH_SET.isdisjoint(text):
        m = Mapped(text)
        m.rewrite([(*g.span(), _GLYPHS[g[0]]) for g in _GLYPH.finditer(text)])
    for soon, find_edits in ((_ADDRESS_SOON.search, _addresses), (_spelled_soon, _spelled), (_SOME_DIGITS.search, _lettered), (_QUAD_SOON.search, _quads)):
        now = m.text if m else text
        if soon(now) and (edits := find_edits(now)):
            m = m or Mapped(text)
            m.rewrite(edits)
    if m is None:
        return [[], [], [], []]
    taken = [s for spans in base for s in spans]
    out = []
    for scan in _SCANNERS:
        new = []
        for a, b in scan(m.text):
            span = (m.first[a], m.last[b - 1] + 1)
            if (any(m.new[a:b]) or span[1] - span[0] != b - a) and not _touches(span, taken):
                new.append(span)
        taken += new
        out.append(new)
    return out


def written_spans(spans: list[list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, found in zip(KINDS, spans, strict=True) for a, b in found)


def find(text: str | None) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans, and all spans, by kind, each in rising order."""
    if not text:
        return [[], [], [], []], [[], [], [], []]
    base = base_spans(text)
    return base, [sorted(a + b) for a, b in zip(base, disguised_spans(text, base), strict=True)]


def spans(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the count of each kind, the digest of the base spans, all spans and their count."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_all long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(1):
                base, every = find(x.as_py())
                rows.append((*map(len, every), hashlib.sha256(written_spans(base).encode()).hexdigest(), written_spans(every), sum(map(len, every))))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()], strict=True))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_all"])

    return arrow_map(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents"))
