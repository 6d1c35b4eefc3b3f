r"""Personal data: fixed patterns, and the same patterns behind disguises.

*Base.* Email, IP address, payment card and phone number by fixed patterns,
leftmost non-overlapping per kind; matches that fail their check are dropped.

*Offset-preserving deobfuscation.* Transducers rewrite a text and keep, for
each output character, the source span it came from:

1. homoglyphs: full-width forms, look-alike Cyrillic and Greek letters, and
   digits of other scripts become ASCII; zero-width characters vanish;
2. spelled digits: a run of three or more digit words ("four one five", also
   "double seven", German, French, Spanish) becomes digits;
3. at/dot disguises: " (at) ", "[dot]", " at ... dot com" become "@" and ".".

The detectors run on the rewritten text and their spans are mapped back to the
source. What only the rewriting reveals is added (it must differ from its
source and not overlap a base span of its kind); base spans stay. A bare
" at " / " dot " is rewritten only as part of an address with a dotted or
"dot"-spelled ending, so ordinary prose
("look at example.com") is left alone.

Defined cases: a null text counts as empty, empty texts have no spans, very
long texts are read whole (all patterns are linear), repeated rows are judged
row by row, an empty table gives an empty result, other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import doc_texts, read_table

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Possessive first run: a start inside it fails where its own start failed, so nothing is lost and long runs stay linear.
IP = re.compile(r"[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def emails(t: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@domain`` without rescanning runs that no "@" ends."""
    done, at = 0, t.find("@")
    while at >= 0:
        s = at
        while s > done and t[s - 1] in LOCAL:
            s -= 1
        if s < at and (m := DOMAIN.match(t, at + 1)):
            yield s, m.end()
            done = m.end()
            at = t.find("@", done)
        else:
            at = t.find("@", at + 1)


def detect(t: str) -> list[tuple[int, int, int]]:
    """Sorted (start, kind, end) of a text."""
    out = [(s, 0, e) for s, e in emails(t)] if "@" in t else []
    if "." in t:
        for m in IP.finditer(t):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(t):
        if m.end() - m.start() >= 12:
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in t:
        for m in PHONE.finditer(t):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# fixed values: look-alikes of ASCII letters in Cyrillic and Greek, character by character
LOOKS = dict(zip("аеорсухіјѕԁԛԝһкмтвАВЕЗКМНОРСТУХІЈЅαορνκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdqwhkmtbABE3KMHOPCTYXIJSaopvkABEZHIKMNOPTYX", strict=True))
#: Without width; they vanish.
NOTHING = "​‌‍⁠﻿­"
DIGITS = {
    w: str(n)
    for words in (
        # fixed values: digit words of the corpus languages, zero to nine
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for n, w in enumerate(words.split())
} | {"oh": "0"}
REPEATS = {"double": 2, "triple": 3}
_DIGIT = "(?:(?:double|triple)[ -])?(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")"
#: At least three digit words, or digit words among digits, in one number.
SPELLED = re.compile(rf"(?<!\w){_DIGIT}(?:[ ,.-]{{1,2}}(?:{_DIGIT}(?!\w)|[0-9]+))*(?!\w)", re.I)
#: The least that three digit words in one number hold: one, and a digit word or digits behind it.
SPELLED_HINT = re.compile(rf"(?<!\w){_DIGIT}[ ,.-]{{1,2}}(?:{_DIGIT}(?!\w)|[0-9])", re.I)
AT = r"(?:\s{0,2}[\(\[\{<]\s?(?:at|@|arroba|arobase|ät)\s?[\)\]\}>]\s{0,2}|\s(?:at|AT|arroba|arobase)\s)"
BARE_DOT = r"\s(?:dot|DOT|punkt|punto)\s"
DOT = rf"(?:\s{{0,2}}[\(\[\{{<]\s?(?:dot|punkt|point|punto|\.)\s?[\)\]\}}>]\s{{0,2}}|{BARE_DOT})"
ADDRESS = re.compile(rf"(?<![A-Za-z0-9._%+-])([A-Za-z0-9_%+-]{{1,64}}(?:(?:\.|{DOT})[A-Za-z0-9_%+-]{{1,64}}){{0,4}})({AT}|@)([A-Za-z0-9-]{{1,63}}(?:(?:\.|{DOT})[A-Za-z0-9-]{{1,63}}){{1,4}})(?![A-Za-z0-9-])", re.I)
AT_ONLY, DOT_ONLY = re.compile(AT, re.I), re.compile(DOT, re.I)
#: Defanged dots of an IP address, in brackets or as bare words.
NUMBER_DOT = re.compile(rf"(?<=[0-9])(?:\s?[\(\[\{{<]\s?(?:dot|punkt|punto|\.)\s?[\)\]\}}>]\s?|{BARE_DOT})(?=[0-9])", re.I)
#: Endings of an address whose at and dot are bare words (fixed values); any two letters are one as well.
ENDINGS = frozenset("com net org edu gov mil int io info biz name pro dev app xyz site online shop store tech cloud blog page email wiki news agency media mobi jobs aero coop museum asia example test mail".split())
COUNTRY = re.compile("[a-z]{2}")
#: What each rewriting needs to find in the lower-cased text, as plain substrings.
OPENERS = ("(", "[", "{", "<")
DOT_WORDS = ("dot", "punkt", "punto")
BARE_DOT_ONLY = re.compile(BARE_DOT, re.I)
BREAKS = str.maketrans(",.-;:!?()\n\t", " " * 11)


def may_hide(low: str) -> tuple[bool, bool]:
    """(spelled digits, address marks) may occur in a lower-cased text; never wrongly no."""
    words = not DIGITS.keys().isdisjoint(low.translate(BREAKS).split())
    marks = any(x in low for x in OPENERS) or (any(x in low for x in DOT_WORDS) and BARE_DOT_ONLY.search(low) is not None)
    return words and SPELLED_HINT.search(low) is not None, marks


class Rewritten:
    """A text with the source span of each character; rewriting composes."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text, self.starts, self.ends = text, starts, ends

    def source(self, s: int, e: int) -> tuple[int, int]:
        return (s, e) if self.starts is None else (self.starts[s], self.ends[e - 1])

    def replace(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """Disjoint (start, end, new) in order; each new character takes the whole replaced span as its source."""
        if not edits:
            return self
        starts = self.starts if self.starts is not None else list(range(len(self.text)))
        ends = self.ends if self.ends is not None else list(range(1, len(self.text) + 1))
        text, out_s, out_e, at = [], [], [], 0
        for s, e, new in edits:
            if s < at:
                continue
            text += [self.text[at:s], new]
            out_s += starts[at:s]
            out_e += ends[at:s]
            out_s += [starts[s]] * len(new)
            out_e += [ends[e - 1]] * len(new)
            at = e
        text.append(self.text[at:])
        return Rewritten("".join(text), out_s + starts[at:], out_e + ends[at:])


def _plain(c: str) -> str:
    """ASCII for a character of the homoglyph transducer, or the character."""
    if c in LOOKS:
        return LOOKS[c]
    if c in NOTHING:
        return ""
    n = ord(c)
    if 0xFF01 <= n <= 0xFF5E:
        return chr(n - 0xFEE0)
    if (d := unicodedata.digit(c, None)) is not None and unicodedata.category(c) == "Nd":
        return str(d)
    if 0x1D400 <= n <= 0x1D7FF:
        return unicodedata.normalize("NFKC", c)
    return c


#: What the homoglyph transducer can change; Latin letters with accents are not among it.
ODD = re.compile("[" + re.escape("".join(LOOKS) + NOTHING) + "٠-٩۰-۹०-९！-～\U0001d400-\U0001d7ff]")


def homoglyphs(r: Rewritten) -> Rewritten:
    return r.replace([(m.start(), m.end(), p) for m in ODD.finditer(r.text) if (p := _plain(m[0])) != m[0]])


def spelled_digits(r: Rewritten) -> Rewritten:
    edits = []
    for m in SPELLED.finditer(r.text):
        words = [w for w in re.split(r"[ ,.-]+", m[0].lower()) if w]
        if sum(w in DIGITS for w in words) < 3:
            continue
        times, digits = 1, []
        for w in words:
            if w in REPEATS:
                times = REPEATS[w]
            else:
                digits.append((DIGITS[w] if w in DIGITS else w) * times)
                times = 1
        edits.append((m.start(), m.end(), "".join(digits)))
    return r.replace(edits)


def addresses(r: Rewritten) -> Rewritten:
    edits = [(m.start(), m.end(), ".") for m in NUMBER_DOT.finditer(r.text)]
    for m in ADDRESS.finditer(r.text):
        marks = re.search(r"[\(\[\{<]", m[0]) is not None
        spelled = DOT_ONLY.search(m[0]) is not None
        ending = re.split(r"[^A-Za-z0-9-]+", m[3])[-1].lower()
        # "look at example.com" is prose: a bare at counts beside a spelled dot and a known or two-letter ending only
        if not marks and not (spelled and (ending in ENDINGS or COUNTRY.fullmatch(ending))):
            continue
        for k, pattern, new in ((1, DOT_ONLY, "."), (2, AT_ONLY, "@"), (3, DOT_ONLY, ".")):
            edits += [(m.start(k) + x.start(), m.start(k) + x.end(), new) for x in pattern.finditer(m[k]) if x[0] != new]
    return r.replace(sorted(set(edits)))


def disguised(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that only the rewritten text shows, in source offsets."""
    r = Rewritten(text) if text.isascii() else homoglyphs(Rewritten(text))
    words, marks = may_hide(r.text.lower())
    if words:
        r = spelled_digits(r)
    if marks:
        r = addresses(r)
    if r.text == text:
        return []
    out = []
    for s, k, e in detect(r.text):
        a, b = r.source(s, e)
        if text[a:b] != r.text[s:e] and not any(k == j and x < b and a < y for x, j, y in base):
            out.append((a, k, b))
    return out


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


COLUMNS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long"


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every whole text; one narrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in range(7)]
            for t in b.column(1).to_pylist():
                base = detect(t)
                more = disguised(t, base)
                for k in range(4):
                    rows[k].append(sum(x[1] == k for x in base))
                rows[4].append(hashlib.sha256(digest(base).encode()).hexdigest())
                rows[5].append(digest(sorted(base + more)))
                rows[6].append(len(more))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, t) for x, t in zip(rows, kinds, strict=True)]], names)

    return doc_texts(docs).mapInArrow(run, COLUMNS)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(read_table(spark, sf_dir, "documents"))
