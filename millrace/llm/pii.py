"""Personal data in plain sight and in disguise, with offsets of the source text.

Plain identifiers are matched in the text itself.  Then transducers rewrite the text:
look-alike letters and digits to ASCII, spelled digits to digits, and the written forms
of "at" and "dot" to their signs.  Every character they write remembers the span of
source characters it came from, so what is detected in the rewritten text is mapped back
to where it stands.  Plain findings are kept as they are; what the rewriting adds is
reported only where no plain finding of its kind lies.
"""

from __future__ import annotations

import hashlib
import html
import re
import string
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, ship, table

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Each takes time in proportion to the text: a try that fails at the start of a run of
#: digits fails everywhere in it, so the lookbehind changes no result.
PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}

# Characters that look like ASCII ones, and the words for digits.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y",
    "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d",
    "ӏ": "l", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ɡ": "g", "ѡ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I",
    "У": "Y", "Ѕ": "S", "Ј": "J", "Ӏ": "I", "Ԍ": "G", "Ԛ": "Q",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k",
    "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I",
    "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ı": "i", "․": ".", "。": ".", "‐": "-",
    "‑": "-", "‒": "-", "–": "-", "\u00a0": " ", "\u202f": " ",
}
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4",
    "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5",
    "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5",
    "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5",
    "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
}
# Ends of host names that are no common words.  Only these follow a bare "at".
ENDINGS = frozenset(
    "com org net edu gov mil int info biz io co ai app dev example test invalid local localhost uk de fr es eu ch nl "
    "se pl br ru cn jp ca au nz mx ar kr dk fi pt cz gr hu ie za tv cc xyz online site shop store cloud tech blog "
    "tw hk sg il tr ua ro bg hr lt lv ee sk si rs cl pe ve ec uy th vn ph my id ng ke eg ma pk bd lk ir sa ae qa".split()
)

#: Characters without width that may be put inside an identifier.
UNSEEN = frozenset("\u200b\u200c\u200d\u2060\ufeff\u00ad")
#: What the first transducer rewrites: the above, full-width and styled forms, digits of any
#: script, and ASCII characters written as entities of a page or of an address.
ODD = re.compile(
    "[" + "".join(LOOKALIKES) + "".join(UNSEEN)
    + "\uff01-\uff5e\u2070-\u2089\u2460-\u2468\u24b6-\u24e9\U0001d400-\U0001d7ff]|[^\\x00-\\x7f\\D]"
)
ENTITY = re.compile(r"&(?:#[0-9]{2,3}|#[xX][0-9a-fA-F]{2}|commat|period|lowbar|plus|hyphen);|%40|%2[eE]")

#: An address or number whose characters stand apart, with one blank between any two.
SPACED = re.compile(r"(?<!\S)[A-Za-z0-9@._%+-](?: [A-Za-z0-9@._%+-](?!\S))++")

_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_POINT = "dot|point|punto|punkt"
#: Runs of spelled digits, with digits and signs between them.
_TOKEN = rf"(?:{_WORD}|plus|[0-9]+)(?!\w)"
SPELLED = re.compile(
    rf"(?i)(?<!\w)\(?{_TOKEN}(?:(?:[ \-.,()]{{1,3}}|[ \-,]{{1,3}}(?:{_POINT})[ \-,]{{1,3}}){_TOKEN})++"
)
SPELLED_TOKEN = re.compile(rf"(?i){_WORD}|plus|{_POINT}|[0-9]+|[^a-z0-9]")
#: Two of them in a row; looked for in lower case, after a sign or a blank.
SPELLED_HINT = re.compile(rf"\W(?:{_WORD}|plus)[ \-.,()]{{1,3}}(?:{_WORD}|{_POINT}|[(0-9])")
#: Digits among which letters stand for some: O and o for 0, l and I for 1.
LETTERED = re.compile(
    r"(?<![A-Za-z0-9])\+?[0-9OolI]++(?![A-Za-z0-9])(?:[ ().-]{1,2}[0-9OolI]++(?![A-Za-z0-9]))*+"
)
LETTERED_HINT = re.compile(
    r"[0-9](?:(?=[ ().-]{0,2}[OolI])|(?<=[OolI][0-9])|(?<=[OolI][ ().-][0-9])|(?<=[OolI][ ().-]{2}[0-9]))"
)
LETTERS = str.maketrans("OolI", "0011")
_ATS = "at|arroba|arobase"
# The patterns of signs are for text in lower case, and each begins with something rare.
#: The dot in brackets, between signs, as a word, and between blanks before an ending or a number.
DOT = re.compile(
    rf"[\[({{<]\s{{0,2}}(?:{_POINT}|\.)\s{{0,2}}[\])}}>]|(?<=[-_*])(?:{_POINT})(?=[-_*])|(?<=[ \t])(?:{_POINT})(?=[ \t])"
    rf"|\.(?<=[ \t]\.)(?=[ \t]{{1,2}}(?:[0-9]|(?:{'|'.join(sorted(ENDINGS))})(?![a-z0-9])))"
)
#: The at-sign in brackets or between signs, which is one wherever it stands.
AT = re.compile(
    rf"[\[({{<]\s{{0,2}}(?:{_ATS}|@)\s{{0,2}}[\])}}>]|(?<=[-_*])(?:{_ATS})(?=[-_*])|\((?<=\S\()(?:a|ä)\)(?=\S)"
)
#: The bare word or sign, which counts only before a domain with a known ending; prose has
#: such words too, so the word also needs a disguised dot.
BARE_AT = re.compile(rf"(?<=\S)[ \t]{{1,2}}(?:{_ATS}|@)[ \t]{{1,2}}|(?<=\S)[ \t]{{1,2}}@|(?<=\S)@[ \t]{{1,2}}")
POINTS = tuple(_POINT.split("|"))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _valid(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in found.split("."))
    if kind == "card":
        digits = found.replace(" ", "").replace("-", "")
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= sum(c.isdigit() for c in found) <= 15
    return True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the run of local characters before each at-sign, and a domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def plain(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of plain identifiers, end exclusive, by kind."""
    found = [(a, b, "email") for a, b in _emails(text)]
    for kind, need in (("ip", "."), ("card", ""), ("phone", "+")):
        if need in text:
            found += [(m.start(), m.end(), kind) for m in PATTERNS[kind].finditer(text) if _valid(kind, m[0])]
    return found


class Tape:
    """A text under rewriting, and for each of its characters the source span."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text))
        self.end = self.start + 1

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Put new strings in place of spans, given in order and apart."""
        if not edits:
            return
        text, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            starts += [self.start[at:a], np.full(len(new), self.start[a])]
            ends += [self.end[at:a], np.full(len(new), self.end[b - 1])]
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.start = np.concatenate([*starts, self.start[at:]])
        self.end = np.concatenate([*ends, self.end[at:]])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return int(self.start[a:b].min()), int(self.end[a:b].max())


def _ascii(c: str) -> str:
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c in UNSEEN:
        return ""
    if c.isdecimal():
        return str(int(c))
    plain_form = unicodedata.normalize("NFKC", c)
    return plain_form if len(plain_form) == 1 and plain_form.isascii() else c


def _entity(found: str) -> str:
    new = chr(int(found[1:], 16)) if found[0] == "%" else html.unescape(found)
    new = "-" if found == "&hyphen;" else new
    return new if len(new) == 1 and " " < new <= "~" else found


def _spelled(run: str) -> str:
    """A run of spelled digits in digits; signs between them stay, blanks go."""
    out = []
    for m in SPELLED_TOKEN.finditer(run):
        t = m[0].lower()
        if t in DIGIT_WORDS:
            out.append(DIGIT_WORDS[t])
        elif t == "plus":
            out.append("+")
        elif t in POINTS:
            out.append(".")
        elif t.isdigit():
            out.append(t)
        else:
            out.append("".join(c for c in t if c in ".-()"))
    return "".join(out)


def _lettered(run: str) -> str:
    """Digits for the letters of a run that is digits for the most part."""
    letters = sum(c in "OolI" for c in run)
    return run.translate(LETTERS) if 0 < letters <= sum(c.isdigit() for c in run) else run


def _replaced(pattern: re.Pattern, text: str, new) -> list[tuple[int, int, str]]:
    edits = ((m.start(), m.end(), new(m[0])) for m in pattern.finditer(text))
    return [e for e in edits if e[2] != text[e[0] : e[1]]]


def _lower(text: str) -> str:
    """In lower case, character by character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _signs(pattern: re.Pattern, text: str, new: str) -> list[tuple[int, int, str]]:
    """Signs that ``pattern`` finds, with the dashes and up to two blanks around them."""
    edits, done = [], 0
    for m in pattern.finditer(_lower(text)):
        a, b = m.span()
        if m[0][0].isalpha() and text[a - 1] in "-_*":
            a, b = a - 1, b + 1
        for _ in range(2):
            a -= a > done and text[a - 1] in " \t"
            b += b < len(text) and text[b] in " \t"
        if a >= done and text[a:b] != new:
            edits.append((a, b, new))
            done = b
    return edits


def _bare_ats(tape: Tape, source: str) -> Iterator[tuple[int, int, str]]:
    text = tape.text
    for m in BARE_AT.finditer(_lower(text)):
        if text[m.start() - 1] not in LOCAL or not (domain := DOMAIN.match(text, m.end())):
            continue
        ends = domain[0].lower().split(".")[1:]
        if not ENDINGS.intersection(ends):
            continue
        dots = (i for i in range(domain.start(), domain.end()) if text[i] == ".")
        if "@" in m[0] or any(source[tape.start[i] : tape.end[i]] != "." for i in dots):
            yield m.start(), m.end(), "@"


def disguised(text: str, known: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Identifiers that only show after rewriting and meet no known one of their kind.

    Each transducer reads what the one before it wrote, and every pattern takes time in
    proportion to the text.
    """
    tape = Tape(text)
    if not text.isascii():
        tape.rewrite(_replaced(ODD, tape.text, _ascii))
    if "&" in tape.text or "%" in tape.text:
        tape.rewrite(_replaced(ENTITY, tape.text, _entity))
    if "@" in tape.text or " a t " in tape.text:
        tape.rewrite(_replaced(SPACED, tape.text, lambda x: x.replace(" ", "") if "@" in x and len(x) > 8 else x))
    if SPELLED_HINT.search("\n" + tape.text.lower()):
        tape.rewrite(_replaced(SPELLED, tape.text, lambda x: _spelled(x) if x.upper() != x.lower() else x))
    if LETTERED_HINT.search(tape.text):
        tape.rewrite(_replaced(LETTERED, tape.text, _lettered))
    tape.rewrite(_signs(DOT, tape.text, "."))
    tape.rewrite(_signs(AT, tape.text, "@"))
    if "@" in tape.text or tape.text != text:  # a bare word needs a disguised dot
        tape.rewrite(list(_bare_ats(tape, text)))
    if tape.text == text:
        return []
    spans = []
    for a, b, kind in plain(tape.text):
        start, end = tape.source(a, b)
        if text[start:end] != tape.text[a:b] and not any(
            k == kind and s < end and start < e for s, e, k in known
        ):
            spans.append((start, end, kind))
    return spans


def find(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Plain identifiers of a text, and those that only rewriting shows."""
    base = plain(text)
    return base, disguised(text, base)


def _listed(spans: list[tuple[int, int, str]]) -> str:
    order = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{k}:{a}:{b}" for a, b, k in order)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every document.

    The counts and the digest are of plain identifiers, ``spans`` lists all, as
    kind:start:end in code points with the end exclusive, by start and then kind.  A null
    or empty text has none; a very long one is read whole, in time in proportion to it;
    repeated rows each give a row; other columns are ignored; an
    empty table gives no rows.  One pass over whole texts, no shuffle.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for t in batch.column(1):
                base, more = find(t.as_py())
                counts.append([sum(s[2] == k for s in base) for k in KINDS])
                digests.append(hashlib.sha256(_listed(base).encode()).hexdigest())
                spans.append(_listed(base + more))
            n = np.array(counts, dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(n[:, i]) for i in range(4)), pa.array(digests, pa.string()),
                 pa.array(spans, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    counted = ", ".join(f"n_{k} bigint" for k in KINDS)
    return docs.select(F.col(id_col).alias("doc_id"), body(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, {counted}, base_sha256 string, spans string"
    )


def op8_pii(spark, sf_dir):
    return personal_data(table(spark, sf_dir, "documents"))
