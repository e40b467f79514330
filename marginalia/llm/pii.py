"""Personal data by offset-preserving deobfuscation.

Base detectors read the text as it is. The method then passes the text through
small transducers that keep, for every character they write, the span of source
characters it stands for: homoglyphs and full-width forms become ASCII, spelled
digits become digits in runs of any length, and at/dot disguises become ``@`` and
``.``. A number word that follows an identifier counts as its last digit. The same
detectors run on the normalised text and their matches are mapped back; those
that no base span of their kind holds whole are added, beside a base span that
is only the undisguised part of one.
Offsets are code points of the source text, ends exclusive. Null and empty texts
have no spans; rows are independent of each other, whatever their ids, so repeated
rows and ties get equal results and an empty table gives an empty table. The time is
linear in a text's length. Columns beside doc_id and text may have any name.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits is entered at its start only: what fails there fails later in the run too.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches, one look at each ``@``: linear even in one endless word."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        first = at
        while first > floor and text[first - 1] in _LOCAL:
            first -= 1
        if domain and first < at:
            out.append((first, domain.end()))
            floor = domain.end()
        else:
            # none of these characters can begin a later match: each must run into the next @
            floor = max(floor, at)
        at = text.find("@", max(at + 1, floor))
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def _is_card(s: str) -> bool:
    return 16 <= len(d := _digits(s)) <= 19 and luhn(d)


def detect(text: str) -> dict[str, list[Span]]:
    """Spans by kind, leftmost and not overlapping within a kind."""
    return {
        "email": emails(text),
        "ip": [m.span() for m in _IP.finditer(text) if _is_ip(m[0])],
        "card": [m.span() for m in _CARD.finditer(text) if _is_card(m[0])],
        "phone": [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15],
    }


# Characters of other scripts that look like the ASCII letter or digit below them.
_LOOKS = "АВЕКМНОРСТХУаеорсухіјѕԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονɡⅼ"
_LIKE_ = "ABEKMHOPCTXYaeopcyxijsdhqwABEZHIKMNOPTYXovgl"
# Words for the digits, in English, French, German and Spanish; a digit may have several.
_DIGIT_NAMES = {
    "0": "zero oh zéro null cero", "1": "one un une eins ein uno", "2": "two deux zwei zwo dos", "3": "three trois drei tres", "4": "four quatre vier cuatro",
    "5": "five cinq fünf fuenf cinco", "6": "six sechs seis", "7": "seven sept sieben siete", "8": "eight huit acht ocho", "9": "nine neuf neun nueve",
}
DIGIT_WORDS = {word: digit for digit, words in _DIGIT_NAMES.items() for word in words.split()}
# Words for @ and for the dot in the same languages.
_AT_WORDS, _DOT_WORDS = "at|arobase|arobas|arroba|ät", "dot|point|punkt|punto"
_ZERO_WIDTH = "­​‌‍⁠﻿"
# Signs that stand for + - . @ and space.
_SIGNS = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", " ": " ", " ": " ", " ": " "}
_CHARS = dict(zip(_LOOKS, _LIKE_, strict=True)) | _SIGNS | dict.fromkeys(_ZERO_WIDTH, "")
# compatibility forms of single ASCII characters: full width, mathematical, letter-like, circled, super- and subscript; digits of other scripts
for _c in [*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x2100, 0x2150), *range(0x2460, 0x2469), *range(0x24B6, 0x24EA), *range(0x2070, 0x209D), *range(0x0660, 0x066A), *range(0x06F0, 0x06FA), *range(0x0966, 0x0970)]:
    _plain = unicodedata.normalize("NFKC", chr(_c))
    if len(_plain) == 1 and _plain.isascii() and _plain.isprintable():
        _CHARS.setdefault(chr(_c), _plain)
    elif (_digit := unicodedata.digit(chr(_c), None)) is not None:
        _CHARS.setdefault(chr(_c), str(_digit))


def _ranges(chars: Iterable[str]) -> str:
    """Characters as ranges inside brackets of a regular expression: single ones above U+FFFF would be tried one by one."""
    codes = sorted(map(ord, chars))
    runs = [(c, c) for c in codes[:1]]
    for c in codes[1:]:
        runs = [*runs[:-1], (runs[-1][0], c)] if c == runs[-1][1] + 1 else [*runs, (c, c)]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


_ODD = re.compile(f"[{_ranges(_CHARS)}]")

_OPEN, _SHUT = r"[\[({<]\s*+", r"\s*+[\])}>]"
# white space before a bracket is entered at its start only
_BEFORE = r"(?<!\s)\s*+"
# a number word as a word of its own: a set of first letters lets the search skip quickly
_NUMBER = "[" + "".join(sorted({w[0] + w[0].upper() for w in DIGIT_WORDS})) + "](?<![A-Za-z0-9].)(?:" + "|".join(f"(?<=[{w[0]}{w[0].upper()}])(?i:{w[1:]})" for w in DIGIT_WORDS) + r")(?![^\W_])"
_NUMBER_WORD = re.compile(_NUMBER, re.S)
_DIGIT = frozenset("0123456789")
#: What may stand between two items of a spelled run; the detectors read the first three.
_GAP = re.compile(r"[\x20.-]|[\x20,.-]{2}|,")
_AT = re.compile(rf"(?i:{_BEFORE}{_OPEN}(?:{_AT_WORDS}|@){_SHUT}\s*+|(?<=[A-Za-z0-9._%+-])(?P<a>[\x20_-])(?:{_AT_WORDS})(?P=a)(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])\x20@\x20(?=[A-Za-z0-9]))")
_DOT_FORM = rf"(?i:{_BEFORE}{_OPEN}(?:{_DOT_WORDS}|\.){_SHUT}\s*+|\x20(?:{_DOT_WORDS})\x20|_(?:{_DOT_WORDS})_|-(?:{_DOT_WORDS})-)"
_DOT = re.compile(_DOT_FORM)
#: A domain whose dots are partly words or in brackets.
_SPELLED_DOMAIN = re.compile(rf"(?:(?!{_DOT_FORM})[A-Za-z0-9-])++(?:(?:\.|{_DOT_FORM})(?:(?!{_DOT_FORM})[A-Za-z0-9-])++)++")
#: Words and signs of addresses that dots connect; it is entered at its start only.
_CHAIN = re.compile(rf"(?<![A-Za-z0-9._%+@-])(?:(?!{_DOT_FORM})[A-Za-z0-9._%+@-])++(?:{_DOT_FORM}(?:(?!{_DOT_FORM})[A-Za-z0-9._%+@-])++)++")
# Longer endings of domains; those of two to four letters need no list.
_ENDINGS = frozenset("local museum online travel example invalid localhost cloud agency academy digital email network global group media design studio world store support science solutions services systems technology university".split())
# Words that go on in a sentence after " dot "; none is a top-level domain.
_NO_ENDING = frozenset("the and that this these those with from was were are not but then than they she his her its our their there who when where what which had has have into some any".split())
_BRACKETED = re.compile(rf"{_OPEN}(?i:{_AT_WORDS}|{_DOT_WORDS}|@|\.){_SHUT}")
_BARE_AT = re.compile(r"[A-Za-z0-9]\x20@\x20[A-Za-z0-9]")
#: Words of a text are runs of letters, digits and bytes above ASCII.
_SPLIT = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_NUMBERS, _DOTS, _ATS = ({w.encode() for w in words} for words in (DIGIT_WORDS, _DOT_WORDS.split("|"), _AT_WORDS.split("|")))


def _may_matter(text: str) -> bool:
    """Whether any transducer can change a text in a way that matters: a bracketed or bare at or dot that may part an
    address, or a number word with a digit, a plus sign or another number word beside it. Never false where one can."""
    if _BRACKETED.search(text) or _BARE_AT.search(text):
        return True
    words = text.lower().encode("utf-8", "replace").translate(_SPLIT).split()
    known = set(words)
    dots, numbers = known & _DOTS, known & _NUMBERS
    if dots and ("@" in text or known & _ATS) or numbers and "+" in text:
        return True
    if not dots and not numbers:
        return False
    number = lambda w: w in _NUMBERS or 48 <= w[0] <= 57 or 48 <= w[-1] <= 57
    padded = [b"x", *words, b"x"]
    return any((w in _NUMBERS and (number(padded[i]) or number(padded[i + 2]))) or (w in _DOTS and number(padded[i]) and number(padded[i + 2])) for i, w in enumerate(words) if w in dots or w in numbers)


class Traced:
    """A text with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text, self.first, self.last = text, list(range(len(text))), list(range(1, len(text) + 1))

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Put texts in place of spans, in order; every new character stands for the whole span."""
        if not edits:
            return
        out, first, last, at = [], [], [], 0
        for a, b, new in edits:
            out += [self.text[at:a], new]
            first += self.first[at:a] + [self.first[a]] * len(new)
            last += self.last[at:a] + [self.last[b - 1]] * len(new)
            at = b
        self.text = "".join([*out, self.text[at:]])
        self.first, self.last = first + self.first[at:], last + self.last[at:]

    def source(self, span: Span) -> Span:
        return self.first[span[0]], self.last[span[1] - 1]


def unfold(t: Traced) -> None:
    """Homoglyphs, full-width forms and invisible characters."""
    t.replace([(m.start(), m.end(), _CHARS[m[0]]) for m in _ODD.finditer(t.text)])


def undo_digits(t: Traced) -> None:
    """Number words become digits, those of one run side by side; whether that makes an identifier is for the detectors."""
    edits: list[tuple[int, int, str]] = []
    words = [m.span() for m in _NUMBER_WORD.finditer(t.text)]
    for i, (a, b) in enumerate(words):
        gap = ""
        if i and (m := _GAP.fullmatch(t.text, words[i - 1][1], a)):
            # a separator that no detector reads is a space; a dot stays, as it may part an address
            gap = "." if m[0] == "." else "" if m[0] in ("\x20", "-") else "\x20"
            edits.append((words[i - 1][1], a, gap))
        elif (x := _before(t.text, a)) < a and (not i or words[i - 1][1] < x):
            edits.append((x, a, "\x20"))
        edits.append((a, b, DIGIT_WORDS[t.text[a:b].lower()]))
        if (x := _after(t.text, b)) > b:
            edits.append((b, x, "\x20"))
    t.replace([e for e in edits if t.text[e[0] : e[1]] != e[2]])


def _before(text: str, a: int) -> int:
    """Where a separator that no detector reads begins, between a digit and a number word at ``a``."""
    for n in (2, 1):
        if a > n and text[a - n - 1] in _DIGIT and _GAP.fullmatch(text, a - n, a) and text[a - n : a] not in ("\x20", ".", "-"):
            return a - n
    return a


def _after(text: str, b: int) -> int:
    """Where such a separator ends, between a number word that ends at ``b`` and a digit."""
    for n in (2, 1):
        if text[b + n : b + n + 1] in _DIGIT and _GAP.fullmatch(text, b, b + n) and text[b : b + n] not in ("\x20", ".", "-"):
            return b + n
    return b


def _addressed(text: str, at: int) -> bool:
    """Whether a domain with a disguised dot begins here, whose ending is of two letters or more and no common word."""
    m = _SPELLED_DOMAIN.match(text, at)
    if not m or not _DOT.search(m[0]):
        return False
    labels = _DOT.sub(".", m[0]).split(".")
    while labels and labels[-1].lower() in _NO_ENDING:
        labels.pop()
    return len(labels) > 1 and _is_ending(labels[-1])


def _is_ending(label: str) -> bool:
    """Whether a domain may end so where only words say that it is one."""
    label = label.lower()
    return label not in _NO_ENDING and (1 < len(label) < 5 and label.isalpha() or label in _ENDINGS or label.startswith("xn--"))


_ADDRESS_BEFORE = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$")
_LABEL = re.compile(r"[A-Za-z0-9-]+")


def undo_at_dot(t: Traced) -> None:
    """at/dot disguises. A bare `` at `` counts only before a domain with a disguised dot, a bare `` dot ``
    in a chain of words with an ``@`` or between digits."""
    t.replace([(m.start(), m.end(), "@") for m in _AT.finditer(t.text) if not m[0].strip(" _-").isalpha() or _addressed(t.text, m.end())])
    linked = [m.span() for m in _CHAIN.finditer(t.text) if "@" in m[0]]
    edits, k = [], 0
    for m in _DOT.finditer(t.text):
        a, b = m.span()
        while k < len(linked) and linked[k][1] < b:
            k += 1
        bare = m[0].strip(" _-").isalpha()
        # behind an address that is whole a bare word needs an ending to go on
        if bare and _ADDRESS_BEFORE.search(t.text, max(0, t.text.rfind("@", 0, a)), a) and not ((x := _LABEL.match(t.text, b)) and _is_ending(x[0])):
            continue
        if not bare or k < len(linked) and linked[k][0] < a or t.text[a - 1 : a] in _DIGIT and t.text[b : b + 1] in _DIGIT:
            edits.append((a, b, "."))
    t.replace(edits)


def inside(span: Span, others: list[Span]) -> bool:
    """Whether one of the others, which are in order and do not overlap, holds the span whole."""
    i = bisect_right(others, span[0], key=lambda x: x[0])
    return i > 0 and span[1] <= others[i - 1][1]


def added(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans that only the normalised text shows."""
    odd = not text.isascii() and _ODD.search(text) is not None
    if not odd and not _may_matter(text):
        return {k: [] for k in KINDS}
    t = Traced(text)
    if odd:
        unfold(t)
    undo_digits(t)
    undo_at_dot(t)
    if t.text == text:
        return {k: [] for k in KINDS}
    out: dict[str, list[Span]] = {}
    for kind, spans in detect(t.text).items():
        out[kind] = []
        for span in map(t.source, spans):
            if not inside(span, base[kind]) and not inside(span, out[kind]):
                out[kind].append(span)
    return out


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_spans(docs: DataFrame) -> DataFrame:
    """Counts and spans of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base = detect(text or "")
                more = added(text or "", base)
                rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed({k: base[k] + more[k] for k in KINDS}), sum(map(len, more.values()))))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def mask(text: str, masks: dict[str, str]) -> str:
    """The text with each span replaced; spans that overlap are replaced together by the first one's mask."""
    base = detect(text)
    more = added(text, base)
    spans = sorted((a, -b, k) for k in KINDS for a, b in base[k] + more[k])
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], masks[k]]
            at = -b
        else:
            at = max(at, -b)
    return "".join([*out, text[at:]])


MASKS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}


def mask_documents(docs: DataFrame, masks: dict[str, str] | None = None) -> DataFrame:
    """All columns of ``docs``, with personal data in ``text`` masked; null stays null."""
    masks = masks or MASKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t and mask(t, masks) for t in batch.column("text").to_pylist()]
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)


def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id"), F.col("text")))
