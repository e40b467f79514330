"""Text functions as column expressions.

Everything runs inside the JVM but for Unicode normalisation and character
names, which Spark lacks; those are Arrow-batched functions.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

ARRAY_BREAK = "!!!!!"
WHITE = r"[\s\x{A0}]+"


def _fold(s: str) -> str:
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).casefold()
    return unicodedata.normalize("NFC", s.replace("œ", "oe").replace("æ", "ae").replace("đ", "d").strip())


#: Texts that ``batched`` holds as Python objects at a time.
HELD_TEXTS = 256


def batched(f: Callable[[str], str]) -> Callable[[Column], Column]:
    """A text function as an Arrow-batched column function, made when it is first used in a session; few texts of a batch are Python objects at a time."""

    def run(s: pa.Array) -> pa.Array:
        made = lambda part: pa.array([None if x is None else f(x) for x in part.to_pylist()], pa.string())
        return pa.concat_arrays([made(s.slice(i, HELD_TEXTS)) for i in range(0, max(1, len(s)), HELD_TEXTS)])

    run.__annotations__ = {"s": pa.Array, "return": pa.Array}
    return lambda c: F.arrow_udf(run, StringType())(c)


def _compose(s: str) -> str:
    return unicodedata.normalize("NFC", s)


def nfc(c: Column) -> Column:
    """Canonical composition."""
    return batched(_compose)(c)


def normalize_text(c: Column) -> Column:
    """The search form of a text: no accents, case-folded, œ æ đ opened; null is empty."""
    return batched(_fold)(F.coalesce(c, F.lit("")))


def normalize_list(c: Column) -> Column:
    """The search form of an array: a match cannot cross its elements."""
    return normalize_text(F.array_join(c, ARRAY_BREAK))


def _latin_folds() -> tuple[str, str, dict[str, str]]:
    """Single letters of the Latin blocks and what they fold to; and those that become several letters."""
    ones, manies = {}, {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(code)
        folded = _fold(c)
        if folded != c and unicodedata.category(c).startswith("L"):
            (ones if len(folded) == 1 else manies)[c] = folded
    return "".join(ones), "".join(ones.values()), manies


def search_key(c: Column) -> Column:
    """normalize_text for Latin text without leaving the JVM: combining marks go, letters fold by a table."""
    source, target, several = _latin_folds()
    c = F.translate(F.lower(c), source, target)
    for one, many in several.items():
        if len(one.lower()) == 1 and one.lower() == one:
            c = F.replace(c, F.lit(one), F.lit(many))
    return F.btrim(F.regexp_replace(c, r"\p{Mn}", ""))


def _fold_each(s: str) -> str:
    special = {"œ": "oe", "æ": "ae", "đ": "d"}
    return "".join(special.get(f := c.casefold(), f) for c in s)


def fold_chars(c: Column) -> Column:
    """Case folding of each character by itself, œ æ đ opened; accents stay."""
    return batched(_fold_each)(c)


def squeeze(c: Column) -> Column:
    """Trim, and one space for each run of white space."""
    return F.btrim(F.regexp_replace(c, WHITE, " "))


# Spellings of the same sound, longest first.
SOUNDS = [("r̥̄", "ṝ"), ("l̥̄", "ḹ"), ("r̥", "ṛ"), ("l̥", "ḷ"), ("m̐", "ṃ"), ("ṁ", "ṃ")]


def normalize_passage(c: Column) -> Column:
    """Passage text for comparison: lower case, one spelling a sound, no hyphens, ’ as a, letters, marks and spaces only."""
    c = F.lower(c)
    for old, new in SOUNDS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.btrim(F.regexp_replace(F.replace(c, F.lit("’"), F.lit("a")), r"[^\s\p{L}\p{M}]", ""))


# Marks that leave passages, inside the brackets of a regular expression.
PASSAGE_MARKS = r'◉◆“”.+\\,|/"॥।*!'


def clean_passage(c: Column) -> Column:
    """Drop editorial numbers and marks, unify schwa, quotes and white space."""
    c = F.replace(F.regexp_replace(nfc(c), r"\[\d+.*?\]", ""), F.lit("[]"), F.lit(""))
    c = F.translate(c, "ә_", "ə ")
    c = F.regexp_replace(c, f"[{PASSAGE_MARKS}]", "")
    return squeeze(F.translate(c, "'ʼ", "’’"))


def trigrams(c: Column) -> Column:
    """The distinct runs of three characters; none in a shorter text."""
    # shifted arrays of characters: a lambda that named the text would compute it for every character
    chars, join = F.split(c, ""), lambda a, b: F.concat(a, b)  # noqa: PLW0108
    grams = F.zip_with(F.zip_with(chars, F.slice(chars, F.lit(2), F.size(chars)), join), F.slice(chars, F.lit(3), F.size(chars)), join)
    return F.when(c.isNull(), None).otherwise(F.array_distinct(F.filter(grams, lambda g: g.isNotNull())))


def _ordered_grams(s: str) -> str:
    x = np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.int64)
    g = np.unique(x[:-2] << 42 | x[1:-1] << 21 | x[2:])
    return np.stack([g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF], 1).astype(np.uint32).tobytes().decode("utf-32-le")


def ordered_grams(c: Column) -> Column:
    """The ``trigrams`` of a text in order, as one string."""
    return batched(_ordered_grams)(c)


def set_jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two texts' trigram sets; 0 where neither has any."""
    return set_jaccard(trigrams(a), trigrams(b))


#: Characters whose trigrams ``gram_likeness`` counts at a time; a longer text is counted by itself.
COUNTED_CHARS = 1 << 20


def stretches(lengths: np.ndarray, most: int = COUNTED_CHARS) -> list[tuple[int, int]]:
    """Bounds of runs of texts that have some ``most`` characters together."""
    edges = np.flatnonzero(np.diff(np.cumsum(lengths) // most)) + 1
    return list(zip([0, *edges.tolist()], [*edges.tolist(), len(lengths)], strict=True)) if len(lengths) else []


def gram_sets(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct trigrams of each text, as (number of the text, gram) in this order, and the letters in whose places the grams are counted."""
    flat, n = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), len(texts)
    letters = np.flatnonzero(np.bincount(flat, minlength=1))
    place = np.zeros(letters[-1] + 1 if len(letters) else 1, dtype=np.int64)
    place[letters] = np.arange(len(letters))
    at, owner = place[flat], np.repeat(np.arange(n), [len(x) for x in texts])
    whole = owner[:-2] == owner[2:]
    # below 2^61: there are fewer than 2^20.1 characters
    grams, row, base = ((at[:-2] * len(letters) + at[1:-1]) * len(letters) + at[2:])[whole], owner[:-2][whole], len(letters) ** 3
    some = None
    if base * n >= 1 << 62:
        some, grams = np.unique(grams, return_inverse=True)
        base = len(some)
    keys = np.sort(row * base + grams)
    if not len(keys):
        return keys, keys, letters
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    row = np.repeat(np.arange(n), np.diff(np.searchsorted(keys, np.arange(n + 1) * base)))
    grams = keys - row * base
    return row, grams if some is None else some[grams], letters


def gram_names(grams: np.ndarray, letters: np.ndarray) -> list[str]:
    """Grams as text."""
    n = max(1, len(letters))
    text = letters[np.stack([grams // n // n, grams // n % n, grams % n], 1).ravel()].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass") if len(grams) else ""
    return [text[i : i + 3] for i in range(0, len(text), 3)]


def _gram_likeness(texts: Sequence[str], asked: str) -> np.ndarray:
    """The similarity of each text's trigram set with that of ``asked``; 0 where neither has any."""
    n = len(texts)
    row, grams, _ = gram_sets([*texts, asked])
    sizes = np.bincount(row, minlength=n + 1)
    both = np.bincount(row[np.isin(grams, grams[row == n])], minlength=n + 1)[:n]
    either = sizes[:n] + sizes[n] - both
    return np.where(either > 0, both / np.maximum(either, 1), 0.0)


def gram_likeness(c: Column, asked: str) -> Column:
    """``jaccard`` of texts and a given one, counted in Arrow batches; null where a text is."""

    def run(s: pd.Series) -> pd.Series:
        given = s.dropna()
        texts = given.tolist()
        out = [_gram_likeness(texts[a:b], asked) for a, b in stretches(np.array([len(x) for x in texts]))]
        return pd.Series(np.concatenate(out) if out else np.zeros(0), given.index, dtype=float).reindex(s.index)

    return F.pandas_udf(run, DoubleType())(c)


def clean_file(c: Column) -> Column:
    """File text without byte-order mark, line-end blanks and empty edges, composed, with the Latin schwa, one line feed at the end."""
    c = F.regexp_replace(F.regexp_replace(c, "^﻿", ""), r"[^\S\n]+(?=\n|$)", "")
    c = F.regexp_replace(F.regexp_replace(c, r"^\n+", ""), r"\s+$", "")
    c = F.translate(nfc(c), "ә", "ə")
    return F.when(F.length(c) > 0, F.concat(c, F.lit("\n"))).otherwise(c)


def clusters(c: Column) -> Column:
    """Grapheme clusters."""
    return F.regexp_extract_all(c, F.lit(r"(\X)"), 1)


def _names(s: str) -> str:
    return ", ".join(unicodedata.name(c, f"U+{ord(c):04X}") for c in s)


def character_names(c: Column) -> Column:
    """Names of a cluster's code points, or their numbers."""
    return batched(_names)(c)


def sentence_case(c: Column) -> Column:
    """First word capitalised, the rest unchanged; null is empty."""
    c = F.ltrim(F.coalesce(c, F.lit("")))
    head = F.substring_index(F.regexp_replace(c, r"^(\S+)\s+", "$1\u0001"), "\u0001", 1)
    rest = F.regexp_replace(c, r"^\S+\s*", "")
    cap = F.concat(F.upper(F.substring(head, 1, 1)), F.lower(F.substring(head, F.lit(2), F.length(head))))
    return F.when(F.length(rest) > 0, F.concat_ws(" ", cap, rest)).otherwise(cap)


def format_url(pattern: str, *args: Column) -> Column:
    """printf into a URL, percent-quoted but for / and :."""
    c = F.url_encode(F.format_string(pattern, *args) if args else F.lit(pattern))
    for quoted, plain in (("+", "%20"), ("%2F", "/"), ("%3A", ":"), ("%7E", "~"), ("*", "%2A")):
        c = F.replace(c, F.lit(quoted), F.lit(plain))
    return c


def to_boolean(c: Column, default: bool | None = None) -> Column:
    low = F.lower(c)
    return F.when(low.isin("true", "yes", "on", "1"), True).when(low.isin("false", "no", "off", "0"), False).otherwise(F.lit(default).cast("boolean"))


def from_boolean(c: Column) -> Column:
    return F.when(c, "true").otherwise("false")


# Metrical signs as typed and as printed; a danda stands for a bar.
METRE = {"-": "⏑", "+": "–", "=": "⏓", "2": "⏔", "।": "|", "॥": "‖"}


def is_meter(c: Column) -> Column:
    """Whether a text is a metrical pattern."""
    return F.coalesce(c.rlike(r"^[-+=0-9|/।॥]+$"), F.lit(False))


def meter_segments(c: Column) -> Column:
    """A pattern's printed segments; runs of digits and double bars stay together."""
    printed = lambda s: F.replace(F.translate(s, "".join(METRE), "".join(METRE.values())), F.lit("‖"), F.lit("||"))
    return F.transform(F.regexp_extract_all(c, F.lit(r"(\|\||[0-9]{2,}|.)"), 1), lambda s: F.when(s.rlike("^[0-9]{2,}$"), s).otherwise(printed(s)))


def meter_pattern(c: Column) -> Column:
    return F.array_join(meter_segments(c), "")


def _tamil(kind: str, names: str) -> str:
    return "".join(unicodedata.lookup(f"TAMIL {kind} {n}") for n in names.split())


# Tamil letters by name and their Latin forms.
CONSONANTS = dict(zip(_tamil("LETTER", "KA NGA CA JA NYA TTA NNA TA NA NNNA PA MA YA RA RRA LA LLA LLLA VA SHA SSA SA HA"), "k ṅ c j ñ ṭ ṇ t n ṉ p m y r ṟ l ḷ ḻ v ś ṣ s h".split(), strict=True))
VOWELS = dict(zip(_tamil("LETTER", "A AA I II U UU E EE AI O OO AU"), "a ā i ī u ū e ē ai o ō au".split(), strict=True))
VOWEL_SIGNS = dict(zip(_tamil("VOWEL SIGN", "AA I II U UU E EE AI O OO AU"), "ā i ī u ū e ē ai o ō au".split(), strict=True))
OTHERS = dict(zip(_tamil("SIGN", "ANUSVARA VISARGA") + _tamil("DIGIT", "ZERO ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE") + "ௐ௰௱௲", "ṃ ḥ 0 1 2 3 4 5 6 7 8 9 oṃ 10 100 1000".split(), strict=True))
VIRAMA = "்"


def tamil_to_latin(c: Column) -> Column:
    """Transliteration; a consonant without vowel sign or virama gets the inherent a."""
    letters, signs = "".join(CONSONANTS), "".join(VOWEL_SIGNS)
    c = F.regexp_replace(c, f"([{letters}])(?![{signs}{VIRAMA}])", "$1a")
    c = F.translate(c, letters + VIRAMA, "".join(CONSONANTS.values()))
    both = VOWELS | VOWEL_SIGNS | OTHERS
    single = {k: v for k, v in both.items() if len(v) == 1}
    c = F.translate(c, "".join(single), "".join(single.values()))
    for k, v in both.items():
        if len(v) > 1:
            c = F.replace(c, F.lit(k), F.lit(v))
    return c


# Fractions with a character of their own.
FRACTIONS = {"0/3": "↉", "1/4": "¼", "1/2": "½", "3/4": "¾", "1/7": "⅐", "1/9": "⅑", "1/10": "⅒", "1/3": "⅓", "2/3": "⅔", "1/5": "⅕", "2/5": "⅖", "3/5": "⅗", "4/5": "⅘", "1/6": "⅙", "5/6": "⅚", "1/8": "⅛", "3/8": "⅜", "5/8": "⅝", "7/8": "⅞"}


def fraction(c: Column) -> Column:
    """What begins with n/d or n⁄d as one character, or with a fraction slash; other text as it is."""
    table = F.create_map(*[F.lit(x) for pair in FRACTIONS.items() for x in pair])
    part = lambda i: F.regexp_extract(c, "^([0-9]+)[/⁄]([0-9]+)", i).cast("long").cast("string")
    shown = F.coalesce(F.try_element_at(table, F.concat(part(1), F.lit("/"), part(2))), F.concat(part(1), F.lit("⁄"), part(2)))
    return F.when(c.rlike("^[0-9]+[/⁄][0-9]+"), shown).otherwise(c)


def markup_text(c: Column) -> Column:
    """Text of HTML or XML: scripts, styles, comments and tags go, the five common entities are read, white space is squeezed."""
    c = F.regexp_replace(c, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return squeeze(c)


def absolute_link(c: Column, base: Column) -> Column:
    """A link as an absolute URL, seen from the page ``base``."""
    root = F.regexp_extract(base, r"^([a-z][a-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/])/[^/]*$", "")
    return F.when(c.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), c).when(c.startswith("//"), F.concat(F.regexp_extract(base, "^([a-z]+:)", 1), c)).when(c.startswith("/"), F.concat(root, c)).otherwise(F.concat(folder, F.lit("/"), c))


def rewrite_ref(c: Column, own_hosts: Sequence[str] | Column, prefix: str = "") -> Column:
    """A reference as used inside the corpus: own host, prefix and file extension removed; foreign URLs unchanged.

    ``own_hosts`` are the hosts, or a column that says whether the reference's is one."""
    host = F.regexp_extract(c, r"^https?://([^/?#]+)", 1)
    inner = F.regexp_replace(c, r"^https?://[^/?#]+", "")
    inner = F.when(inner.startswith("/"), inner).otherwise(F.concat(F.lit("/"), inner))
    if prefix:
        inner = F.when(inner.startswith(f"/{prefix}"), F.substring(inner, F.lit(len(prefix) + 2), F.length(inner))).otherwise(inner)
        inner = F.when(inner.startswith("/"), inner).otherwise(F.concat(F.lit("/"), inner))
    inner = F.regexp_replace(inner, r"\.(?:xml|html?)(?=$|[?#])", "")
    return F.when((host == "") | (own_hosts if isinstance(own_hosts, Column) else host.isin(list(own_hosts))), inner).otherwise(c)


def gap_text(reason: Column, quantity: Column, unit: Column, precision: Column, physical: bool = False, doubtful: Column | None = None) -> Column:
    """How a gap is shown: [3+] lost, [3×] illegible, [3*] neither or both, a dot for each component of a character,
    [3 lost lines] of other units, […] without a count, an ellipsis by itself. ``ca.`` marks a low precision.

    The physical view has a star for each character, counted or not by a low precision. Empty texts are nulls."""
    some = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), F.lit(default))
    why, what = some(reason, "undefined"), some(unit, "character")
    n = F.when(quantity.rlike("^[0-9]+$"), quantity.cast("int"))
    said = F.when(why == "undefined", "lost or illegible").otherwise(why)
    if doubtful is not None:
        said = F.when(doubtful, F.concat(F.lit("possibly "), said)).otherwise(said)
    noun = F.when(what == "component", "character component").otherwise(what)
    about = (F.coalesce(precision, F.lit("")) == "low") & (F.lit(not physical) | (what != "character"))
    sign = F.when(said == "lost", "+").when(said == "illegible", "×").otherwise("*")
    one = F.repeat(F.lit("*"), n) if physical else F.concat(n.cast("string"), sign)
    body = F.when(what == "character", one).when(what == "component", F.repeat(F.lit("."), n)).otherwise(F.concat_ws(" ", n.cast("string"), said, plural(noun, n)))
    counted = F.concat(F.lit("["), F.when(about, "ca. ").otherwise(""), body, F.lit("]"))
    unknown = F.when(what == "character", "[…]").otherwise(F.concat_ws(" ", F.lit("[unknown number of"), said, F.concat(plural(noun, F.lit(2)), F.lit("]"))))
    return F.when(why == "ellipsis", "…").when(n.isNotNull(), counted).otherwise(unknown)


def numeral_note(value: Column, at_least: Column, at_most: Column, certainty: Column, text: Column) -> Column:
    """A numeral's note: its value or range, and whether it is doubtful; null where the text itself says as much. Empty texts are nulls."""
    value, low, high = (F.nullif(c, F.lit("")) for c in (value, at_least, at_most))
    doubtful = F.coalesce(certainty, F.lit("")) == "low"
    range_ = F.when(low.isNotNull() & high.isNotNull(), F.concat(F.lit("Numeral between "), low, F.lit(" and "), high, F.lit(" inclusive")))
    range_ = range_.when(low.isNotNull(), F.concat(F.lit("Numeral greater than or equal to "), low)).when(high.isNotNull(), F.concat(F.lit("Numeral smaller than or equal to "), high))
    note = F.when(value.isNotNull(), F.concat(F.lit("Numeral "), value)).otherwise(F.coalesce(range_, F.lit("Numeral")))
    plain = F.when(value.isNotNull(), value == text).otherwise(range_.isNull() & text.rlike("^[0-9]+$"))
    return F.when(doubtful, F.concat(note, F.lit(" (low certainty)"))).when(~plain, note)


def plural(word: Column, n: Column, irregular: dict[str, str] | None = None) -> Column:
    """The form of a noun after a number; irregular forms are looked up first."""
    regular = F.when(word.rlike("(s|x|z|ch|sh)$"), F.concat(word, F.lit("es"))).when(word.rlike("[^aeiou]y$"), F.concat(F.regexp_replace(word, "y$", ""), F.lit("ies"))).otherwise(F.concat(word, F.lit("s")))
    if irregular:
        table = F.create_map(*[F.lit(x) for pair in irregular.items() for x in pair])
        regular = F.coalesce(F.try_element_at(table, word), regular)
    return F.when(n == 1, word).otherwise(regular)


def epoch_format(c: Column, pattern: str = "yyyy-MM-dd'T'HH:mm:ss'Z'") -> Column:
    """Seconds since 1970 as text in the session's time zone."""
    return F.date_format(F.timestamp_seconds(c), pattern)
