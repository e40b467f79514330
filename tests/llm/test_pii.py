"""Disguised personal data: whole spans are found and masked."""

import numpy as np
import pytest

from marginalia.llm import pii


def found(text):
    return {k: [text[a:b] for a, b in v] for k, v in pii.added(text, pii.detect(text)).items() if v}


@pytest.mark.parametrize("part", ["ivаn.petrov@mail.org", "jo[dot]smith@example.org", "jo@mail.example[dot]org"])
def test_partly_disguised(part):
    text = f"write to {part}, please"
    assert found(text) == {"email": [part]} and pii.detect(text)["email"]
    assert pii.mask(text, pii.MASKS) == "write to <EMAIL>, please"


@pytest.mark.parametrize(
    ("kind", "part"),
    [
        ("ip", "one.two.three.four"),
        ("ip", "192.168.one.one"),
        ("ip", "192 dot 168 dot 0 dot 1"),
        ("ip", "192.168 dot zero dot 1"),
        ("ip", "one nine two dot one six eight dot zero dot one"),
        ("ip", "one[dot]two[dot]three[dot]four"),
        ("card", "4111 1111 1111 one one one one"),
        ("card", "four, one, one, one, 1111 1111 1111"),
        ("phone", "+4 four 2 zero 7 nine 4 six 0 nine"),
        ("phone", "+44 (two zero) 7946 oh nine five eight"),
        ("email", "jo at studio dot design"),
        ("email", "jo dot smith at mail dot example dot org"),
        ("email", "jo@" + " dot ".join(["part"] * 20) + " dot org"),
        ("email", "jo at " + " dot ".join(["part"] * 20) + " dot org"),
    ],
)
def test_disguised(kind, part):
    assert found(f"see {part}, please") == {kind: [part]}
    assert found(f"sеe {part}, please") == {kind: [part]}, "the same beside a homoglyph"


@pytest.mark.parametrize("text", ["meet at noon dot the i", "look at it", "one or two of the three", "dot dot dot", "in 2019 one man, 3 dot 5", "at ten dot ten"])
def test_prose_stays(text):
    assert found(text) == {}


@pytest.mark.parametrize("part", ["one ", "a dot ", "a at ", " at a dot b", "[dot]", "1 dot ", "(", "+", "- ", "@", "x"])
def test_linear(part):
    pii.mask(part * 40_000, pii.MASKS)


def spans_of(text):
    base = pii.detect(text)
    return {(k, text[a:b]) for k, spans in pii.added(text, base).items() for a, b in spans}


def test_other_languages_and_forms():
    found = {
        "jo arobase exemple point fr": ("email", "jo arobase exemple point fr"), "schreib jo at beispiel punkt de bitte": ("email", "jo at beispiel punkt de"), "escribe a jo arroba ejemplo punto es": ("email", "jo arroba ejemplo punto es"),
        "jo_at_mail_dot_com": ("email", "jo_at_mail_dot_com"), "jo-at-mail-dot-com": ("email", "jo-at-mail-dot-com"), "𝐣𝐨@mail.com": ("email", "𝐣𝐨@mail.com"), "jo [arobase] mail [point] fr": ("email", "jo [arobase] mail [point] fr"),
        "+33 quatre deux zéro sept neuf quatre six zéro": ("phone", "+33 quatre deux zéro sept neuf quatre six zéro"), "+49 eins zwei drei vier fünf sechs sieben acht": ("phone", "+49 eins zwei drei vier fünf sechs sieben acht"), "+34 uno dos tres cuatro cinco seis siete ocho": ("phone", "+34 uno dos tres cuatro cinco seis siete ocho"),
        "host 192 punkt 168 punkt 0 punkt 1": ("ip", "192 punkt 168 punkt 0 punkt 1"), "mail jo@mail dot com now": ("email", "jo@mail dot com"),
    }
    for text, want in found.items():
        assert want in spans_of(text), text


def test_plain_texts_stay_clean():
    for text in ("jo@mail.com dot the end", "meet me at noon dot matrix printers", "un point de vue, deux points", "der Punkt at home punkt", "neuf ou dix points at the end", "jo@mail.com point barre aussi", "one of us at home", "null und nichts, ein Punkt eins"):
        assert spans_of(text) == set(), text


def test_base_of_a_whole_table(spark):
    """The base digest of every row against a plain scan by the contract's expressions."""
    import hashlib
    import re

    from test_llm import prose

    draw = np.random.default_rng(6)
    bits = ["jo.do@mail.example.org", "a@b", "x@y.z.", "@q.r", "10.0.0.255", "10.0.0.256", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "41111111111111111111", "+44 20 7946 0958", "+1 (212) 555.0123", "+12", "%._@-.-", "ü@ü.de", "3 3 3"]
    texts = [" ".join(x for w in prose(i, 12).split() for x in (w, bits[draw.integers(0, len(bits))])) + draw.choice(["", ".", "\n"]) for i in range(150)] + [None, ""]
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    want = {i: hashlib.sha256(",".join(f"{k}:{m.start()}:{m.end()}" for k, (x, ok) in rules.items() for m in re.finditer(x, t or "") if ok(m[0])).encode()).hexdigest() for i, t in enumerate(texts)}
    got = pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.base_sha256 for r in got.collect()} == want
