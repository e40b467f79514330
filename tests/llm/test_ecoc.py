"""Language ID against a naive version, and its flag of ambiguous texts."""

import math
from collections import Counter

import numpy as np
from test_llm import docs, none, rows  # noqa: F401

from marginalia.llm import ecoc

SAID = {"en": "the of and to in that is was", "de": "der die und das nicht ist sich", "fr": "le la les des est une dans", "es": "el los una que por con para"}


def spoken(seed, lang, n=30):
    return " ".join(np.random.default_rng(seed).choice(SAID[lang].split(), n))


def rows_():
    some = [(i, spoken(i, lang), lang) for i, lang in enumerate(list(SAID) * 25)]
    return [*some, (500, None, "en"), (501, "123 !!", "en"), (502, "der die das", None), (503, spoken(1, "en") + " " + spoken(2, "fr"), None), (504, "これはどの言語でもありません" * 5, None)]


def buckets_of(text):
    low = bytes(32 if b in (9, 10, 11, 12, 13) else b + 32 if 65 <= b <= 90 else b for b in b" " + text.encode() + b" ")
    out = []
    for a, b, c in zip(low, low[1:], low[2:], strict=False):
        h = ((a * 0x01000193 + b) * 0x85EBCA6B + c * 0xC2B2AE35) % 2**32
        h = (h ^ (h >> 15)) * 0x2C1B3C6D % 2**32
        out.append((h >> 16) % ecoc.BUCKETS)
    return out


def test_predict(spark, docs, none):  # noqa: F811
    df = spark.createDataFrame(rows_(), "doc_id long, text string, lang string")
    train = df.where("doc_id % 5 <> 0 AND doc_id < 500")
    out = {r.doc_id: r for r in ecoc.predict(df, ecoc.fit(train)).collect()}
    assert np.mean([out[i].lang_pred == lang for i, _, lang in rows_()[:100] if i % 5 == 0]) > 0.95
    assert out[500].lang_pred == out[501].lang_pred == "und" and out[502].lang_pred == "de" and all(0 <= r.score <= 1 for r in out.values())
    assert out[503].ambiguous and out[504].ambiguous and not any(out[i].ambiguous for i in range(100))
    assert ecoc.predict(none, ecoc.fit(df)).count() == 0 and {r.lang_pred for r in ecoc.predict(docs, ecoc.fit(none)).collect()} == {"und"}
    # naive: counts in dictionaries, one text and one bit at a time
    counts = {lang: Counter() for lang in SAID}
    for i, text, lang in rows_():
        if i % 5 and i < 500:
            counts[lang].update(buckets_of(text))
    langs, code = sorted(SAID), ecoc.codewords(4)
    share = lambda lang, b: (1 - ecoc.EVEN) * counts[lang][b] / counts[lang].total() + ecoc.EVEN / ecoc.BUCKETS
    used = set().union(*counts.values())
    weights = []
    for bit in code.T:
        mean = lambda side, b: sum(share(x, b) for x, s in zip(langs, bit, strict=True) if s == side) / sum(s == side for s in bit)  # noqa: E731, B023
        w = {b: math.log(mean(1, b)) - math.log(mean(-1, b)) for b in used}
        scale = sum((mean(1, b) - mean(-1, b)) * w[b] for b in used) / 2
        weights.append({b: x / scale for b, x in w.items()})
    for i, text, _ in rows_():
        if text and out[i].lang_pred != "und":
            grams = buckets_of(text)
            margins = [min(2, max(-2, sum(w.get(b, 0) for b in grams) / len(grams))) for w in weights]
            loss = {x: sum(math.log1p(math.exp(-ecoc.STEEPNESS * m * s)) for m, s in zip(margins, row, strict=True)) for x, row in zip(langs, code, strict=True)}
            best = min(langs, key=loss.get)
            assert out[i].lang_pred == best and abs(out[i].score - 1 / sum(math.exp(loss[best] - x) for x in loss.values())) < 1e-4


def test_query_folds(spark, tmp_path):
    """The query learns from its folds only: labels of held-out rows change nothing, and are not needed."""
    import zlib

    some = [(i, spoken(i, lang), lang, "s") for i, lang in enumerate(list(SAID) * 30)]
    wrong = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else lang, s) for i, t, lang, s in some]
    results = []
    for name, data in (("a", some), ("b", wrong)):
        spark.createDataFrame(data, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        results.append({r.doc_id: r for r in ecoc.op10_ecoc_langid(spark, f"{tmp_path}/{name}").collect()})
    assert results[0] == results[1] and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in results[0].items())
    assert np.mean([results[0][i].lang_pred == lang for i, _, lang, _ in some if results[0][i].held_out]) > 0.95


def test_codewords():
    code = ecoc.codewords(12)
    assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 8
