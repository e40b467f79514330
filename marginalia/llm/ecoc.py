"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1; one binary classifier per bit
weighs hashed byte trigrams by the log odds of the languages on either side of
that bit, and its margin is the mean over a text's trigrams in units of the mean that
texts of those languages have. Bits are decoded with the logistic loss: the language
whose codeword costs least wins. The gap to the second, as a share of the gap between
texts that fit their codewords fully, is the lead; a text of two languages or of none
of them has a small one and is flagged ambiguous. A trigram that training did not meet
speaks for no language.
Trigram counts per language are sums over all labelled training rows, so the
tasks send at most languages x buckets counts each.
Null texts and texts without a letter are ``und`` with score 0; with no labelled
row everything is ``und``. Repeated rows count as often as they occur; of languages
that cost the same the first by name wins. An empty table gives an empty table. Texts
of any length are read whole. Columns beside doc_id, text and lang may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import kernel

BUCKETS = 1 << 14
#: Labels beyond so many distinct ones are an error: the model is sent to the driver.
MAX_LANGUAGES = 1024
#: Share of all trigrams' probability that is spread evenly, so that unknown ones favour nobody.
EVEN = 0.02
#: How steep the loss of a bit is, and the lead below which a text is ambiguous.
STEEPNESS, AMBIGUOUS_BELOW = 4.0, 0.4
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def held_out_by(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text has the remainder ``fold``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of texts padded with a space at both ends, and where each text's begin."""
    n = len(offsets) - 1
    lengths = np.diff(offsets) + 2
    at = np.concatenate([[0], np.cumsum(lengths)])
    padded = np.full(at[-1], 32, dtype=np.uint8)
    place = np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, np.diff(offsets))
    low = kernel.LOWER[data]
    padded[place] = np.where(kernel.SPACE[low], np.uint8(32), low)
    wide = padded.astype(np.uint32)
    hashed = (wide[:-2] * np.uint32(0x01000193) + wide[1:-1]) * np.uint32(0x85EBCA6B) + wide[2:] * np.uint32(0xC2B2AE35)
    hashed ^= hashed >> np.uint32(15)
    hashed *= np.uint32(0x2C1B3C6D)
    buckets = (hashed >> np.uint32(16)).astype(np.int64) & (BUCKETS - 1)
    keep = np.ones(len(buckets), dtype=bool)
    inner = at[1:-1]
    keep[inner - 1] = False
    keep[inner - 2] = False
    return buckets[keep], np.concatenate([[0], np.cumsum(lengths - 2)])


def count_trigrams(labelled: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows of (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, data, at in kernel.slices(batch):
                buckets, first = trigrams(data, at)
                langs = np.array(part.column("lang").to_pylist(), dtype=object)
                for lang in set(langs.tolist()):
                    mine = np.repeat(langs == lang, np.diff(first))
                    sums[lang] = sums.get(lang, 0) + np.bincount(buckets[mine], minlength=BUCKETS)
        for lang, n in sums.items():
            used = np.flatnonzero(n)
            yield pa.record_batch([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(n[used], pa.int64())], names=["lang", "bucket", "n"])

    return labelled.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def codewords(k: int) -> np.ndarray:
    """k codewords: all splits of up to 7 classes, else columns drawn by a fixed seed."""
    if k <= 7:
        rows = [bits for bits in product((1, -1), repeat=k - 1) if -1 in bits]
        return np.array([[1, *bits] for bits in rows], dtype=np.int8).reshape(-1, k).T
    draws = np.random.default_rng(7)
    length = max(16, 10 * int(np.ceil(np.log2(k))))
    options = [np.where(draws.random((k, length)) < 0.5, 1, -1) for _ in range(16)]
    apart = [min((a != b).sum() for i, a in enumerate(c) for b in c[:i]) if k <= 64 else 0 for c in options]
    code = options[int(np.argmax(apart))]
    return code[:, np.abs(code.sum(0)) < k].astype(np.int8)


class Model:
    """Languages, their codewords, and a weight per trigram bucket and bit."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        k = len(self.langs)
        shares = np.array([(1 - EVEN) * counts[lang] / max(counts[lang].sum(), 1) + EVEN / BUCKETS for lang in self.langs]).reshape(k, BUCKETS)
        self.code = codewords(k) if k > 1 else np.ones((k, 0), dtype=np.int8)
        weights = []
        for bit in self.code.T:
            above, below = shares[bit > 0].mean(0), shares[bit < 0].mean(0)
            w = np.log(above) - np.log(below)
            # margins that texts of either side have in the mean are 1 and -1
            weights.append(w / max(float((above - below) @ w) / 2, 1e-9))
        self.weights = np.array(weights, dtype=np.float32).reshape(-1, BUCKETS)

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The mean weight of each text's trigrams for each bit."""
        buckets, first = trigrams(data, offsets)
        n = np.diff(first)
        some = n > 0
        out = np.zeros((len(n), len(self.weights)))
        for b, w in enumerate(self.weights):
            if some.any():
                out[some, b] = np.add.reduceat(w[buckets].astype(np.float64), first[:-1][some]) / n[some]
        return out

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best language's number, its score and its lead over the second for each text."""
        margins = np.clip(self.margins(data, offsets), -2, 2)
        n, k = len(margins), len(self.langs)
        loss = np.logaddexp(0, -STEEPNESS * margins[:, None, :] * self.code[None, :, :]).sum(2)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = loss.argmin(1)
        if k < 2:
            return best, p[:, 0], np.ones(n)
        rest = loss.copy()
        rest[np.arange(n), best] = np.inf
        second = rest.argmin(1)
        differ = (self.code[best] != self.code[second]).sum(1)
        # a bit that fits costs STEEPNESS less than one that does not
        return best, p[np.arange(n), best], (rest[np.arange(n), second] - loss[np.arange(n), best]) / (STEEPNESS * differ)


def fit(labelled: DataFrame) -> Model:
    """Fit on all rows with a label and a text; at most languages x buckets counts come to the driver, as Arrow columns."""
    some = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts: dict[str, np.ndarray] = {}
    found = count_trigrams(some).limit(MAX_LANGUAGES * BUCKETS + 1).toArrow()
    langs = found.column("lang").combine_chunks().dictionary_encode()
    code, bucket, n = langs.indices.to_numpy(), found.column("bucket").to_numpy(), found.column("n").to_numpy()
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        counts[lang] = np.bincount(bucket[code == i], n[code == i], BUCKETS)
    if len(counts) > MAX_LANGUAGES or len(found) > MAX_LANGUAGES * BUCKETS:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return Model(counts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every row."""
    schema = "doc_id long, lang_pred string, score double, ambiguous boolean"
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part, data, at in kernel.slices(batch):
                n = part.num_rows
                if m.langs:
                    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
                    known = (letters[at[1:]] - letters[at[:-1]]) > 0
                    for i in np.flatnonzero(~known & (np.diff(at) > 0)):
                        known[i] = any(c.isalpha() for c in bytes(data[at[i] : at[i + 1]]).decode("utf-8", "replace"))
                    best, score, lead = m.predict(data, at)
                else:
                    known, best, score, lead = np.zeros(n, bool), np.zeros(n, int), np.zeros(n), np.zeros(n)
                names = [m.langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                score = np.where(known, np.clip(score, 0, 1), 0.0)
                yield pa.record_batch([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(~known | (lead < AMBIGUOUS_BELOW))], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, schema)


def op10_ecoc_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = held_out_by(F.col("doc_id"), 5, 0)
    out = predict(docs, fit(docs.where(~held).select("lang", "text")))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")
