"""Packing by cutting-stock column generation.

Documents are encoded and cut into full sequences and one rest each. The rests'
lengths, rounded up to a quantum, form a histogram of at most
``capacity / quantum`` classes; only it is sent to the driver. There a linear
program over packing patterns is solved by column generation: the duals price
lengths, an unbounded knapsack by dynamic programming finds the best new
pattern, and the simplex basis takes it in until none pays. Multiplicities are
rounded down and what is left is packed greedily. The patterns go back to Spark
as ranges of ranks: documents are ranked within their class by counts and
salted groups, and each rank has its place in a pattern.
A null or empty text is the end id alone. Repeated rows are documents of their
own; pieces of one length are ranked by doc_id and start, and equal ones are
interchangeable. An empty table gives an empty table. A very long text is encoded in
parts. Columns beside doc_id and text may have any name.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm import kernel
from marginalia.llm.hilbert import SALTS, with_rank
from marginalia.llm.shared import settled, small_batches

VOCABULARY = "word_bpe_49k.json"
CAPACITY, QUANTUM, END_ID = 4096, 16, 2
#: Words whose ids a worker remembers; beyond, those met in one slice only are forgotten.
MEMO_WORDS = 400_000
#: Bytes of text encoded together; a longer text is encoded in parts cut at white space.
SLICE_BYTES = 1 << 22
_STOPS = ".,!?;:"
#: Letters below U+0180 but for U+0130, and one stop: no normalisation, and a lower case that does not depend on neighbours.
_PLAIN = "^[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+[.,!?;:]?$"
#: A character that is a token by itself between spaces.
_MARK = "\x01"


def gathered(ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ids[first:first + size] side by side, and where each one begins (one more for the end)."""
    at = np.concatenate([[0], np.cumsum(size)])
    return ids[np.arange(at[-1]) + np.repeat(first - at[:-1], size)], at


class Memo:
    """Ids of words without white space.

    The vocabulary's own rules split at white space, lower the case and separate
    letters from stops, so a word's ids do not depend on its neighbours, and those
    of letters with a stop are the ids of the lower-case letters and of the stop.
    Words of letters are encoded many at a time by a tokenizer of the same merges
    that splits at spaces only; all others by the whole tokenizer."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.stops = np.zeros(256, dtype="<u4")
        self.stops[[ord(c) for c in _STOPS]] = [self.encode(self.whole, c)[0] for c in _STOPS]
        (self.mark,) = self.encode(self.whole, _MARK)
        self.place: dict[str, int] = {}
        self.ids = np.zeros(0, dtype="<u4")
        self.first = self.size = self.met = np.zeros(0, dtype=np.int64)

    @staticmethod
    def encode(tokenizer, text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def encode_letters(self, cores: list[str], step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Ids side by side and their number for words of lower-case letters; each ends at its only token with the word-end mark."""
        parts = [self.encode(self.letters, " ".join(cores[i : i + step])) for i in range(0, len(cores), step)]
        ids = np.concatenate([*parts, np.zeros(0, dtype="<u4")])
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)

    def encode_others(self, words: list[str], step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """The same for any words: a mark before each tells them apart, unless one of them holds it."""
        out: list[np.ndarray] = []
        for i in range(0, len(words), step):
            some = words[i : i + step]
            if any(_MARK in w for w in some):
                out += [self.encode(self.whole, w) for w in some]
            else:
                ids = self.encode(self.whole, f" {_MARK} ".join(["", *some]))
                out += [x[1:] for x in np.split(ids, np.flatnonzero(ids == self.mark))[1:]]
        return np.concatenate([*out, np.zeros(0, dtype="<u4")]), np.array([len(x) for x in out], dtype=np.int64)

    def learn(self, words: list[str]) -> None:
        """Add words that are not yet known."""
        array = pa.array(words, pa.string())
        plain = pc.match_substring_regex(array, _PLAIN).to_numpy(zero_copy_only=False)
        low = pc.utf8_lower(array.filter(pa.array(plain)))
        core = pc.utf8_rtrim(low, characters=_STOPS)
        data, at = kernel.text_bytes(low)
        stopped = np.diff(at) > np.diff(kernel.text_bytes(core)[1])
        cores = core.dictionary_encode()
        ids, size = self.encode_letters(cores.dictionary.to_numpy(zero_copy_only=False).tolist())
        code = cores.indices.to_numpy()
        last = self.stops[data[at[1:][stopped] - 1]]
        # a stop is one more id behind those of the core
        first = (np.cumsum(size) - size)[code]
        n = size[code]
        source = np.concatenate([ids, last])
        begin = np.stack([first, np.where(stopped, len(ids) + np.cumsum(stopped) - 1, 0)], 1).ravel()
        letters, _ = gathered(source, begin, np.stack([n, stopped.astype(np.int64)], 1).ravel())
        others, m = self.encode_others(array.filter(pa.array(~plain)).to_pylist())
        sizes = np.concatenate([n + stopped, m])
        known = len(self.place)
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.met = np.concatenate([self.met, np.zeros(len(sizes), dtype=np.int64)])
        self.ids = np.concatenate([self.ids, letters, others])
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)]).tolist()
        self.place.update({words[i]: known + k for k, i in enumerate(order)})

    def forget(self) -> None:
        """Keep the words that were met in several slices; counts are halved, so that words of old days go too."""
        keep = np.flatnonzero(self.met > 1)
        words = list(self.place)
        self.ids, at = gathered(self.ids, self.first[keep], self.size[keep])
        self.first, self.size, self.met = at[:-1], self.size[keep], self.met[keep] // 2
        self.place = {words[i]: k for k, i in enumerate(keep.tolist())}

    def encode_texts(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, each with the end id behind it, side by side, and where each text's begin."""
        if len(self.place) > MEMO_WORDS:
            self.forget()
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        bounds = split.offsets.to_numpy()
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in distinct if w not in self.place]
        if new:
            self.learn(new)
        code = np.fromiter(map(self.place.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        self.met[code] += 1
        # the end id stands behind all known ids, as one more word
        first, size = np.append(self.first[code], len(self.ids)), np.append(self.size[code], 1)
        every = np.insert(words.indices.to_numpy().astype(np.int64), bounds[1:] - bounds[0], len(code))
        ids, at = gathered(np.append(self.ids, np.uint32(end_id)), first[every], size[every])
        return ids, at[bounds - bounds[0] + np.arange(len(bounds))]


_memos: dict[str, Memo] = {}


def memo(path: str) -> Memo:
    if path not in _memos:
        _memos[path] = Memo(path)
    return _memos[path]


def cut_at_space(data: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[np.ndarray]:
    """A long text in parts of about ``limit`` bytes that begin with white space; a word longer than that stays whole."""
    first, spaces = 0, np.flatnonzero(kernel.SPACE[data])
    while len(data) - first > limit:
        i = np.searchsorted(spaces, first + limit)
        if i == len(spaces):
            break
        yield data[first : spaces[i]]
        first = int(spaces[i])
    yield data[first:]


def encoded(batch: pa.RecordBatch, known: Memo, end_id: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with the ids of their texts and where each text's begin."""
    for part, data, at in kernel.slices(batch, limit=SLICE_BYTES):
        if len(data) <= SLICE_BYTES:
            yield part, *known.encode_texts(part.column("text"), end_id)
        else:
            ids = [known.encode_texts(pa.array([x.tobytes()], pa.binary()).cast(pa.string()), end_id)[0][:-1] for x in cut_at_space(data)]
            whole = np.concatenate([*ids, np.array([end_id], dtype="<u4")])
            yield part, whole, np.array([0, len(whole)])


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every document's pieces: full sequences, then the rest."""
    small_batches(docs)
    path = path or public_tokenizers.path(VOCABULARY)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = memo(path)
        for batch in batches:
            for part, ids, first in encoded(batch, known, end_id):
                total = np.diff(first)
                n = -(-total // capacity)
                doc = np.repeat(np.arange(len(n)), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * capacity
                length = np.minimum(capacity, total[doc] - start)
                crc = [zlib.crc32(ids[a : a + m]) for a, m in zip((first[doc] + start).tolist(), length.tolist(), strict=True)]
                columns = [part.column("doc_id").take(pa.array(doc)), *(pa.array(c, pa.int64()) for c in (start, length, crc, total[doc]))]
                yield pa.record_batch(columns, names=names)
            kernel.release()

    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def price(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: how often each length 1..capacity is taken, by unbounded knapsack."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=int)
    for room in range(1, capacity + 1):
        options = best[room - 1 :: -1][:room] + values[:room]
        i = int(options.argmax())
        best[room], took[room] = (options[i], i + 1) if options[i] > best[room - 1] else (best[room - 1], 0)
    pattern, room = np.zeros(len(values), dtype=np.int64), capacity
    while room:
        if took[room]:
            pattern[took[room] - 1] += 1
            room -= took[room]
        else:
            room -= 1
    return float(best[capacity]), pattern


def solve(demand: np.ndarray, capacity: int, gap: float = 1e-3, rounds: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Fractional multiplicities of patterns that cover the demand of lengths 1..capacity, within ``gap`` of the optimum.

    Element-wise numpy only: threaded LAPACK and BLAS calls can deadlock inside a Spark driver."""
    used = np.flatnonzero(demand)
    m = len(used)
    if not m:
        return []
    # at first each length has a pattern of its own, so the basis is diagonal
    alone = capacity // (used + 1)
    basis, inverse = np.zeros((m, m)), np.zeros((m, m))
    basis[np.arange(m), np.arange(m)] = alone
    inverse[np.arange(m), np.arange(m)] = 1 / alone
    amounts = demand[used] / alone
    for _ in range(rounds):
        duals = inverse.sum(0)
        values = np.zeros(capacity)
        values[used] = np.maximum(duals, 0)
        best, pattern = price(values, capacity)
        # amounts.sum() / best bounds the optimum from below
        if best <= 1 + gap:
            break
        column = (inverse * pattern[used]).sum(1)
        ratio = np.where(column > 1e-9, amounts / np.where(column > 1e-9, column, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = pattern[used]
        amounts = amounts - ratio[out] * column
        amounts[out] = ratio[out]
        row = inverse[out] / column[out]
        inverse -= np.outer(column, row)
        inverse[out] = row
    patterns = []
    for j in range(m):
        whole = np.zeros(capacity, dtype=np.int64)
        whole[used] = np.round(basis[:, j]).astype(np.int64)
        patterns.append((whole, max(0.0, float(amounts[j]))))
    return patterns


def rounded(demand: np.ndarray, patterns: list[tuple[np.ndarray, float]], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole multiplicities: rounded down, the remainder packed largest first."""
    left, out = demand.copy(), []
    for pattern, amount in sorted(patterns, key=lambda p: -p[1]):
        uses = pattern > 0
        times = min(int(amount + 1e-6), int((left[uses] // pattern[uses]).min()))
        if times > 0:
            out.append((pattern, times))
            left -= times * pattern
    while left.any():
        room, pattern = capacity, np.zeros_like(left)
        for i in np.flatnonzero(left)[::-1]:
            take = min(int(left[i]), room // int(i + 1))
            pattern[i] += take
            room -= take * int(i + 1)
        uses = pattern > 0
        times = int((left[uses] // pattern[uses]).min())
        out.append((pattern, times))
        left -= times * pattern
    return out


def places(plan: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, rank after the last, first sequence, pieces a sequence) of each class in each pattern."""
    filled: dict[int, int] = {}
    sequence, out = 0, []
    for pattern, times in plan:
        for i in np.flatnonzero(pattern).tolist():
            n = int(pattern[i])
            first = filled.get(i + 1, 0)
            filled[i + 1] = first + n * times
            out.append((i + 1, first, filled[i + 1], sequence, n))
        sequence += times
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY, quantum: int = QUANTUM) -> DataFrame:
    """Add sequence_id and offset to pieces with a length of 1 to ``capacity``."""
    spark, classes = cut.sparkSession, capacity // quantum
    sized = cut.withColumn("_class", F.ceil(F.col("length") / quantum).cast("int")).withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int"))
    demand = np.zeros(classes, dtype=np.int64)
    for size, n in sized.groupBy("_class").count().collect():
        demand[size - 1] = n
    table = places(rounded(demand, solve(demand, classes), classes))
    ranked, _ = with_rank(sized, "_class", "_salt", [F.col("length").desc(), F.col("doc_id"), F.col("start")], "_rank")
    before = np.concatenate([[0, 0], np.cumsum(demand)]).tolist()
    ranked = ranked.withColumn("_rank", F.col("_rank") - F.element_at(F.lit(before), F.col("_class") + 1))
    # a few entries for each class at most: the patterns of a basis
    frame = spark.createDataFrame(table, "_size int, _low long, _high long, _sequence long, _each long")
    here = (F.col("_class") == F.col("_size")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high"))
    placed = ranked.join(F.broadcast(frame), here).withColumn("sequence_id", F.col("_sequence") + F.floor((F.col("_rank") - F.col("_low")) / F.col("_each")).cast("long"))
    order = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "doc_id", "start", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))
    return placed.select(*cut.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece.

    The pieces are written once to the shared checkpoint folder, as encoding costs most."""
    return pack(settled(pieces(docs, capacity, path)), capacity)


def op8_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
