"""Alignment of two tokenizers by divide and conquer at shared cuts.

A text's tokens of either kind tile the same bytes. ``shared_cuts`` takes the
interval between two common ends, looks for a token end of A near its middle that
bisecting finds among B's as well, and goes on with both halves; an interval
without a cut is a leaf, a group of tokens. All intervals of a round are probed at once.

A space between two characters that are not white space begins a token of either
kind, whatever stands around it. So a text is cut there into units, and a task
encodes and aligns each different unit once. Tasks pack their documents into blocks:
the block's units and id pairs, and each document's bag of units. Pairs are counted
over the corpus from one row for each block and pair, a block asks for the counts of
its own pairs, and sums over units give the documents' columns. No text moves.

A null or empty text has no tokens, nor has one that a tokenizer doesn't give back
byte by byte. Rows are independent but for the counts: repeated rows count each, null
ids stay. Texts of any length are whole; columns beside doc_id and text may have any
name. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import kernel
from marginalia.llm.shared import settled, small_batches

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text in a block, or one longer document.
BLOCK_BYTES = 1 << 25
#: Units that a worker remembers from one block to the next.
MEMO_UNITS = 400_000
#: Bytes of units encoded in one call.
CHUNK_BYTES = 1 << 16
_MARK = "▁"


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of A and of B lie before the end of each group; the last ends must be equal.

    An interval's ends of A are probed from the middle outwards, each by bisecting B's."""
    if not len(ends_a):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    # rows of (first of A, end of A, first of B, end of B, probes made)
    open_ = np.array([[0, len(ends_a), 0, len(ends_b), 0]], dtype=np.int64)
    leaves = []
    while len(open_):
        a, a_end, b, b_end, tried = open_.T
        inner = a_end - a - 1
        leaf = (tried >= inner) | (b_end - b == 1)
        leaves.append(open_[leaf][:, [1, 3]])
        open_ = open_[~leaf]
        a, a_end, b, b_end, tried = open_.T
        step = (tried + 1) // 2
        i = a + (a_end - a - 2) // 2 + np.where(tried % 2 == 1, step, -step)
        j = np.searchsorted(ends_b, ends_a[i])
        cut = ends_b[j] == ends_a[i]
        missed = open_[~cut]
        missed[:, 4] += 1
        none = np.zeros(int(cut.sum()), dtype=np.int64)
        left = np.stack([a[cut], i[cut] + 1, b[cut], j[cut] + 1, none], 1)
        right = np.stack([i[cut] + 1, a_end[cut], j[cut] + 1, b_end[cut], none], 1)
        open_ = np.concatenate([missed, left, right])
    found = np.concatenate(leaves)
    found = found[np.argsort(found[:, 0])]
    return found[:, 0], found[:, 1]


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in A and in B of all pairs of tokens whose byte ranges overlap."""
    first = np.searchsorted(ends_b, np.concatenate([[0], ends_a[:-1]]), side="right")
    n = np.searchsorted(ends_b, ends_a, side="left") - first + 1
    a = np.repeat(np.arange(len(ends_a)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: itself if printable, else one of those from U+0100 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}


class Bytes:
    """What each id of a vocabulary stands for, side by side."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def of(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        at = np.cumsum(size)
        return self.data[np.arange(at[-1] if len(at) else 0) + np.repeat(self.first[ids] - at + size, size)].tobytes()


class Pair:
    """Both tokenizers of a worker."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        byte = alphabet()
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = Bytes([bytes(byte[c] for c in t) if all(c in byte for c in t) else b"" for t in entries])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = Bytes([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)])
        if any(_MARK in p.lstrip(_MARK) for p in pieces):
            raise ValueError("a piece goes over a space: texts can't be cut into units")

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """Ids of a text that begins with a space, and whether both give back its bytes."""
        a = np.array(self.a.encode(text, add_special_tokens=False).ids, dtype=np.int64)
        b = np.array(self.b.encode(text[1:]), dtype=np.int64)
        raw = text.encode()
        return a, b, self.bytes_a.of(a) == raw and self.bytes_b.of(b) == raw


def plain(unit: str) -> bool:
    """One space, then characters that are no white space at either edge: such units can be encoded side by side."""
    core = unit[1:]
    return bool(core) and core == core.strip() and core[0] != _MARK and core[-1] != _MARK


class Memo:
    """Units of a worker: their numbers of tokens and groups, their groups as text, their links as id pairs."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[str] = []
        #: n_a, n_b, n_groups, n_links, whole (0 or 1); of an unfaithful unit all are 0
        self.numbers = np.zeros((0, 5), dtype=np.int64)
        self.first = np.zeros(0, dtype=np.int64)
        self.links = np.zeros(0, dtype=np.int64)

    def learn(self, units: list[str]) -> None:
        """Encode and align units that are not yet known."""
        numbers, links, waiting, size = [], [], [], 0
        for unit in units:
            if plain(unit):
                waiting.append(unit)
                size += len(unit)
            else:
                self.align([unit], numbers, links)
            if size > CHUNK_BYTES:
                self.align(waiting, numbers, links)
                waiting, size = [], 0
        self.align(waiting, numbers, links)
        new = np.concatenate([self.numbers, *numbers])
        self.links = np.concatenate([self.links, *links])
        self.numbers, self.first = new, np.cumsum(new[:, 3]) - new[:, 3]

    def align(self, units: list[str], numbers: list, links: list) -> None:
        if not units:
            return
        a, b, whole = self.pair.encode("".join(units))
        if not whole and len(units) > 1:
            for unit in units:
                self.align([unit], numbers, links)
            return
        for unit in units:
            self.place[unit] = len(self.place)
        if not whole:
            self.groups.append("")
            numbers.append(np.zeros((1, 5), dtype=np.int64))
            return
        ends_a, ends_b = np.cumsum(self.pair.bytes_a.size[a]), np.cumsum(self.pair.bytes_b.size[b])
        cut_a, cut_b = shared_cuts(ends_a, ends_b)
        edges = np.cumsum([len(u.encode()) for u in units])
        last = np.searchsorted(ends_a[cut_a - 1], edges)  # a unit's end is an end of either kind
        tokens_a, tokens_b, n_groups = cut_a[last], cut_b[last], last + 1
        at_a, at_b = overlaps(ends_a, ends_b)
        n_links = np.searchsorted(at_a, tokens_a)
        counts = np.stack([np.diff(x, prepend=0) for x in (tokens_a, tokens_b, n_groups, n_links)], 1)
        numbers.append(np.concatenate([counts, np.ones((len(units), 1), dtype=np.int64)], 1))
        links.append(a[at_a] * len(self.pair.bytes_b.size) + b[at_b])
        text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        parts, i, j = [], 0, 0
        for x, y in zip(cut_a.tolist(), cut_b.tolist(), strict=True):
            parts.append(f"{','.join(text_a[i:x])}|{','.join(text_b[j:y])}")
            i, j = x, y
        first = 0
        for end in n_groups.tolist():
            self.groups.append(";".join(parts[first:end]))
            first = end

    def codes(self, units: pa.Array) -> np.ndarray:
        coded = units.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self.learn([u for u in distinct if u not in self.place])
        return np.fromiter(map(self.place.__getitem__, distinct), dtype=np.int64, count=len(distinct))[coded.indices.to_numpy()]


def white(data: np.ndarray) -> np.ndarray:
    """Bytes of white space and of U+2581. The White_Space property in UTF-8, and the separators 1C to 1F."""
    out = kernel.SPACE[data] | ((data >= 0x1C) & (data <= 0x1F))
    for lead, second, third in ((0xC2, (0x85, 0xA0), None), (0xE1, (0x9A,), (0x80,)), (0xE2, (0x80,), (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0xE2, (0x81,), (0x9F,)), (0xE2, (0x96,), (0x81,)), (0xE3, (0x80,), (0x80,))):
        n = 2 if third is None else 3
        at = np.flatnonzero(data[: len(data) - n + 1] == lead)
        at = at[np.isin(data[at + 1], second)]
        if third is not None:
            at = at[np.isin(data[at + 2], third)]
        for i in range(n):
            out[at + i] = True
    return out


def unit_bounds(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the units of texts begin, and the end; each text begins with a space of its own."""
    blank = white(data)
    safe = (data == 0x20) & ~np.append(True, blank[:-1]) & ~np.append(blank[1:], True)
    safe[at[:-1]] = True
    return np.append(np.flatnonzero(safe), len(data))


def packed(x: np.ndarray) -> bytes:
    raw = x.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True), dtype=kind)


class Block:
    """Documents of a task as bags of units."""

    def __init__(self, memo: Memo):
        self.memo, self.bytes = memo, 0
        self.ids: list[pa.Array] = []
        self.rows: list[np.ndarray] = []
        self.digests: list[str] = []
        self.bags: list[np.ndarray] = []

    def add(self, part: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> None:
        full = np.flatnonzero(at[1:] > at[:-1])
        spaced = np.insert(data, at[full], 0x20)
        begin = np.append(at[full] + np.arange(len(full)), len(spaced))
        bounds = unit_bounds(spaced, begin) if len(full) else np.zeros(1, dtype=np.int64)
        units = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(spaced.tobytes())])
        codes = self.memo.codes(units) if len(units) else np.zeros(0, dtype=np.int64)
        first = np.searchsorted(bounds, begin)
        rows = np.zeros((part.num_rows, 4), dtype=np.int64)
        digests = [""] * part.num_rows
        if len(full):
            numbers = np.add.reduceat(self.memo.numbers[codes], first[:-1])
            whole = numbers[:, 4] == np.diff(first)
            rows[full[whole]] = numbers[whole, :4]
            groups, listed = self.memo.groups, codes.tolist()
            for k in np.flatnonzero(whole).tolist():
                text = ";".join([groups[c] for c in listed[first[k] : first[k + 1]]])
                digests[full[k]] = hashlib.sha256(text.encode()).hexdigest()
            doc = np.repeat(np.where(whole, full, -1), np.diff(first))
            keys, times = np.unique(doc[doc >= 0] << 32 | codes[doc >= 0], return_counts=True)
            done = sum(map(len, self.rows))
            self.bags.append(np.stack([(keys >> 32) + done, keys & 0xFFFFFFFF, times]))
        self.ids.append(part.column("doc_id"))
        self.rows.append(rows)
        self.digests += digests
        self.bytes += len(data)

    def row(self, block: int) -> list[pa.Array]:
        """Documents, units and pairs, each numbered within the block."""
        doc, code, times = np.concatenate([*self.bags, np.zeros((3, 0), dtype=np.int64)], 1)
        units, bag = np.unique(code, return_inverse=True)
        n = self.memo.numbers[units, 3]
        at = np.cumsum(n) - n
        links = self.memo.links[np.arange(n.sum()) + np.repeat(self.memo.first[units] - at, n)]
        pairs, local = np.unique(links, return_inverse=True)
        uses = np.bincount(bag, times, len(units)).astype(np.int64)
        counts = np.bincount(local, np.repeat(uses, n), len(pairs)).astype(np.int64)
        rows = np.concatenate(self.rows)
        one = lambda x, kind: pa.array([x], kind)
        out = [one(block, pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), pa.concat_arrays(self.ids))]
        out += [one(x, pa.binary()) for x in (packed(rows), packed(np.stack([doc, bag, times]).astype(np.int32)), packed(n.astype(np.int32)), packed(local.astype(np.int32)))]
        return [*out, one(self.digests, pa.list_(pa.string())), one(pairs, pa.list_(pa.int64())), one(counts, pa.list_(pa.int64()))]


_pairs: dict[tuple[str, str], Pair] = {}


def tokenizers(path_a: str, path_b: str) -> Pair:
    if (path_a, path_b) not in _pairs:
        _pairs[path_a, path_b] = Pair(path_a, path_b)
    return _pairs[path_a, path_b]


BLOCK = "block long, doc_id array<long>, numbers binary, bags binary, sizes binary, links binary, digests array<string>, pairs array<long>, times array<long>"


def blocks(docs: DataFrame, path_a: str, path_b: str, limit: int = BLOCK_BYTES) -> DataFrame:
    small_batches(docs)
    names = [c.split()[0] for c in BLOCK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(tokenizers(path_a, path_b))
        task, k, block = TaskContext.get().partitionId(), 0, Block(memo)
        for batch in batches:
            for part, data, at in kernel.slices(batch, limit=1 << 22):
                if block.bytes and block.bytes + len(data) > limit:
                    yield pa.record_batch(block.row(task << 32 | k), names=names)
                    if len(memo.place) > MEMO_UNITS:
                        memo.clear()
                    k, block = k + 1, Block(memo)
                block.add(part, data, at)
        if block.rows:
            yield pa.record_batch(block.row(task << 32 | k), names=names)
        kernel.release()

    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, BLOCK)


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def finished(key: tuple, block: pa.Table, counts: pa.Table) -> pa.Table:
    """Sums over each document's links from the counts of the block's pairs."""
    row = {c: block.column(c)[0] for c in block.column_names}
    rows = unpacked(row["numbers"].as_py(), "<i8").reshape(-1, 4)
    doc, bag, times = unpacked(row["bags"].as_py(), "<i4").reshape(3, -1)
    sizes, links = unpacked(row["sizes"].as_py(), "<i4"), unpacked(row["links"].as_py(), "<i4")
    sums = []
    for c in ("top", "n"):
        by_pair = np.zeros(len(counts), dtype=np.int64)
        by_pair[counts.column("at").to_numpy()] = counts.column(c).to_numpy()
        before = np.concatenate([[0], np.cumsum(by_pair[links])])
        edge = np.concatenate([[0], np.cumsum(sizes)])
        by_unit = before[edge[1:]] - before[edge[:-1]]
        out = np.zeros(len(rows), dtype=np.int64)
        np.add.at(out, doc, by_unit[bag] * times)
        sums.append(out)
    columns = [pa.array(row["doc_id"].values), *(pa.array(x) for x in (*rows.T, *sums)), pa.array(row["digests"].values)]
    return pa.table(columns, names=[c.split()[0] for c in RESULT.split(", ")])


def pair_counts(made: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, top) of all id pairs of a corpus in blocks: the links that hold it, and 1 where none of its B id has more."""
    counted = settled(made.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n")))
    counted = counted.withColumn("b", F.pmod("pair", F.lit(n_b)))
    # a row for each id of B's vocabulary at most
    best = counted.groupBy("b").agg(F.max("n").alias("best"))
    return counted.join(F.broadcast(best), "b").select("pair", "n", (F.col("n") == F.col("best")).cast("long").alias("top"))


def token_links(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(a, b, n): the id pairs whose tokens overlap in ``docs``, and how often."""
    path_a, path_b = path_a or public_tokenizers.path(VOCABULARY_A), path_b or public_tokenizers.path(VOCABULARY_B)
    n_b = len(tokenizers(path_a, path_b).bytes_b.size)
    counts = pair_counts(blocks(docs, path_a, path_b), n_b)
    return counts.select(F.floor(F.col("pair") / n_b).cast("long").alias("a"), F.pmod("pair", F.lit(n_b)).alias("b"), "n")


def align_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, limit: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    path_a, path_b = path_a or public_tokenizers.path(VOCABULARY_A), path_b or public_tokenizers.path(VOCABULARY_B)
    made = settled(blocks(docs, path_a, path_b, limit))
    counts = pair_counts(made, len(tokenizers(path_a, path_b).bytes_b.size))
    asked = made.select("block", F.posexplode("pairs").alias("at", "pair"))
    told = asked.join(counts, "pair").select(F.col("block").alias("asked"), "at", "n", "top")
    return made.drop("pairs", "times").groupBy("block").cogroup(told.groupBy("asked")).applyInArrow(finished, RESULT)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
