"""Vectorised text kernels that Arrow-backed operators share.

A chunk is a run of documents held as one byte array with offsets. Words are
maximal runs of bytes other than space and 0x09-0x0D. Word and shingle hashes
are 64-bit polynomial hashes (mod 2**64, odd base) passed through an avalanche
step, so that equal byte sequences always have equal hashes in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that one kernel call works on; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i mod 2**64 for i up to n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(1024, n + n // 4)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, dtype=U64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        have = (out[0], out[1])
        if size <= 1 << 23:
            _powers[base] = have
    return have


def avalanche(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Texts:
    """Documents as bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1


class Chunk(Texts):
    """Documents as bytes, with the spans of their words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        super().__init__(LOWER[data] if lower else data, offsets)
        word = ~SPACE[data]
        before = np.zeros(len(data), dtype=bool)
        before[1:] = word[:-1]
        after = np.zeros(len(data), dtype=bool)
        after[:-1] = word[1:]
        full = offsets[:-1] < offsets[1:]
        before[offsets[:-1][full]] = False
        after[offsets[1:][full] - 1] = False
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        #: word_at[i]:word_at[i + 1] are the words of document i
        self.word_at = np.searchsorted(self.starts, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.word_at)

    def words(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word."""
        up, down = powers(BASES[seed], len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, dtype=U64)
        np.cumsum((self.data.astype(U64) + U64(1)) * up[: len(self.data)], out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        return avalanche(h + (self.ends - self.starts).astype(U64) * U64(BASES[3]))

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts())

    def grams(self, words: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
        """Hashes of the k words from each word on; the last k - 1 of the chunk are missing."""
        m = len(words) - k + 1
        if m <= 0:
            return np.zeros(0, dtype=U64)
        up, down = powers(BASES[seed] ^ 0x5555555555555554, len(words) + 1)
        sums = np.zeros(len(words) + 1, dtype=U64)
        np.cumsum(words * up[: len(words)], out=sums[1:])
        return avalanche((sums[k:] - sums[:-k]) * down[:m])

    def whole(self, words: np.ndarray, seed: int = 1) -> np.ndarray:
        """A hash of each document's word sequence."""
        up, down = powers(BASES[seed] ^ 0x5555555555555554, len(words) + 1)
        sums = np.zeros(len(words) + 1, dtype=U64)
        np.cumsum(words * up[: len(words)], out=sums[1:])
        h = (sums[self.word_at[1:]] - sums[self.word_at[:-1]]) * down[self.word_at[:-1]]
        return avalanche(h + self.counts().astype(U64) * U64(BASES[3]))

    def spans(self, words: np.ndarray, first: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
        """Hashes of the words from each ``first`` up to each ``end``."""
        up, down = powers(BASES[seed] ^ 0x5555555555555554, len(words) + 1)
        sums = np.zeros(len(words) + 1, dtype=U64)
        np.cumsum(words * up[: len(words)], out=sums[1:])
        return avalanche((sums[end] - sums[first]) * down[first] + (end - first).astype(U64) * U64(BASES[3]))

    def inside(self, k: int) -> np.ndarray:
        """Word positions at which k words of one document start."""
        m = len(self.starts) - k + 1
        if m <= 0:
            return np.zeros(0, dtype=np.int64)
        end = np.repeat(self.word_at[1:], self.counts())[:m]
        at = np.arange(m)
        return at[at + k <= end]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, dtype=np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, name: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with at most ``limit`` bytes of text, or one document."""
    if not batch.num_rows:
        return
    data, at = text_bytes(batch.column(name))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first), data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last
    release()


def chunks(batches: Iterator[pa.RecordBatch], name: str = "text", lower: bool = False) -> Iterator[tuple[pa.RecordBatch, Chunk]]:
    for batch in batches:
        for part, data, at in slices(batch, name):
            yield part, Chunk(data, at, lower)


def release() -> None:
    """Give Arrow's unused memory back, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def hex64(x: np.ndarray) -> list[str]:
    return [format(v, "016x") for v in x.tolist()]
