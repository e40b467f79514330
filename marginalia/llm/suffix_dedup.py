"""Substring deduplication by prefix-partitioned suffix trees.

A passage is a window of 50 consecutive words; in every document but those with
the smallest id that has it, its words are removed. The suffixes of all texts that
start a window form a tree, whose nodes at depth 50 and more with leaves in several
documents are the repeated passages. The tree is never built whole:

* Suffixes are told apart by the word at which their window is marked: of the 20-word
  prefixes of suffixes inside a window the one with the smallest hash marks it, so
  equal windows are marked by equal prefixes. A prefix that occurs in one document
  only roots no repeat and is dropped after one distributed count.
* Prefixes shared by documents split the rest into groups. Stretches of windows that
  are equal as a whole are one before anything is grouped, their smallest document's;
  the others' are repeats by that. The suffixes of a group of at most ``GROUP_BYTES``
  are sorted by their words in one task's memory, by doubling ranks; the common prefix
  of neighbours gives the subtree's internal nodes with their depth, and those of
  depth 50 or more are the repeats.
* A larger group gets longer prefixes, 35 words and then the whole window. A prefix
  grows to the right in windows with room for it there, in all others to the left,
  so equal windows still meet. A whole window is a deep node by itself, whose
  smallest document is an aggregate and which no task holds together.

Equal word sequences are one document beforehand. Words are told apart by 64-bit
hashes, whole windows as prefixes by 128 bits.

Null and empty texts have no words and nothing to remove; an empty table gives an
empty table. Equal ids are one document: rows with the same id remove nothing from
each other. A null id counts as the smallest. Repeated rows get equal results. A very
long text is worked on by itself, in one task. Further columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm import kernel
from marginalia.llm.shared import NULL_ID, settled, small_batches

WINDOW = 50
#: Words of a prefix, before it grows to the whole window; each length has room to grow to one side of any window.
LENGTHS = (20, 35)
#: Text of the suffixes of one prefix that are sorted in one task; more get longer prefixes.
GROUP_BYTES = 1 << 18
#: Text of groups that are sorted together.
TREE_BYTES = 1 << 20


def windows(chunk: kernel.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, prefix hashes, the word positions where windows start, and the position of each window's marking prefix."""
    words = chunk.words()
    prefixes = chunk.grams(words, LENGTHS[0])
    at = chunk.inside(WINDOW)
    least, place = prefixes, np.arange(len(prefixes))
    width, wanted = 1, WINDOW - LENGTHS[0] + 1
    while width < wanted and len(at):
        step = min(width, wanted - width)
        n = len(least) - step
        right = least[step:] < least[:n]
        least, place = np.where(right, least[step:], least[:n]), np.where(right, place[step:], place[:n])
        width += step
    return words, prefixes, at, place[at] if len(at) else at


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of equal values."""
    if not len(values):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    edge = np.flatnonzero(values[1:] != values[:-1])
    return np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(values) - 1]])


class Places:
    """Where prefixes mark windows: the prefix, its document, its first word, and its first and last window."""

    def __init__(self, chunk: kernel.Chunk):
        self.chunk = chunk
        self.words, prefixes, at, marks = windows(chunk)
        first, last = runs(marks)
        self.core = marks[first]
        self.prefix = kernel.signed(prefixes[self.core])
        self.doc = np.searchsorted(chunk.word_at, self.core, side="right") - 1
        self.first, self.last = at[first], at[last]

    def keep(self, which: np.ndarray) -> None:
        for name in ("core", "prefix", "doc", "first", "last"):
            setattr(self, name, getattr(self, name)[which])

    def stretch(self) -> np.ndarray:
        """A hash of the words that a place's windows cover."""
        return kernel.signed(self.chunk.spans(self.words, self.first, self.last + WINDOW))

    def bytes(self) -> np.ndarray:
        """The size of the text that a place's windows cover."""
        return self.chunk.ends[self.last + WINDOW - 1] - self.chunk.starts[self.first] if len(self.first) else self.first

    def grow(self, old: int, new: int) -> None:
        """Longer prefixes: windows with room to the right of the old one take the words there, the others those to the left."""
        cut = self.core + new - WINDOW
        right, left = np.maximum(self.first, cut), np.minimum(self.last, cut - 1)
        core = np.concatenate([self.core, self.core - (new - old)])
        doc, first, last = np.tile(self.doc, 2), np.concatenate([right, self.first]), np.concatenate([self.last, left])
        some = np.flatnonzero(first <= last)
        self.core, self.doc, self.first, self.last = core[some], doc[some], first[some], last[some]
        self.prefix = kernel.signed(self.chunk.grams(self.words, new)[self.core])

    def at_level(self, part: pa.RecordBatch, level: int, state: int) -> None:
        """The places that the documents' lists (found0, found1, ...) name: large at the lengths before, in this state at this one."""
        for i in range(level + 1):
            if i:
                self.grow(LENGTHS[i - 1], LENGTHS[i])
            found = part.column(f"found{i}")
            lists = found.flatten()
            owner = np.repeat(np.arange(len(found)), pc.fill_null(pc.list_value_length(found), 0).to_numpy())
            prefix, stretch, kind = (lists.field(c).to_numpy(zero_copy_only=False) for c in ("prefix", "stretch", "state"))
            wanted = kind == (state if i == level else LARGE)
            self.keep(np.isin(keys_of(self.prefix, self.stretch(), self.doc), keys_of(prefix[wanted], stretch[wanted], owner[wanted])))


def keys_of(prefix: np.ndarray, stretch: np.ndarray, doc: np.ndarray) -> np.ndarray:
    a, b = (x.astype(np.int64).view(np.uint64) for x in (prefix, stretch))
    return kernel.avalanche(a + kernel.avalanche(b + doc.astype(np.uint64) * kernel.U64(kernel.BASES[2])))


def stretches(places: Places, n: int) -> pa.ListArray:
    """The distinct (prefix, stretch) of each of n documents with the stretch's size, as lists."""
    stretch = places.stretch()
    order = np.lexsort((stretch, places.prefix, places.doc))
    doc, prefix, stretch, size = places.doc[order], places.prefix[order], stretch[order], places.bytes()[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (prefix[1:] != prefix[:-1]) | (stretch[1:] != stretch[:-1])
    entries = pa.StructArray.from_arrays([pa.array(prefix[new], pa.int64()), pa.array(stretch[new], pa.int64()), pa.array(np.minimum(size[new], (1 << 31) - 1), pa.int32())], names=["prefix", "stretch", "size"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[new], np.arange(n + 1)), pa.int32()), entries)


PREFIXES = "array<struct<prefix:long,stretch:long,size:int>>"
#: What a list says of a place: a smaller document has the whole stretch, or its group is small or large.
WHOLE, SMALL, LARGE = 0, 1, 2


def profile(rows: DataFrame) -> DataFrame:
    """(doc_id, digest, n_words, seq_a, seq_b, sha256, prefixes) of every row: hashes of the word sequence, and the prefixes that mark windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "digest", "n_words", "seq_a", "seq_b", "sha256", "prefixes"]
        for batch in batches:
            for part, chunk in kernel.chunks(iter([batch])):
                places = Places(chunk)
                lists = stretches(places, chunk.n)
                raw = chunk.data.tobytes()
                digests = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist(), strict=True)]
                seq = [pa.array(kernel.signed(chunk.whole(places.words, s))) for s in (1, 2)]
                kernel.release()
                yield pa.record_batch([part.column("doc_id"), part.column("digest"), pa.array(chunk.counts(), pa.int64()), *seq, pa.array(digests, pa.string()), lists], names=names)

    return rows.select("doc_id", "digest", "text").mapInArrow(run, f"doc_id long, digest long, n_words long, seq_a long, seq_b long, sha256 string, prefixes {PREFIXES}")


def longer_prefixes(texts: DataFrame, level: int) -> DataFrame:
    """(doc_id, prefixes) of texts under large groups of the level before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, chunk in kernel.chunks(batches):
            places = Places(chunk)
            places.at_level(part, level - 1, LARGE)
            places.grow(LENGTHS[level - 1], LENGTHS[level])
            yield pa.record_batch([part.column("doc_id"), stretches(places, chunk.n)], names=["doc_id", "prefixes"])
            kernel.release()

    return texts.select("doc_id", "text", *[f"found{i}" for i in range(level)]).mapInArrow(run, f"doc_id long, prefixes {PREFIXES}")


def shared_prefixes(prefixes: DataFrame, name: str, sources: bool) -> DataFrame:
    """(doc_id, name): what each document's places are under prefixes that other documents have too.

    With ``sources`` the stretches of different documents are different, so that every window is looked up in a tree."""
    every = prefixes.select("doc_id", F.explode("prefixes").alias("p")).select("doc_id", "p.prefix", "p.stretch", "p.size")
    # most prefixes are one document's: they go before anything is kept of their stretches
    shared = every.groupBy("prefix").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("prefix")
    each = settled(every.join(shared, "prefix").withColumn("key", F.xxhash64("doc_id", "stretch") if sources else F.col("stretch")))
    known = each.groupBy("prefix", "key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.max("size").cast("long").alias("size"))
    groups = known.groupBy("prefix").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    group = F.when(F.col("bytes") > GROUP_BYTES, LARGE).otherwise(SMALL)
    kinds = known.join(groups, "prefix").where("n > 1 OR a < b").select("prefix", "key", "a", F.when(F.col("n") > 1, group).alias("group"))
    state = F.when(F.col("doc_id") > F.col("a"), WHOLE).otherwise(F.col("group"))
    found = each.join(kinds, ["prefix", "key"]).select("doc_id", "prefix", "stretch", state.alias("state")).where("state IS NOT NULL")
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("prefix", "stretch", "state")).alias(name))


def whole_stretches(texts: DataFrame, level: int) -> DataFrame:
    """The windows of stretches that a smaller document has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, chunk in kernel.chunks(batches):
            places = Places(chunk)
            places.at_level(part, level, WHOLE)
            start, row = starts_of(places)
            if len(start):
                first, _ = runs(row)
                owner = row[first]
                offsets = pa.array(np.concatenate([first, [len(row)]]), pa.int32())
                seq = kernel.signed(chunk.whole(places.words))[owner]
                yield pa.record_batch([part.column("doc_id").take(pa.array(owner)), pa.array(seq), pa.ListArray.from_arrays(offsets, pa.array(start - chunk.word_at[row], pa.int32())), pa.nulls(len(first), pa.list_(pa.int64())), pa.nulls(len(first), pa.list_(pa.int32()))], names=[x.split()[0] for x in LEAVES.split(", ")])
            kernel.release()

    some = texts.where(F.exists(f"found{level}", lambda x: x["state"] == WHOLE))
    return some.select("doc_id", "text", *[f"found{i}" for i in range(level + 1)]).mapInArrow(run, LEAVES)


def starts_of(places: Places) -> tuple[np.ndarray, np.ndarray]:
    """The first words of all windows of the places, in order, and their documents."""
    n = places.last - places.first + 1
    start = np.unique(np.repeat(places.first - (np.cumsum(n) - n), n) + np.arange(n.sum()))
    return start, np.searchsorted(places.chunk.word_at, start, side="right") - 1


def slices_of(texts: DataFrame, level: int) -> DataFrame:
    """Suffixes under prefixes of small groups, one row for all windows that a prefix marks at one place.

    (prefix, doc_id, seq_a, at, words): the windows start at word ``at`` of the
    text and are all those of 50 words inside ``words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, chunk in kernel.chunks(batches):
            places = Places(chunk)
            places.at_level(part, level, SMALL)
            doc, first = places.doc, places.first
            if len(doc):
                raw = chunk.data.tobytes()
                pieces = [b" ".join(raw[a:b].split()).decode("utf-8", "replace") for a, b in zip(chunk.starts[first].tolist(), chunk.ends[places.last + WINDOW - 1].tolist(), strict=True)]
                seq = kernel.signed(chunk.whole(places.words))[doc]
                yield pa.record_batch([pa.array(places.prefix), part.column("doc_id").take(pa.array(doc)), pa.array(seq), pa.array(first - chunk.word_at[doc], pa.int32()), pa.array(pieces, pa.string())], names=["prefix", "doc_id", "seq_a", "at", "words"])
            kernel.release()

    some = texts.where(F.exists(f"found{level}", lambda x: x["state"] == SMALL))
    return some.select("doc_id", "text", *[f"found{i}" for i in range(level + 1)]).mapInArrow(run, "prefix long, doc_id long, seq_a long, at int, words string")


def suffix_order(words: np.ndarray, end: np.ndarray, longest: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of all suffixes by their words, up to their text's ``end`` or 2**k >= longest words, and ranks of their first 1, 2, 4, ... words."""
    _, rank = np.unique(words, return_inverse=True)
    ranks, width = [rank + 1], 1
    while width < longest:
        last, at = ranks[-1], np.arange(len(words)) + width
        after = np.where(at < end, last[np.minimum(at, len(words) - 1)], 0)
        _, rank = np.unique(last * (int(last.max()) + 1) + after, return_inverse=True)
        ranks.append(rank + 1)
        width *= 2
    return np.argsort(ranks[-1], kind="stable"), ranks


def common_prefixes(order: np.ndarray, end: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """How many words each suffix but the last shares with the next one in order."""
    a, b = order[:-1].copy(), order[1:].copy()
    depth = np.zeros(len(a), dtype=np.int64)
    for k in reversed(range(len(ranks))):
        inside = (a < end[order[:-1]]) & (b < end[order[1:]])
        same = inside & (ranks[k][np.minimum(a, len(end) - 1)] == ranks[k][np.minimum(b, len(end) - 1)])
        # ranks of suffixes that end early are equal for equal rests of equal lengths
        step = np.where(same, np.minimum(1 << k, end[order[:-1]] - a), 0)
        a, b, depth = a + step, b + step, depth + step
    return depth


def deep_nodes(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word, and the row and first word of the smallest document's leaf of each leaf below a node of depth 50 or more whose document is not the smallest there."""
    data, offsets = kernel.text_bytes(part.column("words").combine_chunks())
    chunk = kernel.Chunk(data, offsets)
    nothing = np.zeros(0, dtype=np.int64)
    if not len(chunk.starts):
        return nothing, nothing, nothing, nothing
    end = np.repeat(chunk.word_at[1:], chunk.counts())
    order, ranks = suffix_order(chunk.words(), end, WINDOW)
    deep = common_prefixes(order, end, ranks) >= WINDOW
    # a node's leaves are neighbours that share 50 words
    node = np.concatenate([[0], np.cumsum(~deep)])
    inner = np.zeros(len(order), dtype=bool)
    inner[1:] |= deep
    inner[:-1] |= deep
    leaf, node = order[inner], node[inner]
    row = np.searchsorted(chunk.word_at, leaf, side="right") - 1
    start = part.column("at").to_numpy()[row] + leaf - chunk.word_at[row]
    doc = part.column("doc_id").to_numpy()[row]
    by = np.lexsort((start, doc, node))
    node, doc, row, start = node[by], doc[by], row[by], start[by]
    first, _ = runs(node)
    head = first[np.searchsorted(first, np.arange(len(node)), side="right") - 1] if len(first) else nothing
    later = doc > doc[head]
    return row[later], start[later], row[head[later]], start[head[later]]


LEAVES = "doc_id long, seq_a long, starts array<int>, first array<long>, there array<int>"


def leaves_of(part: pa.Table, sources: bool) -> Iterator[pa.RecordBatch]:
    row, start, head, there = deep_nodes(part)
    by = np.lexsort((start, row))
    row, start, head, there = row[by], start[by], head[by], there[by]
    first, _ = runs(row)
    if len(first):
        owner = pa.array(row[first])
        offsets = pa.array(np.concatenate([first, [len(row)]]), pa.int32())
        doc = part.column("doc_id").combine_chunks()
        lists = [pa.ListArray.from_arrays(offsets, pa.array(start, pa.int32()))]
        if sources:
            lists += [pa.ListArray.from_arrays(offsets, doc.take(pa.array(head))), pa.ListArray.from_arrays(offsets, pa.array(there, pa.int32()))]
        else:
            lists += [pa.nulls(len(first), pa.list_(pa.int64())), pa.nulls(len(first), pa.list_(pa.int32()))]
        yield pa.record_batch([doc.take(owner), part.column("seq_a").combine_chunks().take(owner), *lists], names=[x.split()[0] for x in LEAVES.split(", ")])


def subtrees(slices: DataFrame, sources: bool) -> DataFrame:
    """The repeated windows in groups that fit into memory, and where the smallest document has them if ``sources``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += batch.nbytes
            if size >= TREE_BYTES:
                table = pa.concat_tables(held)
                first, _ = runs(table.column("prefix").to_numpy())
                # the last group may go on in the next batch
                yield from grouped(table.slice(0, int(first[-1])))
                held = [table.slice(int(first[-1]))]
                size = held[0].nbytes
        if held:
            yield from grouped(pa.concat_tables(held))

    def grouped(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ends = runs(table.column("prefix").to_numpy())[1] + 1
        first, step = 0, 4096
        while first < len(table):
            last = int(ends[min(np.searchsorted(ends, first + step), len(ends) - 1)])
            yield from leaves_of(table.slice(first, last - first), sources)
            first = last

    return slices.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(run, LEAVES)


def whole_windows(texts: DataFrame, sources: bool) -> DataFrame:
    """The same of groups that are large under the longest prefixes: each window is a node, whose smallest document is an aggregate.

    The nodes are settled, so that the join can split what one of them meets."""
    level = len(LENGTHS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, chunk in kernel.chunks(batches):
            places = Places(chunk)
            places.at_level(part, level, LARGE)
            if len(places.doc):
                start, row = starts_of(places)
                keys = [pa.array(kernel.signed(chunk.grams(places.words, WINDOW, s)[start])) for s in (1, 2)]
                seq = kernel.signed(chunk.whole(places.words))[row]
                yield pa.record_batch([*keys, part.column("doc_id").take(pa.array(row)), pa.array(seq), pa.array(start - chunk.word_at[row], pa.int32())], names=["one", "two", "doc_id", "seq_a", "start"])
            kernel.release()

    some = texts.where(F.exists(f"found{level}", lambda x: x["state"] == LARGE))
    leaves = settled(some.select("doc_id", "text", *[f"found{i}" for i in range(level + 1)]).mapInArrow(run, "one long, two long, doc_id long, seq_a long, start int"))
    nodes = leaves.groupBy("one", "two").agg(F.min(F.struct("doc_id", "start")).alias("least"), F.max("doc_id").alias("largest")).where("least.doc_id < largest")
    nodes = settled(nodes.select("one", "two", F.col("least.doc_id").alias("first"), F.col("least.start").alias("there")))
    later = leaves.join(nodes, ["one", "two"]).where("doc_id > first")
    each = F.sort_array(F.collect_list(F.struct("start", "first", "there") if sources else F.struct("start")))
    found = later.groupBy("doc_id", "seq_a").agg(each.alias("x"))
    none = lambda kind: F.lit(None).cast(f"array<{kind}>")
    return found.select("doc_id", "seq_a", F.col("x.start").alias("starts"), (F.col("x.first") if sources else none("long")).alias("first"), (F.col("x.there") if sources else none("int")).alias("there"))


def text_digest(name: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(name).cast("string"), F.lit("")))


def repeats(docs: DataFrame, sources: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What to remove from ``docs`` (doc_id, text).

    Returns the profile of every row with ``whole`` (its word sequence is that of a
    smaller document, ``first``); the texts under repeated prefixes; and the repeated
    windows (LEAVES) of their word sequences. A null doc_id is NULL_ID."""
    small_batches(docs)
    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("digest", text_digest("text"))
    profiled = settled(profile(rows))
    sequences = profiled.where(F.col("n_words") >= WINDOW).groupBy("seq_a", "seq_b").agg(F.min("doc_id").alias("doc_id"), F.first("prefixes").alias("prefixes"))
    sequences = settled(sequences)
    texts = settled(rows.join(shared_prefixes(sequences, "found0", sources), "doc_id"))
    leaves, here = subtrees(slices_of(texts, 0), sources).unionByName(whole_stretches(texts, 0)), texts
    for level in range(1, len(LENGTHS)):
        hot = here.where(F.exists(f"found{level - 1}", lambda x: x["state"] == LARGE))
        here = settled(hot.join(shared_prefixes(longer_prefixes(hot, level), f"found{level}", sources), "doc_id"))
        leaves = leaves.unionByName(subtrees(slices_of(here, level), sources)).unionByName(whole_stretches(here, level))
    leaves = leaves.unionByName(whole_windows(here, sources))
    firsts = sequences.select("seq_a", "seq_b", F.col("doc_id").alias("first"))
    whole = profiled.drop("prefixes").join(firsts, ["seq_a", "seq_b"], "left").withColumn("whole", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    return whole, texts.select("doc_id", "digest", "text"), leaves


def maximal_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, start, n_words, first, there): passages of 50 words or more that a document shares with a smaller one.

    ``first`` is the smallest document with the passage's windows, ``start`` and ``there`` are where its words begin in both; neither end can be moved out. Null ids are null."""
    whole, _, leaves = repeats(docs, sources=True)
    each = leaves.select("doc_id", "seq_a", F.explode(F.arrays_zip("starts", "first", "there")).alias("x")).select("doc_id", "seq_a", F.col("x.starts").alias("start"), "x.first", "x.there").distinct()
    # windows that go on together lie on one diagonal, one after the other
    along = Window.partitionBy("doc_id", "seq_a", "first", "off").orderBy("start")
    each = each.withColumn("off", F.col("start") - F.col("there"))
    each = each.withColumn("run", F.col("start") - F.row_number().over(along))
    found = each.groupBy("doc_id", "seq_a", "first", "off", "run").agg(F.min("start").alias("start"), F.min("there").alias("there"), (F.count("*") + WINDOW - 1).cast("long").alias("n_words"))
    rows = whole.where("not whole").select("doc_id", "seq_a").distinct().join(found, ["doc_id", "seq_a"])
    copies = whole.where("whole").select("doc_id", F.lit(0).alias("start"), "n_words", "first", F.lit(0).alias("there"))
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    columns = ["doc_id", "start", "n_words", "first", "there"]
    return rows.select(*columns).unionByName(copies.select(*columns)).select(back("doc_id"), "start", "n_words", back("first"), "there").distinct()


def covered(starts: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of the positions."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + WINDOW, n), -1)
    return np.cumsum(step)[:n] > 0


def without(chunk: kernel.Chunk, i: int, raw: bytes, starts: list[int]) -> tuple[int, bytes, bytes]:
    """Words removed from document i, the words kept joined by spaces, and the text without the removed words.

    In the text, the white space after a removed word goes with it."""
    a, b = int(chunk.word_at[i]), int(chunk.word_at[i + 1])
    gone = covered(np.array(starts, dtype=np.int64), b - a)
    first, last = chunk.starts[a:b], chunk.ends[a:b]
    kept = [raw[x:y] for x, y in zip(first[~gone].tolist(), last[~gone].tolist(), strict=True)]
    out, at = [], int(chunk.offsets[i])
    heads, tails = runs(gone)
    for h, t in zip(heads.tolist(), tails.tolist(), strict=True):
        if gone[h]:
            out.append(raw[at : int(first[h])])
            at = int(first[t + 1]) if t + 1 < b - a else int(last[t])
    out.append(raw[at : int(chunk.offsets[i + 1])])
    return int(gone.sum()), b" ".join(kept), b"".join(out)


def rewritten(texts: DataFrame, leaves: DataFrame) -> DataFrame:
    """(doc_id, digest, seq_a, n_removed, kept_sha256, new_text) of the texts that lose words."""
    starts = leaves.groupBy("doc_id", "seq_a").agg(F.flatten(F.collect_list("starts")).alias("starts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "digest", "seq_a", "n_removed", "kept_sha256", "new_text"]
        for batch in batches:
            for part, chunk in kernel.chunks(iter([batch])):
                seq, raw, rows = kernel.signed(chunk.whole(chunk.words())).tolist(), chunk.data.tobytes(), []
                for i, (doc_id, old, key, at) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc_id", "digest", "seq_a", "starts")), strict=True)):
                    if key == seq[i]:
                        n, kept, text = without(chunk, i, raw, at)
                        rows.append((doc_id, old, key, n, hashlib.sha256(kept).hexdigest(), text.decode("utf-8", "replace")))
                if rows:
                    kinds = [pa.int64()] * 4 + [pa.string()] * 2
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    joined = texts.join(starts, "doc_id").select("doc_id", "digest", "seq_a", "starts", "text")
    return joined.mapInArrow(run, "doc_id long, digest long, seq_a long, n_removed long, kept_sha256 string, new_text string")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    whole, texts, leaves = repeats(docs)
    changed = rewritten(texts, leaves).drop("new_text", "digest").dropDuplicates(["doc_id", "seq_a"])
    out = whole.join(changed, ["doc_id", "seq_a"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"),
        "n_words",
        F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("whole"), nothing).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with repeated passages cut out of ``text``; documents left without a word that had some go.

    ``n_chars`` is set anew where the text has changed."""
    whole, texts, leaves = repeats(docs)
    # rows of one id are told apart by their texts
    new = rewritten(texts, leaves).select("doc_id", "digest", F.col("new_text").alias("new"), F.lit(False).alias("copy"))
    copies = whole.where("whole").select("doc_id", "digest", F.lit(None).cast("string").alias("new"), F.lit(True).alias("copy"))
    changed = new.unionByName(copies).dropDuplicates(["doc_id", "digest"])
    keyed = docs.select(F.coalesce(F.col("doc_id"), F.lit(NULL_ID)).alias("doc_id"), text_digest("text").alias("digest"), F.struct("*").alias("row"))
    out = keyed.join(changed, ["doc_id", "digest"], "left").where(~F.coalesce("copy", F.lit(False)))
    out = out.where(F.col("new").isNull() | F.col("new").rlike(r"[^\x20\x09-\x0D]"))
    own: dict[str, Column] = {c: F.col("row")[c] for c in docs.columns}
    own["text"] = F.coalesce("new", own["text"])
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("new").isNotNull(), F.length("new").cast("long")).otherwise(own["n_chars"])
    return out.select(*[value.alias(c) for c, value in own.items()])


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
