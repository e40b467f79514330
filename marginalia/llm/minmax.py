"""Near-duplicate detection by min-max hashing, confirmed on full shingle sets.

A document's set holds its distinct shingles of five words (ASCII lower case; a
shorter text is one shingle as a whole). Every permutation of the hash space
yields two signature values, the set's minimum and its maximum: 110 permutations
give the 220 values of 44 bands of five, and each is used once. A band joins minima
and maxima of different permutations, which makes its values independent: two sets of
similarity s share a band with probability s**5, and miss all 44 bands at the
threshold 0.75 seven times in a million.

Equal sets are one class from the start. In every bucket (band value) members
are first compared with its hub only, the one that shares most buckets; links so
found are joined to components, and only members that are still apart are
compared with each other: members of large buckets by an exact join on rare
shingles, and always across components only. So a group of copies costs a few
comparisons a member, and no link between components is lost.
Every link is confirmed on both whole texts.

Null, empty and word-less texts have empty sets, are linked with nothing and kept.
Rows of one doc_id are one document: its texts count as linked. A null id counts
as the smallest id and is given back as null. Repeated rows and ties get equal results.
An empty table gives an empty table. A very long text is worked on by itself, in one
task. Columns beside doc_id and text may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import kernel
from marginalia.llm.shared import NULL_ID, components, settled, small_batches

SHINGLE, PERCENT = 5, 75
BANDS, BAND_VALUES = 44, 5
PERMUTATIONS = BANDS * BAND_VALUES // 2
#: Members of a bucket beyond which pairs are found by rare shingles.
LARGE_BUCKET = 8
#: Counters of shingle frequencies.
COUNTERS = 1 << 18
_random = np.random.default_rng(20240229)
_MULTIPLY = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * kernel.U64(2) + kernel.U64(1)
_ADD = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_MIX = _random.integers(0, 1 << 63, BAND_VALUES, dtype=np.uint64) * kernel.U64(2) + kernel.U64(1)


def shingles(chunk: kernel.Chunk, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each document in ascending order, and where each document's begin."""
    words = chunk.words()
    counts = chunk.counts()
    at = chunk.inside(k)
    doc = chunk.doc_of_word()[at] if len(at) else np.zeros(0, dtype=np.int64)
    grams = chunk.grams(words, k)[at] if len(at) else np.zeros(0, dtype=np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        doc = np.concatenate([doc, short])
        grams = np.concatenate([grams, chunk.whole(words)[short]])
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    doc, grams = doc[new], grams[new]
    return grams, np.searchsorted(doc, np.arange(chunk.n + 1))


def band_values() -> list[list[tuple[int, int]]]:
    """(0 for a minimum or 1 for a maximum, permutation) of each value of each band: three of one and two of the other in turn, each value once.

    Maxima run half of all permutations ahead of minima, so no band has both of one permutation."""
    out, low, high = [], 0, PERMUTATIONS // 2
    for band in range(BANDS):
        n = BAND_VALUES // 2 + band % 2
        out.append([(0, (low + i) % PERMUTATIONS) for i in range(n)] + [(1, (high + i) % PERMUTATIONS) for i in range(BAND_VALUES - n)])
        low, high = low + n, high + BAND_VALUES - n
    return out


def bands(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Band values of sets that are not empty: one row a set."""
    n = len(first)
    values = np.empty((2, PERMUTATIONS, n), dtype=np.uint64)
    for p in range(PERMUTATIONS):
        hashed = (grams + _ADD[p]) * _MULTIPLY[p]
        hashed ^= hashed >> kernel.U64(29)
        np.minimum.reduceat(hashed, first, out=values[0, p])
        np.maximum.reduceat(hashed, first, out=values[1, p])
    out = np.zeros((BANDS, n), dtype=np.uint64)
    for b, chosen in enumerate(band_values()):
        total = np.full(n, b + 1, dtype=np.uint64)
        for mix, (side, p) in zip(_MIX, chosen, strict=True):
            total = kernel.avalanche(total * mix + values[side, p])
        out[b] = total
    return out.T


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands) of every row; equal sets have equal set_a and set_b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in kernel.slices(batch, limit=1 << 20):
                grams, first = shingles(kernel.Chunk(data, at, lower=True))
                sizes = np.diff(first)
                full = sizes > 0
                values = np.zeros((0, BANDS), dtype=np.uint64)
                a = b = np.zeros(len(sizes), dtype=np.uint64)
                if full.any():
                    values = bands(grams, first[:-1][full])
                    a, b = a.copy(), b.copy()
                    a[full] = np.add.reduceat(grams, first[:-1][full])
                    b[full] = np.add.reduceat(kernel.avalanche(grams ^ kernel.U64(kernel.BASES[2])), first[:-1][full])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * BANDS)]), pa.int32()), pa.array(kernel.signed(np.ascontiguousarray(values).ravel())))
                yield pa.record_batch([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(kernel.signed(a)), pa.array(kernel.signed(b)), lists], names=["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold; ``texts`` is (doc_id, text)."""
    left = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = left.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for whole, _, _ in kernel.slices(batch, "text_a"):
                for part, data, at in kernel.slices(whole, "text_b"):
                    one, first = shingles(kernel.Chunk(data, at, lower=True))
                    two, second = shingles(kernel.Chunk(*kernel.text_bytes(part.column("text_a")), lower=True))
                    sizes = np.diff(first) + np.diff(second)
                    row = np.concatenate([np.repeat(np.arange(part.num_rows), np.diff(first)), np.repeat(np.arange(part.num_rows), np.diff(second))])
                    grams = np.concatenate([one, two])
                    order = np.lexsort((grams, row))
                    row, grams = row[order], grams[order]
                    same = (row[1:] == row[:-1]) & (grams[1:] == grams[:-1])
                    shared = np.bincount(row[1:][same], minlength=part.num_rows)
                    keep = (shared > 0) & (100 * shared >= PERCENT * (sizes - shared))
                    yield pa.record_batch([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long")


def sizes_allow(a: str, b: str) -> F.Column:
    """Whether sets of these sizes can reach the threshold."""
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * PERCENT)


def cross_pairs(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of bucket members in different components: members is (bucket, node, n, m, comp), m the bucket's size.

    Members of small buckets are paired. A crowd of texts that are alike but not
    alike enough would make too many pairs in large ones, so their members are
    joined exactly by prefixes: ordered from the rarest shingle to the most
    frequent, two sets at the threshold share one of the first
    n - ceil(0.75 n) + 1. Frequencies come from counters of a fixed number; any
    order finds all pairs, a better one fewer others."""
    apart = members.groupBy("bucket").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("bucket")
    mixed = members.join(apart, "bucket")
    crowd = mixed.where(F.col("m") > LARGE_BUCKET).select(F.col("node").alias("doc_id"), "n", "comp").distinct()
    crowd = settled(texts.join(crowd, "doc_id"))
    rare = rare_shingles(crowd, shingle_counters(crowd))
    rare = rare.select("node", "n", "comp", F.posexplode("prefix").alias("pos", "bucket"))
    shared = rare.groupBy("bucket").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("bucket")
    rows = mixed.where(F.col("m") <= LARGE_BUCKET).select("node", "n", "comp", F.lit(0).alias("pos"), "bucket").unionByName(rare.join(shared, "bucket"))
    other = rows.select("bucket", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("comp").alias("comp_a"), F.col("pos").alias("pos_a"))
    # at the first shingle that two sets share, no more than what follows in either can be shared
    most = F.least(F.col("n") - F.col("pos"), F.col("n_a") - F.col("pos_a"))
    room = most * (100 + PERCENT) >= (F.col("n") + F.col("n_a")) * PERCENT
    met = rows.join(other, "bucket").where((F.col("a") < F.col("node")) & (F.col("comp") != F.col("comp_a")) & sizes_allow("n", "n_a") & room)
    return met.select("a", F.col("node").alias("b")).distinct()


def shingle_counters(texts: DataFrame) -> np.ndarray:
    """How many sets have a shingle that falls to each of ``COUNTERS`` counters."""
    step = COUNTERS // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(COUNTERS, dtype=np.int64)
        for _, chunk in kernel.chunks(batches, lower=True):
            sums += np.bincount((shingles(chunk)[0] & kernel.U64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        if sums.any():
            yield pa.record_batch([pa.array(range(64), pa.int32()), pa.array([sums[i * step : (i + 1) * step].tobytes() for i in range(64)], pa.binary())], names=["part", "sums"])

    def total(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(b, dtype=np.int64) for b in table.column("sums").to_pylist())
        return pa.table({"part": table.column("part")[:1], "sums": pa.array([sums.tobytes()], pa.binary())})

    rows = texts.select("text").mapInArrow(run, "part int, sums binary").groupBy("part").applyInArrow(total, "part int, sums binary").collect()
    out = np.zeros(COUNTERS, dtype=np.int64)
    for part, sums in rows:
        out[part * step : (part + 1) * step] = np.frombuffer(sums, dtype=np.int64)
    return out


def rare_shingles(crowd: DataFrame, counters: np.ndarray) -> DataFrame:
    """(node, n, comp, prefix) of rows (doc_id, text, n, comp): each set's rarest shingles."""
    sent = crowd.sparkSession.sparkContext.broadcast(counters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, chunk in kernel.chunks(batches, lower=True):
            grams, first = shingles(chunk)
            sizes = np.diff(first)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((grams, sent.value[(grams & kernel.U64(COUNTERS - 1)).astype(np.int64)], doc))
            keep = sizes - -(-PERCENT * sizes // 100) + 1
            place = np.arange(len(grams)) - first[doc]
            taken = grams[order][place < keep[doc]]
            edges = np.concatenate([[0], np.cumsum(np.minimum(keep, sizes))])
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(kernel.signed(taken)))
            yield pa.record_batch([part.column("doc_id"), part.column("n"), part.column("comp"), lists], names=["node", "n", "comp", "prefix"])

    return crowd.select("doc_id", "text", "n", "comp").mapInArrow(run, "node long, n long, comp long, prefix array<long>")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text)."""
    small_batches(docs)
    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = settled(signatures(rows))
    classes = signed.where("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    classes = settled(classes)
    banded = classes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("m"), F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("bucket", "m")
    members = settled(banded.join(shared, "bucket").select("bucket", "node", "n", "m"))
    texts = settled(rows.join(members.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    # a hub shares more buckets, and larger ones, than the copies made from it
    fame = members.groupBy("node").agg(F.sum("m").alias("fame"))
    known = members.join(fame, "node")
    hubs = known.groupBy("bucket").agg(F.max(F.struct("fame", (-F.col("node")).alias("order"), F.col("node").alias("hub"), F.col("n").alias("hub_n"))).alias("h"))
    stars = members.join(hubs.select("bucket", "h.fame", "h.hub", "h.hub_n"), "bucket").where((F.col("hub") != F.col("node")) & sizes_allow("n", "hub_n"))
    stars = settled(stars.groupBy("hub", "node").agg(F.first("fame").alias("fame")))
    # first the greatest hub of each member, then other hubs of what is still apart, then members among themselves
    tried = stars.groupBy("node").agg(F.max(F.struct("fame", "hub")).alias("h")).select("node", F.col("h.hub").alias("tried"))
    links = settled(confirmed(tried.select(F.col("tried").alias("a"), F.col("node").alias("b")), texts))
    labels = components(links)
    label = lambda df, c: df.join(labels.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}")), c, "left").withColumn(f"comp_{c}", F.coalesce(f"comp_{c}", c))
    rest = label(label(stars.select("hub", "node"), "node"), "hub").where("comp_node <> comp_hub").join(tried, "node").where("hub <> tried")
    links = settled(links.unionByName(confirmed(rest.select(F.col("hub").alias("a"), F.col("node").alias("b")), texts)))
    labels = components(links)
    placed = label(members, "node").withColumnRenamed("comp_node", "comp")
    done = stars.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
    more = cross_pairs(placed, texts).join(done, ["a", "b"], "left_anti")
    links = links.unionByName(confirmed(more, texts))
    # documents of one id but different sets are one node already
    labels = components(links)
    found = classes.select("set_a", "set_b", "n_shingles", "node").join(labels, "node", "left").select("set_a", "set_b", "n_shingles", F.coalesce("comp", "node").alias("component_id"))
    out = signed.join(found, ["set_a", "set_b", "n_shingles"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(back("doc_id").alias("doc_id"), "n_shingles", back("component_id").alias("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their component; of repeated rows with that id all stay."""
    kept = near_duplicates(docs).where("kept").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id")).distinct()
    rows = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.struct("*").alias("row"))
    return rows.join(kept, "id", "left_semi").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op9_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
