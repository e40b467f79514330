"""Columns with the names that operators use inside, very long texts and empty tables."""

from collections import Counter

import pytest
from test_llm import prose

import corpus_pipeline
from marginalia.llm import bpe, cws, ecoc, hilbert, line_quality, minmax, packing, pii, pitman_yor, suffix_dedup
from pyspark.sql import functions as F

CLASH = ("id", "_id", "digest", "_digest", "host", "row", "new", "copy", "bad", "gone", "kept", "node", "comp", "bucket", "shard", "slot", "run", "at", "part", "block", "prefix", "found0", "key", "length", "start", "sequence_id", "offset", "score", "held_out", "shard_", "nth")


@pytest.fixture(scope="module")
def clashing(spark):
    long = prose(1, 30_000)
    some = [(1, prose(2, 80), "en", "s"), (2, prose(2, 80), "en", "s"), (2, prose(2, 80), "en", "s"), (None, None, None, None), (4, "", "de", "t"), (5, long, "fr", "t"), (6, prose(3, 60) + " " + long, None, "t")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in some], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH}).checkpoint()


def own(df):
    return all(r[c] == f"own {c}" for r in df.collect() for c in CLASH)


def test_digests(clashing):
    n = clashing.count()
    held = F.lit(False)
    for out in (bpe.digest_documents(clashing), cws.edited_likeness(clashing), suffix_dedup.digest(clashing), hilbert.shard_documents(clashing), pii.find_spans(clashing), line_quality.judge(clashing), pitman_yor.score_documents(clashing, held), minmax.near_duplicates(clashing), ecoc.predict(clashing, ecoc.fit(clashing))):
        assert out.count() == n
    pieces = packing.pack_documents(clashing).collect()
    assert {r.doc_id for r in pieces} == {1, 2, 4, 5, 6, None}
    assert cws.fingerprints(clashing).count() == 6


def test_whole_rows(clashing):
    for kept in (suffix_dedup.remove_repeats(clashing), minmax.keep_first(clashing), line_quality.remove_lines(clashing), line_quality.keep_good(clashing), pii.mask_documents(clashing)):
        assert kept.columns == clashing.columns and own(kept)
    left = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(clashing).collect()}
    assert left[6].strip() == prose(3, 60) and 2 not in left and left[None] is None


def test_written_shards(spark, clashing, tmp_path):
    hilbert.write_shards(clashing, hilbert.shard_documents(clashing, 2), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert own(back) and Counter(r.doc_id for r in back.collect()) == Counter(r.doc_id for r in clashing.collect()) and {"shard__", "slot_"} <= set(back.columns)


def test_pipeline(spark, clashing):
    for docs in (clashing, clashing.limit(0)):
        kept = docs
        for name, stage in corpus_pipeline.STAGES:
            columns = kept.columns
            kept = stage(spark, kept, "").checkpoint()
            assert name == "packing" or kept.columns == columns and own(kept)
        assert (kept.count() > 0) == (docs is clashing)
