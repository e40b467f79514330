"""Shards as they are written."""

from collections import Counter

from test_llm import docs, prose, rows  # noqa: F401

from marginalia.llm import hilbert


def test_write_shards(spark, docs, tmp_path):  # noqa: F811
    more = [(None, None, "en", "s0"), (None, None, "en", "s0"), (None, "x", "de", "s1"), (7, "other", "en", "s9"), (7, None, "en", "s9"), (8, "", None, None), (8, None, None, None)]
    some = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string"))
    sharded = hilbert.shard_documents(some, 3)
    hilbert.write_shards(some, sharded, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(tuple(r) for r in back.select(*some.columns).collect()) == Counter(tuple(r) for r in some.collect())
    place = lambda r: (r.doc_id, r.shard, r.slot)
    assert Counter(map(place, back.collect())) == Counter(map(place, sharded.collect()))


def test_equal_texts_stay_together(spark):
    """Copies with other languages, hosts and null ids lie in two shards at most, unless they fill more than one."""
    out = [(i, prose(i, 20 + i % 90), "en" if i % 3 else "fr", f"s{i % 7}") for i in range(600)]
    out += [(1000 + 10 * i + k, prose(10_000 + i, 30), ("en", "de", None)[k % 3], f"s{(i + k) % 7}") for i in range(12) for k in range(8)] + [(None, "twice", "en", "a"), (None, "twice", "fr", "b"), (5, "twice", None, None)]
    out += [(5000 + i, "hot", "en", f"s{i % 7}") for i in range(300)]
    df = spark.createDataFrame(out, "doc_id long, text string, lang string, source string").repartition(4)
    got = hilbert.shard_documents(df, 16).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(out) and max(sizes.values()) - min(sizes.values()) <= 1
    by_text = {}
    for r in got:
        by_text.setdefault((r.text_crc32, r.size), []).append(r)
    groups = [g for g in by_text.values() if 1 < len(g) < 60]
    assert len(groups) == 13 and all(len({r.shard for r in g}) <= 2 and len({r.curve for r in g}) == 1 for g in groups)
    hot = max(by_text.values(), key=len)
    shards = sorted({r.shard for r in hot})
    assert len(hot) == 300 and shards == list(range(shards[0], shards[-1] + 1)) and len(shards) <= 300 // min(sizes.values()) + 3
