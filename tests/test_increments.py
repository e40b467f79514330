"""The search index, bucketed merges and the dispatch of notices."""

import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from marginalia.operators import catalog, postings
from marginalia.streaming import feeds

WORDS = ["Straße", "élan", "NATION", "nations", "ab", "xyzzy", "action", "réaction", "süße", "a", ""]


def test_index_hits_are_the_scans(spark, tmp_path):
    rows = [(i, " ".join(WORDS[(i * k) % len(WORDS)] for k in (1, 3, 7)), [WORDS[i % 11], WORDS[i % 5]] if i % 9 else None) for i in range(400)] + [(400, None, ["nation"]), (401, "nation", []), (401, "other", ["x"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, tags array<string>")
    postings.build_index(df, "doc_id", ["text", "tags"], str(tmp_path), segment_rows=50)
    for clauses in ([(None, "nation")], [(None, "éLAN AND nation")], [("tags", "xyzzy")], [("text", "STRASSE")], [(None, "ab")], [], [(None, "nothing")], [("text", "süße"), ("tags", "action")], [(None, "x"), ("text", "nation")], [(None, "tion x")]):
        want = {r.doc_id for r in catalog.catalog_search(df, clauses, ["text", "tags"]).select("doc_id").collect()}
        assert {r.doc_id for r in postings.search_index(spark, str(tmp_path), "doc_id", clauses, ["text", "tags"]).collect()} == want, clauses
    found = postings.search_index(spark, str(tmp_path), "doc_id", [(None, "xyzzy")], ["text", "tags"])
    plan = found._jdf.queryExecution().toString()
    # three grams: at most three of the buckets' folders, and the grams reach the files
    buckets = {b for _, b in postings.grams_of(spark, "xyzzy")[1]}
    assert len(buckets) <= 3 and re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*gram", plan)


def test_empty_index(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    postings.build_index(df, "doc_id", ["text"], str(tmp_path))
    assert postings.search_index(spark, str(tmp_path), "doc_id", [(None, "nation")], ["text"]).count() == 0


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "key string, version int, deleted boolean, x string")


def test_merge_rewrites_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    handle = feeds.merge_batches(path, buckets=16)
    table = lambda: {(r.key, r.version, r.x) for r in feeds.read_merged(spark, path, "key string, version int, x string").collect()}
    handle(batch(spark, *((f"k{i}", i + 1, False, "a") for i in range(100))), 0)
    assert len(table()) == 100
    first = feeds.last_manifest(spark, path)[2]
    handle(batch(spark, ("k3", 200, False, "b"), ("k5", 0, True, None), ("new", 201, False, "c"), ("k7", 1, False, "old")), 1)
    want = {(f"k{i}", i + 1, "a") for i in range(100) if i not in (3, 5)} | {("k3", 200, "b"), ("new", 201, "c")}
    assert table() == want
    second = feeds.last_manifest(spark, path)[2]
    changed = {b for b in range(16) if first.get(b) != second.get(b)}
    keys = spark.createDataFrame([(k,) for k in ("k3", "k5", "new", "k7")], "key string").select(feeds.bucket(16).alias("b"))
    assert changed <= {r.b for r in keys.collect()} and 1 <= len(changed) <= 4
    # a repeated batch does nothing; one that fails midway leaves the table
    handle(batch(spark, ("k3", 900, False, "z")), 1)
    assert table() == want
    broken = batch(spark, ("k4", 950, False, "z")).withColumn("x", F.raise_error(F.lit("no")).cast("string"))
    try:
        handle(broken, 2)
        raise AssertionError("the batch should fail")
    except Exception as e:
        assert "no" in str(e)
    assert table() == want and feeds.last_manifest(spark, path)[:2] == (1, 201)
    handle(batch(spark, ("k4", 951, False, "z")), 2)
    assert ("k4", 951, "z") in table() and len(table()) == 100
    # old copies go one batch later
    handle(batch(spark, ("k4", 952, False, "y")), 3)
    four = spark.createDataFrame([("k4",)], "key string").select(feeds.bucket(16).alias("b")).first().b
    left = sorted(int(p.parent.name) for p in (tmp_path / "t" / "rows").glob(f"*/bucket={four}"))
    assert left == [2, 3]


def pulls(notices, names, gap):
    """The same, one notice after another."""
    out = []
    for name in names:
        last = due = None
        for ts in sorted(t for n, t in notices if n in (name, "all")):
            if due is not None and ts >= due:
                out.append((name, due))
                last, due = due, None
            if last is None or ts >= last + gap:
                out.append((name, ts))
                last = ts
            elif ts > last and due is None:
                due = last + gap
        if due is not None:
            out.append((name, due))
    return sorted(out)


def test_dispatch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    at = lambda s: start + timedelta(seconds=s)
    known = spark.createDataFrame([("a",), ("b",)], "name string")
    batches = [
        [("a", at(0)), ("a", at(3)), ("b", at(1)), ("unknown", at(2)), ("a", at(3))],
        [("a", at(14)), ("all", at(30)), ("a", at(9)), ("b", at(29))],
        [("b", at(45)), ("b", at(33)), ("a", at(200))],
        [("a", at(400)), ("unknown", at(900))],
        [("a", at(1000))],
    ]
    schema = "name string, ts timestamp"
    source = tmp_path / "in"
    source.mkdir()
    found = []
    stream = feeds.dispatch_pulls(spark.readStream.schema(schema).parquet(str(source)), known, "10 seconds", "20 seconds")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/b{i}")
        some = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
        stream = feeds.dispatch_pulls(some, known, "10 seconds", "20 seconds")
        q = stream.writeStream.foreachBatch(lambda df, _: found.extend((r.name, r.ts) for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    want = [p for p in pulls([n for rows in batches for n in rows], ["a", "b"], timedelta(seconds=10))]
    assert sorted(found) == want
    for name in ("a", "b"):
        own = sorted(t for n, t in found if n == name)
        assert all(y - x >= timedelta(seconds=10) for x, y in zip(own, own[1:]))


def test_posting_lists(spark, tmp_path):
    """Each gram's list holds the rows that have it, whatever their characters; rows meet in lists before any of them moves."""
    texts = [None if i % 9 == 0 else f"nation{i % 5} 日本語🎈 x{i}" * (i % 4) for i in range(200)]
    df = spark.createDataFrame([(f"k{i % 190}", t, "tag") for i, t in enumerate(texts)], "id string, text string, tag string").coalesce(1)
    postings.build_index(df, "id", ["text", "tag"], str(tmp_path), segment_rows=100)
    stored = spark.read.parquet(f"{tmp_path}/texts")
    want = {}
    for r in stored.collect():
        for f, t in (("text", r._text), ("tag", r._tag)):
            for j in range(len(t) - 2):
                want.setdefault((f, t[j : j + 3], r.segment), set()).add(r.id)
    got = spark.read.parquet(f"{tmp_path}/postings").collect()
    assert {(r.field, r.gram, r.segment): set(r.ids) for r in got} == want and len(got) == len(want) and all(len(r.ids) == len(set(r.ids)) for r in got)
    assert postings.listed_grams(stored.coalesce(1), "id", ["text", "tag"]).count() < sum(map(len, want.values())) / 5
