"""The pipeline on a small table: each stage keeps what its operator keeps."""

from test_llm import docs, prose, rows  # noqa: F401

import corpus_pipeline


def test_stages(spark, docs):  # noqa: F811
    kept, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        columns = kept.columns
        kept = stage(spark, kept, "").cache()
        assert name == "packing" or kept.columns == columns
        seen[name] = kept.collect()
    ids = {name: {r.doc_id for r in some} for name, some in seen.items()}
    assert ids["quality"] == {1, 2, 3, 8, 9, None} and ids["near_duplicates"] == {1, 8, 9, None} == ids["pii"]
    assert next(r.text for r in seen["substrings"] if r.doc_id == 9) == prose(5, 40) + " " + prose(6, 40)
    assert ids["packing"] == ids["pii"]


def test_empty(spark, docs):  # noqa: F811
    kept = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, "")
        assert kept.count() == 0
