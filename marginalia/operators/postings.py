"""A stored index of trigrams for catalog search: postings by gram, and folded texts to verify.

``build_index`` writes two tables: postings (bucket, field, gram, segment, ids), where a
segment is a fixed share of the rows, so that the list of a frequent gram is cut into
parts of bounded length; and texts (segment, row, fields…) with what a search compares. A
search reads the postings of its own grams only (their buckets are folders, grams and
segments are pushed to the files), intersects them within each segment, and
verifies the candidates on the texts of the segments that have any.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import gram_names, gram_sets, search_key, stretches, trigrams
from marginalia.operators.catalog import SHORTEST_TERM, clean_terms

BUCKETS = 64
#: Rows in a segment, in the mean.
SEGMENT_ROWS = 20_000
#: Bytes of text whose lists are made at a time.
STRETCH = 1 << 21


def folded(df: DataFrame, fields: Sequence[str]) -> dict[str, Column]:
    """What each field is compared by; lists are joined."""
    kinds = dict(df.dtypes)
    return {f: F.coalesce(search_key(F.array_join(f, "!!!!!") if kinds[f].startswith("array") else F.col(f)), F.lit("")) for f in fields}


def bucket_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def build_index(df: DataFrame, key: str, fields: Sequence[str], path: str, segment_rows: int = SEGMENT_ROWS) -> None:
    """Write the index of some fields of ``df`` below ``path``; rows of one key are one row each."""
    n = max(1, -(-df.count() // segment_rows))
    segment = F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")
    keys = [c.alias(f"_{f}") for f, c in folded(df, fields).items()]
    texts = df.select(F.col(key), segment.alias("segment"), *keys)
    # small groups of rows, so that several tasks read a segment
    texts.repartition("segment").sortWithinPartitions("segment").write.mode("overwrite").option("parquet.block.size", 1 << 23).parquet(f"{path}/texts")
    lists = listed_grams(df.sparkSession.read.parquet(f"{path}/texts"), key, fields).withColumn("bucket", bucket_of(F.col("gram"))).repartition("bucket", "segment")
    whole = lists.groupBy("bucket", "segment", "field", "gram").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    whole.select("field", "gram", "segment", "ids", "bucket").sortWithinPartitions("bucket", "field", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")


def listed_grams(texts: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(field, gram, segment, ids): the rows that hold each gram, in a list for each stretch of rows of one segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segments = batch.column("segment").to_numpy()
            edges = (np.flatnonzero(np.diff(segments)) + 1).tolist()
            for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                for f in fields:
                    mine = batch.slice(a, b - a)
                    for c, d in stretches(pc.binary_length(mine.column(f"_{f}")).to_numpy(), STRETCH):
                        yield listed(mine.slice(c, d - c), f)

    def listed(rows: pa.RecordBatch, field: str) -> pa.RecordBatch:
        row, grams, letters = gram_sets(rows.column(f"_{field}").to_pylist())
        order = np.argsort(grams, kind="stable")
        found, first = np.unique(grams[order], return_index=True)
        ids = pa.ListArray.from_arrays(pa.array([*first, len(order)], pa.int32()), rows.column(key).take(pa.array(row[order])))
        columns = [pa.array([field] * len(found), pa.string()), pa.array(gram_names(found, letters), pa.string()), pa.array(np.full(len(found), rows.column("segment")[0].as_py()), pa.int32()), ids]
        return pa.RecordBatch.from_arrays(columns, ["field", "gram", "segment", "ids"])

    some = texts.select("segment", key, *[f"_{f}" for f in fields])
    return some.mapInArrow(run, f"field string, gram string, segment int, ids array<{dict(texts.dtypes)[key]}>")


def grams_of(spark: SparkSession, needle: str) -> tuple[str, list[tuple[str, int]]]:
    """The folded needle, and its grams with their buckets: as many as the needle has characters at most."""
    row = spark.range(1).select(search_key(F.lit(needle)).alias("n")).select("n", F.transform(F.coalesce(trigrams(F.col("n")), F.array().cast("array<string>")), lambda g: F.struct(g.alias("gram"), bucket_of(g).alias("bucket"))).alias("g")).first()
    return row.n, [(g.gram, g.bucket) for g in row.g]


def candidates(spark: SparkSession, path: str, key: str, needle: str, fields: Sequence[str]) -> tuple[str, DataFrame | None]:
    """(segment, key, field) of rows that hold all grams of the needle in one field; None if it is too short to be looked up."""
    text, grams = grams_of(spark, needle)
    if len(text) < SHORTEST_TERM or not grams:
        return text, None
    wanted = sorted({b for _, b in grams})
    kind = dict(spark.read.parquet(f"{path}/texts").dtypes)[key]
    stored = spark.read.schema(f"field string, gram string, segment int, ids array<{kind}>, bucket int").parquet(f"{path}/postings")
    lists = stored.where(F.col("bucket").isin(wanted) & F.col("gram").isin([g for g, _ in grams]) & F.col("field").isin(list(fields)))
    met = lists.groupBy("field", "segment").agg(F.collect_list("ids").alias("lists")).where(F.size("lists") == len(grams))
    both = F.aggregate(F.slice("lists", 2, len(grams)), F.element_at("lists", 1), lambda a, b: F.array_intersect(a, b))
    return text, met.select("segment", "field", F.explode(both).alias(key))


def search_index(spark: SparkSession, path: str, key: str, clauses: Sequence[tuple[str | None, str]], fields: Sequence[str]) -> DataFrame:
    """(key) of the rows that contain all clauses (field or any field, text); the hits of ``catalog_search`` over what was indexed.

    A clause shorter than three characters matches nothing; no clauses match everything."""
    texts = spark.read.parquet(f"{path}/texts")
    terms = [(field, term) for field, text in clauses for term in (clean_terms(text) if field is None else [text])]
    if not terms:
        return texts.select(key).distinct()
    hits = []
    for field, term in terms:
        own = list(fields) if field is None else [field]
        needle, found = candidates(spark, path, key, term, own)
        if found is None:
            return texts.where(F.lit(False)).select(key)
        sure = reduce(lambda a, b: a | b, [(F.col("field") == f) & F.contains(F.col(f"_{f}"), F.lit(needle)) for f in own])
        hits.append(texts.join(found, ["segment", key]).where(sure).select(key).distinct())
    return reduce(lambda a, b: a.join(b, key, "left_semi"), hits)
