"""A training-data pipeline over ``documents``: what each stage keeps is the next one's input.

quality rejects documents, near_duplicates keeps the smallest id of each group,
substrings cuts repeated passages, pii masks personal data, packing lays the
token pieces into sequences. Rows may be repeated and hold nulls; each stage
gives such rows the result that its operator defines. An empty table stays empty
through all stages. Very long texts go through whole. Further columns, whatever their
names, stay up to the last stage, which returns the columns of packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.line_quality import keep_good
from marginalia.llm.minmax import keep_first
from marginalia.llm.packing import pack_documents
from marginalia.llm.pii import mask_documents
from marginalia.llm.shared import settled
from marginalia.llm.suffix_dedup import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_repeats(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mask_documents(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("pii", pii), ("packing", packing)]

#: The stages link texts by similarity and solve a linear program: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settled(docs)
    return docs
