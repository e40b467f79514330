"""Cutting lineage in the folder that driver and executors share, and connected components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a null doc_id counts as inside operators that join or order by it.
NULL_ID = -(2**63)


#: Rows of whole texts that go to a Python worker at once.
TEXT_BATCH = 1000


def small_batches(df: DataFrame) -> None:
    """Let the session send whole texts in batches of ``TEXT_BATCH`` rows, unless it has a setting of its own."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":  # Spark's default
        conf.set(key, str(TEXT_BATCH))


def shared_folder(df: DataFrame) -> str:
    """spark.checkpoint.dir of the session; only where that is unset and Spark runs in this process alone, as in tests, a temporary folder."""
    spark = df.sparkSession
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not known.isEmpty():
        return known.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once by checkpoint() in the shared folder, to be read often without computing it again.

    Spark deletes it when nothing refers to it any more, where
    spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    shared_folder(df)
    return df.checkpoint()


def dropped(df: DataFrame) -> None:
    """Delete the files of a frame of ``settled`` that nothing reads any more."""
    spark = df.sparkSession
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        folder = spark._jvm.org.apache.hadoop.fs.Path(file.get())
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node in links (a, b): comp is the smallest node that can be reached.

    Large-star and small-star steps in turn: each hangs a node's larger, then its
    smaller neighbours below the smallest one, until only stars are left. A node's
    neighbours are met by aggregates and joins, never as a list."""
    edges = settled(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = settled(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        # stars: nobody hangs below two nodes or below one that hangs itself
        twice = edges.groupBy("a").count().where("count > 1").select("a")
        deep = edges.select(F.col("b").alias("a")).distinct().join(edges.select("a"), "a", "left_semi")
        if twice.unionByName(deep).isEmpty():
            break
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots.select("node", F.col("node").alias("comp")))
