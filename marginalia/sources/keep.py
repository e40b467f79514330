"""Frames written once in the shared folder, to be read often without computing them again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where that is unset and Spark is this process alone, a temporary folder."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """``df`` from a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Characters of text whose nodes and events one task holds and sorts.
PART_CHARS = 1 << 20


def parts_for(texts: DataFrame, column: str) -> int:
    """Into how many partitions to deal what is made of these texts, so that a task's share does not grow with them; one sum comes to the driver."""
    size = texts.agg(F.sum(F.length(column))).first()[0] or 0
    return max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_CHARS))


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def through_files(spark: SparkSession, write: Callable[[str], None], read: Callable[[str], DataFrame]) -> DataFrame:
    """What is read from a new shared folder that was written to; the result is kept and the folder deleted."""
    path = new_folder(spark)
    write(path)
    found = kept(read(path))
    delete_folder(spark, path)
    return found
