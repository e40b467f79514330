"""Change notices and versioned feeds as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from marginalia.operators.upserts import merge_feed, next_mark


def process_notices(stream: DataFrame, allowed: DataFrame, handler: Callable[[DataFrame, int], None], every: str | None = None) -> DataStreamWriter:
    """Notices (name, ts) with a known name, one of each name and minute, to a handler of micro-batches.

    A name may come late by ten minutes; the state of older ones is dropped."""
    known = stream.join(allowed.select("name").distinct(), "name", "left_semi").withWatermark("ts", "10 minutes")
    once = known.withColumn("minute", F.date_trunc("minute", "ts")).dropDuplicatesWithinWatermark(["name", "minute"])
    writer = once.writeStream.foreachBatch(handler)
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def refresh_ticks(events: DataFrame, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, notices): notices in each tumbling window; works on batches and on streams."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", every).alias("w")).agg(F.count("*").alias("notices")).select(F.col("w.start").alias("start"), "notices")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, events): visits that end after a gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


BUCKETS = 32


def bucket(buckets: int, key: str = "key") -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def last_manifest(spark: SparkSession, path: str) -> tuple[int, int, dict[int, int]] | None:
    """(batch, mark, {bucket: batch that wrote it}) of the last complete batch, or None before the first."""
    manifests = f"{path}/manifests"
    folder = spark._jvm.org.apache.hadoop.fs.Path(manifests)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    rows = spark.read.parquet(manifests)
    last = rows.agg(F.max("batch")).first()[0]
    # one row a bucket
    found = rows.where(F.col("batch") == last).collect()
    return (last, found[0]["mark"], {r["bucket"]: r["written"] for r in found if r["written"] is not None}) if found else None


def read_merged(spark: SparkSession, path: str, schema: str | StructType, only: Collection[int] | None = None) -> DataFrame:
    """The merged table, or only some of its buckets."""
    known = last_manifest(spark, path)
    folders = [f"{path}/rows/{batch}/bucket={b}" for b, batch in sorted((known[2] if known else {}).items()) if only is None or b in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def merge_batches(path: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A handler that merges micro-batches of (key, version, deleted, …) into a table below ``path``; ``read_merged`` reads it.

    Rows are dealt into buckets by key. A batch rewrites the buckets of its own keys only, beside the old ones, and
    is complete once its manifest says which batch wrote each bucket: a failed batch
    leaves the old table and its mark, a repeated one does nothing. Rewritten buckets are
    kept for one batch more, for those who still read them."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = last_manifest(spark, path)
        if known is not None and known[0] >= batch_id:
            return  # done before a restart
        mark, written = (known[1], known[2]) if known is not None else (0, {})
        dealt = batch.withColumn("bucket", bucket(buckets))
        touched = sorted(r[0] for r in dealt.select("bucket").distinct().collect())
        if mark == 0:
            touched, written = sorted({*touched, *written}), {}
        rows = batch.where("NOT deleted").drop("deleted")
        old = read_merged(spark, path, rows.schema, touched) if mark else rows.limit(0)
        new = merge_feed(old, rows, batch.where("deleted").select("key"), mark).withColumn("bucket", bucket(buckets))
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/{batch_id}")
        base = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = base.getFileSystem(spark._jsc.hadoopConfiguration())
        at = lambda *parts: spark._jvm.org.apache.hadoop.fs.Path("/".join([path, *map(str, parts)]))
        now = {b: w for b, w in written.items() if b not in touched} | {b: batch_id for b in touched if files.exists(at("rows", batch_id, f"bucket={b}"))}
        after = next_mark(batch, mark).first()["mark"]
        lines = [(batch_id, after, b, now.get(b)) for b in range(buckets)]
        spark.createDataFrame(lines, "batch long, mark long, bucket int, written long").coalesce(1).write.mode("append").parquet(f"{path}/manifests")
        for b in touched:
            # what this batch has replaced goes with the next one that replaces it
            for older in files.listStatus(at("rows")):
                name = older.getPath().getName()
                if name.isdigit() and int(name) < written.get(b, -1):
                    files.delete(at("rows", name, f"bucket={b}"), True)

    return handle


PULLS = "name string, ts timestamp"


def dispatch_pulls(notices: DataFrame, names: DataFrame, gap: str = "10 seconds", late: str = "1 minute", everything: str = "all") -> DataFrame:
    """(name, ts) of pulls: of each known name as soon as it is noticed, but not within ``gap`` of its last pull; then once, when the gap is over.

    A notice of ``everything`` is one of every name. Unknown names are dropped, and so are
    notices that a later pull has already answered. Each name's last pull, and whether one
    is due, is state with a timer on the watermark; it goes when nothing more can fall within the gap."""
    width = notices.sparkSession.range(1).select(F.expr(f"INTERVAL {gap}").cast("interval day to second").alias("x")).first()[0]
    known = names.select("name").distinct()
    routes = known.select(F.col("name").alias("_asked"), "name").unionByName(known.select(F.lit(everything).alias("_asked"), "name"))
    asked = notices.select(F.col("name").alias("_asked"), "ts").join(routes, "_asked").select("name", "ts")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (name,) = key
        last, due = state.get if state.exists else (None, None)
        last, due = (pd.Timestamp(x) if x is not None else None for x in (last, due))
        pulls: list[pd.Timestamp] = []
        if state.hasTimedOut and due is None:
            state.remove()
            yield pd.DataFrame({"name": [], "ts": []}).astype({"ts": "datetime64[ns]"})
            return
        for ts in [] if state.hasTimedOut else sorted(t for b in batches for t in b["ts"]):
            if due is not None and ts >= due:
                pulls.append(due)
                last, due = due, None
            if last is None or ts >= last + width:
                pulls.append(ts)
                last = ts
            elif ts > last and due is None:
                due = last + width
        now = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        if due is not None and due <= now:
            pulls.append(due)
            last, due = due, None
        end = due if due is not None else last + width
        if end <= now:
            state.remove()
        else:
            state.update((last.to_pydatetime(), due.to_pydatetime() if due is not None else None))
            state.setTimeoutTimestamp(int(end.timestamp() * 1000))
        yield pd.DataFrame({"name": [name] * len(pulls), "ts": pd.Series(pulls, dtype="datetime64[ns]")})

    timed = asked.withWatermark("ts", late)
    return timed.groupBy("name").applyInPandasWithState(step, PULLS, "last timestamp, due timestamp", "append", GroupStateTimeout.EventTimeTimeout)
