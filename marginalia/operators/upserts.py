"""Incremental tables: change sets, upserts, tombstones and deletes by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_latest(target: DataFrame, source: DataFrame, key: str, order: str) -> DataFrame:
    """Both tables' rows, the greatest ``order`` of each key; of equal ones the source's.

    One aggregate that combines before it shuffles: no window over a key's history."""
    rows = target.withColumn("_new", F.lit(0)).unionByName(source.withColumn("_new", F.lit(1)))
    rest = [c for c in target.columns if c != key]
    best = rows.groupBy(key).agg(F.max(F.struct(order, "_new", F.struct(*rest).alias("_row"))).alias("_best"))
    return best.select(key, "_best._row.*").select(*target.columns)


def upsert(target: DataFrame, source: DataFrame, key: str, on_conflict: str = "update") -> DataFrame:
    """``update``: the source's rows replace the target's; ``nothing``: the target's stay."""
    if on_conflict == "nothing":
        return target.unionByName(source.join(target.select(key), key, "left_anti"))
    return target.join(source.select(key), key, "left_anti").unionByName(source)


def delete_cascade(tables: dict[str, DataFrame], key: str, names: DataFrame) -> dict[str, DataFrame]:
    """The tables without the rows of some keys."""
    return {table: df.join(names.select(key), key, "left_anti") for table, df in tables.items()}


def load_document(files: DataFrame, owners: DataFrame, name: str) -> DataFrame:
    """One stored document with all its owners."""
    mine = owners.where(F.col("name") == name).groupBy("name").agg(F.sort_array(F.collect_set("git_name")).alias("owners"))
    return files.where(F.col("name") == name).join(mine, "name", "left")


def changes(before: DataFrame, seen: DataFrame, key: str = "name", since: str = "mtime") -> DataFrame:
    """(name, change): inserted, updated (newer than before) or deleted."""
    both = before.select(key, F.col(since).alias("_old"), F.lit(True).alias("_b")).join(seen.select(key, F.col(since).alias("_now"), F.lit(True).alias("_s")), key, "full_outer")
    kind = F.when(F.col("_b").isNull(), "inserted").when(F.col("_s").isNull(), "deleted").when(F.col("_now") > F.col("_old"), "updated")
    return both.select(key, kind.alias("change")).where("change IS NOT NULL")


def pending_files(scan: DataFrame, state: DataFrame) -> DataFrame:
    """Files to process, by their repository's state (repo, commit_hash, code_hash, old_commit, old_code, high_water).

    Same commit and code: none. Other code: all. Else those newer than the high-water mark."""
    both = scan.join(state, "repo")
    same_code = F.col("code_hash").eqNullSafe(F.col("old_code"))
    skip = same_code & F.col("commit_hash").eqNullSafe(F.col("old_commit"))
    return both.where(~skip & (~same_code | (F.col("mtime") > F.coalesce("high_water", F.lit(-1))))).select(*scan.columns)


def merge_feed(target: DataFrame, batch: DataFrame, deleted: DataFrame, mark: int, key: str = "key", version: str = "version") -> DataFrame:
    """The target after a batch of versioned rows above the mark and a list of deleted keys; a mark of 0 starts anew."""
    news = batch.where(F.col(version) > mark)
    merged = upsert_latest(target.limit(0) if mark == 0 else target, news, key, version)
    return merged.join(deleted.select(key).distinct(), key, "left_anti")


def next_mark(batch: DataFrame, mark: int, version: str = "version") -> DataFrame:
    return batch.agg(F.greatest(F.coalesce(F.max(version), F.lit(mark)), F.lit(mark)).alias("mark"))


def rebuild(files: DataFrame, parse, record) -> DataFrame:
    """All derived rows from stored bytes: ``parse`` makes nodes of files, ``record`` records of nodes."""
    return record(parse(files))


def stamp(state: DataFrame, batch_id: int, now: F.Column | None = None) -> DataFrame:
    """The key-value state with ``last_updated`` and ``last_batch`` set."""
    spark = state.sparkSession
    at = (now if now is not None else F.unix_timestamp(F.current_timestamp())).cast("string")
    news = spark.range(1).select(F.explode(F.array(F.struct(F.lit("last_updated").alias("key"), at.alias("value")), F.struct(F.lit("last_batch").alias("key"), F.lit(str(batch_id)).alias("value")))).alias("x")).select("x.*")
    return upsert(state, news, "key")


def rebuild_changed(files: DataFrame, stored: DataFrame, parse: Callable[[DataFrame], DataFrame], record: Callable[[DataFrame], DataFrame], rules: str) -> DataFrame:
    """Derived rows (name, input_hash, rules, …) of all files (name, data), computing only those that are not stored already.

    A stored row counts if its input's hash and the ``rules`` it was made by are what they are now; rows of
    files that are gone go. ``parse`` makes nodes of files, ``record`` records by doc_id of nodes; what does not
    parse has a row of nulls, so that it is not tried again."""
    now = files.select("name", "data", F.sha2(F.coalesce(F.col("data").cast("binary"), F.lit(b"")), 256).alias("input_hash"))
    valid = stored.where(F.col("rules") == rules).join(now.select("name", "input_hash"), ["name", "input_hash"], "left_semi")
    todo = now.join(valid.select("name"), "name", "left_anti")
    made = record(parse(todo.select("name", "data"))).withColumnRenamed("doc_id", "name")
    fresh = todo.select("name", "input_hash").join(made, "name", "left").withColumn("rules", F.lit(rules))
    return valid.select(*stored.columns).unionByName(fresh.select(*stored.columns))
