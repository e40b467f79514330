"""Numbering, runs, milestones and carried state, always inside a document or group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import to_boolean


def number_in_order(df: DataFrame, part: str, order: str, name: str = "n") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(part).orderBy(order)))


def run_ids(df: DataFrame, part: str, order: str, key: str, name: str = "run") -> DataFrame:
    """Number the runs of neighbouring rows with equal keys from 1."""
    w = Window.partitionBy(part).orderBy(order)
    new = (~F.col(key).eqNullSafe(F.lag(key).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge_runs(df: DataFrame, part: str, order: str, key: str, text: str, glue: str = " — ") -> DataFrame:
    """(part, run, key, first, merged): one row a run, texts joined in order."""
    return run_ids(df, part, order, key).groupBy(part, "run").agg(F.min(key).alias(key), F.min(order).alias("first"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), glue).alias("merged"))


def page_line_cell(nodes: DataFrame) -> DataFrame:
    """Add page, line and cell to nodes: counts of pb, lb and cell milestones before and at each.

    What stands before the first milestone is in a phantom first page, line or
    cell; lines start anew with a page, cells with a line."""
    w = Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    out = nodes
    parts = ["doc_id"]
    for tag, name in (("pb", "page"), ("lb", "line"), ("milestone", "cell")):
        w = Window.partitionBy(*parts).orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
        seen = F.sum((F.col("tag") == tag).cast("int")).over(w)
        out = out.withColumn(name, F.greatest(seen, F.lit(1)) if tag != "milestone" else seen + 1)
        parts.append(name)
    return out


def run_all(df: DataFrame, part: str, order: str, run: str, flag: str) -> DataFrame:
    """A run's flags all false if one is; the first run of each document true."""
    out = df.withColumn("_all", F.min(F.col(flag).cast("int")).over(Window.partitionBy(part, run)) == 1)
    first = F.min(run).over(Window.partitionBy(part))
    return out.withColumn(flag, F.col("_all") | (F.col(run) == first)).drop("_all")


def milestone_breaks(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, tag, break): whether each page, line or cell begins between words.

    Milestones of falling rank with nothing but blanks between belong together, and all break a
    word if one of them says so. The first ones of a document stand between words if no text comes before
    them, and the last ones if none follows."""
    rank = F.when(F.col("tag") == "pb", 0).when(F.col("tag") == "lb", 1).when(F.col("tag") == "milestone", 2)
    blank = (F.col("tag") == "#text") & ~F.col("text").rlike(r"\S")
    solid = nodes.where(~blank & ~F.col("tag").isin("#comment", "#instruction")).withColumn("_rank", rank)
    order = Window.partitionBy("doc_id").orderBy("pre")
    text = (F.col("tag") == "#text").cast("int")
    before, all_ = F.sum(text).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.sum(text).over(Window.partitionBy("doc_id"))
    placed = solid.withColumns({"_last": F.lag("_rank").over(order), "_before": before, "_after": all_ - before})
    new = F.col("_rank").isNotNull() & (F.col("_last").isNull() | (F.col("_rank") <= F.col("_last")))
    placed = placed.withColumn("_run", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_rank IS NOT NULL")
    own = F.coalesce(to_boolean(F.coalesce(F.try_element_at("attrs", F.lit("break")), F.lit("")), True), F.lit(True))
    run, whole = Window.partitionBy("doc_id", "_run"), Window.partitionBy("doc_id")
    alike = F.min(own.cast("int")).over(run) == 1
    edge = ((F.col("_run") == F.min("_run").over(whole)) & (F.col("_before") == 0)) | ((F.col("_run") == F.max("_run").over(whole)) & (F.col("_after") == 0))
    return placed.select("doc_id", "pre", "tag", (alike | edge).alias("break"))


def break_from_previous(df: DataFrame, part: str | Sequence[str], order: str, flag: str = "enjamb", name: str = "break") -> DataFrame:
    """Whether a line begins a word: not if the line before, in the same group, runs on."""
    w = Window.partitionBy(*([part] if isinstance(part, str) else part)).orderBy(order)
    return df.withColumn(name, ~F.coalesce(F.lag(flag).over(w), F.lit(False)))
