"""Structural joins over the node table, and facts about nodes.

Ancestors come from a node's path and children, parents and siblings from the parent's
number, so all these axes are equi-joins on a document and a node, as many rows as
nodes times their depth; only ``following`` and ``preceding`` compare ranges. No axis
leaves a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def elements(nodes: DataFrame) -> DataFrame:
    return nodes.where(~F.col("tag").startswith("#"))


def attr(attrs: Column, name: str) -> Column:
    """An attribute's value; missing is empty."""
    return F.coalesce(F.try_element_at(attrs, F.lit(name)), F.lit(""))


def around(nodes: DataFrame, name: str = "up", itself: bool = False) -> DataFrame:
    """A row for each element around each node, and for the node itself if asked for: adds its number."""
    return nodes.withColumn(name, F.explode(F.array_append("path", F.col("pre")) if itself else F.col("path")))


def axis(nodes: DataFrame, context: DataFrame, name: str) -> DataFrame:
    """(nodes…, context): the nodes on an axis of each context node (doc_id, pre, post, parent, path)."""
    itself = name.endswith("-or-self")
    none = F.lit(-1)
    c = context.select("doc_id", F.col("pre").alias("context"), F.col("post").alias("_post"), F.coalesce("parent", none).alias("_parent"), "path", "pre")
    match name.removesuffix("-or-self"):
        case "self":
            out = nodes.join(c.select("doc_id", "context", F.col("context").alias("pre")), ["doc_id", "pre"])
        case "child":
            out = nodes.withColumn("context", F.col("parent")).join(c.select("doc_id", "context"), ["doc_id", "context"])
        case "parent":
            out = nodes.join(c.select("doc_id", "context", F.col("_parent").alias("pre")), ["doc_id", "pre"])
        case "descendant":
            out = around(nodes, "context", itself).join(c.select("doc_id", "context"), ["doc_id", "context"])
        case "ancestor":
            out = nodes.join(around(c, "_up", itself).select("doc_id", "context", F.col("_up").alias("pre")), ["doc_id", "pre"])
        case "following-sibling" | "preceding-sibling":
            later = F.col("pre") > F.col("context") if name.startswith("following") else F.col("pre") < F.col("context")
            out = nodes.withColumn("_parent", F.coalesce("parent", none)).join(c.select("doc_id", "context", "_parent"), ["doc_id", "_parent"]).where(later)
        case "following" | "preceding":
            n, k = nodes, c.select("doc_id", "context", "_post")
            beside = (F.col("pre") > F.col("context")) & (F.col("post") > F.col("_post")) if name == "following" else (F.col("pre") < F.col("context")) & (F.col("post") < F.col("_post"))
            out = n.join(k, (n["doc_id"] == k["doc_id"]) & beside).drop(k["doc_id"])
        case _:
            raise ValueError(f"no axis {name}")
    return out.select(*nodes.columns, "context")


def _solid(nodes: DataFrame) -> DataFrame:
    """Nodes but comments, instructions and blank texts."""
    return nodes.where(~F.col("tag").isin("#comment", "#instruction") & ~((F.col("tag") == "#text") & ~F.col("text").rlike(r"\S")))


def stuck_axis(nodes: DataFrame, context: DataFrame, name: str) -> DataFrame:
    """(doc_id, context, pre) of the element beside a context node with only blank text between: first-child, parent, next, previous."""
    w = Window.partitionBy("doc_id", "parent").orderBy("pre")
    solid = _solid(nodes).withColumns({"_next": F.lead("pre").over(w), "_next_tag": F.lead("tag").over(w), "_prev": F.lag("pre").over(w), "_prev_tag": F.lag("tag").over(w)})
    c = context.select("doc_id", F.col("pre").alias("context"), F.col("parent").alias("_up"))
    if name in ("next", "previous"):
        to, tag = ("_next", "_next_tag") if name == "next" else ("_prev", "_prev_tag")
        found = c.join(solid.select("doc_id", F.col("pre").alias("context"), F.col(to).alias("pre"), F.col(tag).alias("_t")), ["doc_id", "context"])
        return found.where(F.col("pre").isNotNull() & ~F.col("_t").startswith("#")).select("doc_id", "context", "pre")
    first = solid.where("_prev IS NULL").select("doc_id", "parent", "pre", "tag")
    if name == "first-child":
        return c.join(first.select("doc_id", F.col("parent").alias("context"), "pre", "tag"), ["doc_id", "context"]).where(~F.col("tag").startswith("#")).select("doc_id", "context", "pre")
    # a parent is stuck to the node that is first in it
    return c.join(first.select("doc_id", F.col("pre").alias("context"), F.col("parent").alias("pre")), ["doc_id", "context"]).where("pre IS NOT NULL").select("doc_id", "context", "pre")


def nearest_ancestor(nodes: DataFrame, name: str) -> DataFrame:
    """(doc_id, pre, value): an attribute's value on each element or the nearest one above it that has it."""
    having = elements(nodes).where(attr(F.col("attrs"), name) != "").select("doc_id", F.col("pre").alias("up"), attr(F.col("attrs"), name).alias("value"))
    # a larger number on one path lies deeper
    return around(elements(nodes).select("doc_id", "pre", "path"), "up", True).join(having, ["doc_id", "up"]).groupBy("doc_id", "pre").agg(F.max_by("value", "up").alias("value"))


def hierarchical_number(nodes: DataFrame, tag: str, above: str = "div", missing: str = "?") -> DataFrame:
    """(doc_id, pre, number): an element's ``n`` after those of the ``above`` elements around it, outermost first, joined by points."""
    mine = nodes.where(F.col("tag") == tag).select("doc_id", "pre", "path", F.coalesce(F.nullif(attr(F.col("attrs"), "n"), F.lit("")), F.lit(missing)).alias("own"))
    outer = nodes.where((F.col("tag") == above) & (attr(F.col("attrs"), "n") != "")).select("doc_id", F.col("pre").alias("up"), attr(F.col("attrs"), "n").alias("_n"))
    pairs = mine.withColumn("up", F.explode_outer("path")).join(outer, ["doc_id", "up"], "left")
    numbers = F.transform(F.sort_array(F.collect_list(F.when(F.col("_n").isNotNull(), F.struct("up", "_n")))), lambda x: x["_n"])
    return pairs.groupBy("doc_id", "pre", "own").agg(numbers.alias("n")).select("doc_id", "pre", F.array_join(F.concat("n", F.array("own")), ".").alias("number"))


def node_flags(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, tag, n_elements, n_texts, mixed, empty, plain) of elements: what their children are; blank texts do not count."""
    kids = _solid(nodes).where("parent IS NOT NULL").groupBy("doc_id", F.col("parent").alias("pre")).agg(F.sum((~F.col("tag").startswith("#")).cast("int")).alias("n_elements"), F.sum((F.col("tag") == "#text").cast("int")).alias("n_texts"))
    out = elements(nodes).select("doc_id", "pre", "tag").join(kids, ["doc_id", "pre"], "left").fillna(0, ["n_elements", "n_texts"])
    return out.withColumns({"mixed": (F.col("n_elements") > 0) & (F.col("n_texts") > 0), "empty": (F.col("n_elements") == 0) & (F.col("n_texts") == 0), "plain": F.col("n_elements") == 0})


def text_of(nodes: DataFrame, tag: str | None = None) -> DataFrame:
    """(doc_id, pre, content): all text below each element, in document order."""
    outer = (elements(nodes) if tag is None else nodes.where(F.col("tag") == tag)).select("doc_id", "pre")
    text = around(nodes.where("tag = '#text'").select("doc_id", F.col("pre").alias("_pre"), "path", "text").withColumnRenamed("_pre", "pre"), "_up").select("doc_id", F.col("_up"), F.col("pre").alias("_pre"), "text")
    inside = text.withColumnRenamed("_up", "pre").join(outer, ["doc_id", "pre"])
    return inside.groupBy("doc_id", "pre").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_pre", "text"))), lambda x: x["text"]), "").alias("content"))


def axis_profile(nodes: DataFrame) -> DataFrame:
    """(axis, tag, n): how many elements of a tag stand on each of the eleven axes of all elements of their documents.

    No pair is made: where an element stands in its document and among its siblings says how many
    elements have it on an axis, as post = pre - depth + descendants on elements alone."""
    whole, siblings = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "parent")
    placed = elements(nodes).select(
        "tag", F.col("depth").cast("long").alias("up"), F.row_number().over(whole.orderBy("pre")).alias("pre"), F.row_number().over(whole.orderBy("post")).alias("post"), F.count("*").over(whole).alias("all"),
        F.when(F.col("parent").isNotNull(), F.row_number().over(siblings.orderBy("pre")) - 1).otherwise(0).alias("earlier"), F.when(F.col("parent").isNotNull(), F.count("*").over(siblings) - 1).otherwise(0).alias("beside"),
        "doc_id", F.col("pre").alias("_pre"),
    )
    children = elements(nodes).where("parent IS NOT NULL").groupBy("doc_id", F.col("parent").alias("_pre")).agg(F.count("*").alias("children"))
    placed = placed.join(children, ["doc_id", "_pre"], "left").withColumn("down", F.col("post") - F.col("pre") + F.col("up"))
    counts = {
        "self": F.lit(1), "child": F.least("up", F.lit(1)), "parent": F.coalesce("children", F.lit(0)), "descendant": F.col("up"), "descendant-or-self": F.col("up") + 1, "ancestor": F.col("down"), "ancestor-or-self": F.col("down") + 1,
        "following-sibling": F.col("earlier"), "preceding-sibling": F.col("beside") - F.col("earlier"), "following": F.col("pre") - 1 - F.col("up"), "preceding": F.col("all") - F.col("pre") - F.col("down"),
    }
    sums = placed.groupBy("tag").agg(*[F.sum(c.cast("long")).alias(name) for name, c in counts.items()])
    rows = sums.select("tag", F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in counts]), F.array(*[F.col(f"`{k}`") for k in counts]))).alias("axis", "n"))
    return rows.where("n > 0").select("axis", "tag", "n")
