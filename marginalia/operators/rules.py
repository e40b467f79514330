"""Data-quality rules as rows, and the report of documents that break them.

A rule is (rule_id, kind, context, a, b, message, severity, prefix): ``context``
is the tag it looks at, ``a`` and ``b`` depend on the kind. Every check returns
(doc_id, rule_id, pre, line, col, severity, message).
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions.text import character_names, clusters, nfc
from marginalia.operators.axes import attr, elements, text_of

OK, WARNING, ERROR, FATAL = 0, 1, 2, 3
RULE = "rule_id string, kind string, context string, a string, b string, message string, severity int, prefix string"
#: What ``a`` and ``b`` mean for each kind.
KINDS = {
    "excludes": "attribute a must not stand with attribute b",
    "requires": "attribute a needs attribute b",
    "parent": "the parent must be one of the tags in a",
    "not-parent": "the parent must not be one of the tags in a",
    "ancestor": "an element a must be above",
    "not-ancestor": "no element a may be above",
    "child": "there must be at least b children a",
    "max-child": "there may be at most b children a",
    "last": "nothing may follow it inside its parent",
    "preceded": "the element before it must be a",
    "unique": "attribute a must not repeat among children with the tag b",
    "target": "attribute a must name an xml:id in the document; with b = after, a later one",
    "parent-attr": "the parent must have attribute a (with value b if given)",
    "pattern": "attribute a must match the regular expression b",
    "text": "there must be text",
    "count": "attribute a must hold at most b words",
    "values": "attribute a must be one of the words of b",
}
# Scripts whose clusters may have several characters, by the first word of their characters' names.
SCRIPTS = ("TAMIL", "TELUGU", "KHMER", "DEVANAGARI", "GRANTHA", "KANNADA", "BALINESE")
# Clusters of letters and marks that are expected too, and the one Cyrillic letter that is.
COMBINATIONS = ("r̥", "L̥", "R̥", "m̃", "ə̄", "l̥", "m̐", "r̥̄", "L̥̄", "R̥̄", "l̥̄", "n̆")
CYRILLIC_SCHWA = "ә"


@cache
def characters_named(word: str) -> str:
    """The characters whose names begin with a word, as ranges inside brackets of a regular expression."""
    codes = [c for c in range(0x80, 0x20000) if unicodedata.name(chr(c), "").startswith(word + " ")]
    starts = [c for c, before in zip(codes, [-1, *codes], strict=False) if c != before + 1]
    ends = [c for c, after in zip(codes, [*codes[1:], -1], strict=True) if after != c + 1]
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(starts, ends, strict=True))


def rule_frame(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rules, RULE)


def applying(violations: DataFrame, docs: DataFrame, rules: DataFrame) -> DataFrame:
    """The violations of rules that apply to their documents by the names' prefixes; a null prefix applies to all."""
    named = violations.join(rules.select("rule_id", "prefix"), "rule_id")
    free, bound = named.where("prefix IS NULL"), named.where("prefix IS NOT NULL")
    kept = bound.join(docs.select("doc_id", "name"), "doc_id").where(F.col("name").startswith(F.col("prefix"))).drop("name")
    return free.unionByName(kept).select(*violations.columns)


def _at(nodes: DataFrame, rules: DataFrame, *kinds: str) -> DataFrame:
    """Elements beside the rules of some kinds that look at them."""
    mine = rules.where(F.col("kind").isin(*kinds))
    return elements(nodes).join(mine, F.col("tag") == F.col("context"))


def _report(bad: DataFrame) -> DataFrame:
    return bad.select("doc_id", "rule_id", "pre", "line", "col", "severity", "message").distinct()


def _value(name: str) -> Column:
    return F.coalesce(F.try_element_at(F.col("attrs"), F.col(name)), F.lit(""))


def _words(name: str) -> Column:
    return F.split(F.col(name), r"\s+")


def check_cooccurrence(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    at = _at(nodes, rules, "excludes", "requires")
    clash = F.when(F.col("kind") == "excludes", _value("b") != "").otherwise(_value("b") == "")
    return _report(at.where((_value("a") != "") & clash))


def check_context(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    at = _at(nodes, rules, "parent", "not-parent", "ancestor", "not-ancestor")
    tags = elements(nodes).select("doc_id", F.col("pre").alias("up"), F.col("tag").alias("_tag"))
    near = F.when(F.col("kind").isin("ancestor", "not-ancestor"), F.col("path")).otherwise(F.slice("path", -1, 1))
    found = at.where(F.size("path") > 0).withColumn("up", F.explode(near)).join(tags, ["doc_id", "up"]).where(F.array_contains(_words("a"), F.col("_tag"))).select("doc_id", "rule_id", "pre").distinct().withColumn("_hit", F.lit(True))
    both = at.join(found, ["doc_id", "rule_id", "pre"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    return _report(both.where(F.col("_hit") == F.col("kind").startswith("not-")))


def check_children(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    at = _at(nodes, rules, "child", "max-child")
    kids = elements(nodes).where("parent IS NOT NULL").groupBy("doc_id", F.col("parent").alias("pre"), F.col("tag").alias("a")).agg(F.count("*").alias("_n"))
    both = at.join(kids, ["doc_id", "pre", "a"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    limit = F.col("b").cast("int")
    return _report(both.where(F.when(F.col("kind") == "child", F.col("_n") < F.coalesce(limit, F.lit(1))).otherwise(F.col("_n") > F.coalesce(limit, F.lit(0)))))


def check_order(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id", "parent").orderBy("pre")
    placed = elements(nodes).withColumns({"_before": F.lag("tag").over(w), "_after": F.lead("tag").over(w)})
    at = placed.join(rules.where(F.col("kind").isin("last", "preceded")), F.col("tag") == F.col("context"))
    return _report(at.where(F.when(F.col("kind") == "last", F.col("_after").isNotNull()).otherwise(~F.col("_before").eqNullSafe(F.col("a")))))


def check_unique(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    at = _at(nodes, rules, "unique").select("doc_id", F.col("pre").alias("_up"), "rule_id", "a", "b", "severity", "message")
    kids = elements(nodes).select("doc_id", F.col("parent").alias("_up"), "pre", "line", "col", F.col("tag").alias("b"), "attrs")
    both = at.join(kids, ["doc_id", "_up", "b"]).withColumn("_v", _value("a")).where("_v <> ''")
    n = F.row_number().over(Window.partitionBy("doc_id", "_up", "rule_id", "_v").orderBy("pre"))
    return _report(both.withColumn("_n", n).where("_n > 1"))


def check_targets(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    at = _at(nodes, rules, "target").withColumn("_id", F.regexp_replace(_value("a"), "^#", "")).where("_id <> ''")
    ids = elements(nodes).select("doc_id", F.coalesce(F.nullif(attr(F.col("attrs"), "id"), F.lit("")), F.try_element_at("attrs", F.lit("xml:id"))).alias("_id"), F.col("pre").alias("_to")).where("_id IS NOT NULL").groupBy("doc_id", "_id").agg(F.max("_to").alias("_to"))
    both = at.join(ids, ["doc_id", "_id"], "left")
    return _report(both.where(F.col("_to").isNull() | ((F.col("b") == "after") & (F.col("_to") <= F.col("pre")))))


def check_parent_attribute(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    at = _at(nodes, rules, "parent-attr")
    up = elements(nodes).select("doc_id", F.col("pre").alias("parent"), F.col("attrs").alias("_attrs"))
    both = at.join(up, ["doc_id", "parent"], "left").withColumn("_v", F.coalesce(F.try_element_at("_attrs", F.col("a")), F.lit("")))
    return _report(both.where(F.when(F.col("b").isNull(), F.col("_v") == "").otherwise(F.col("_v") != F.col("b"))))


def check_values(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    at = _at(nodes, rules, "pattern", "count", "values")
    v = _value("a")
    bad = F.when(F.col("kind") == "pattern", ~F.expr("coalesce(try_element_at(attrs, a), '') rlike b")).when(F.col("kind") == "count", F.size(F.filter(F.split(v, r"\s+"), lambda x: x != "")) > F.col("b").cast("int")).otherwise(~F.array_contains(_words("b"), v))
    return _report(at.where((v != "") & bad))


def check_text(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    at = _at(nodes, rules, "text").join(text_of(nodes), ["doc_id", "pre"], "left")
    return _report(at.where(F.col("content").isNull() | ~F.col("content").rlike(r"\S")))


CHECKS = (check_cooccurrence, check_context, check_children, check_order, check_unique, check_targets, check_parent_attribute, check_values, check_text)


def grapheme_issues(df: DataFrame, column: str = "text") -> DataFrame:
    """(doc_id, line, place, cluster, names): unexpected grapheme clusters of composed text, each time they occur.

    A single character is expected unless it is Cyrillic; several are if all are of one
    script, or form a known combination. A line ends at each line feed or carriage
    return. ASCII lines are passed over."""
    # composition crosses no line, and leaves ASCII as it is
    lines = df.select("doc_id", F.posexplode(F.split(F.coalesce(F.col(column), F.lit("")), "[\r\n]", -1)).alias("line", "_text"))
    odd = lines.where(F.col("_text").rlike(r"[^\x00-\x7F]")).withColumn("_text", nfc(F.col("_text")))
    each = odd.select("doc_id", (F.col("line") + 1).alias("line"), F.posexplode(clusters(F.col("_text"))).alias("place", "cluster"))
    single = (F.length("cluster") == 1) & (~F.col("cluster").rlike(f"[{characters_named('CYRILLIC')}]") | (F.col("cluster") == CYRILLIC_SCHWA))
    several = F.col("cluster").rlike("^(?:" + "|".join(f"[{characters_named(s)}]+" for s in SCRIPTS) + ")$") | F.col("cluster").isin(*COMBINATIONS)
    bad = each.where(~(single | ((F.length("cluster") > 1) & several)))
    return bad.select("doc_id", "line", "place", "cluster", character_names(F.col("cluster")).alias("names"))


def unicode_report(docs: DataFrame) -> DataFrame:
    """Unexpected characters as violations of one rule."""
    issues = grapheme_issues(docs)
    return issues.select("doc_id", F.lit("unicode").alias("rule_id"), F.lit(None).cast("int").alias("pre"), F.col("line").cast("int").alias("line"), F.col("place").alias("col"), F.lit(WARNING).alias("severity"), F.concat(F.lit("unexpected character: "), "names").alias("message"))


def validate(docs: DataFrame, nodes: DataFrame, rules: DataFrame, structural: DataFrame | None = None) -> DataFrame:
    """All violations, stage by stage: a document that does not parse has that one only; one that breaks a
    ``structural`` rule has none of the later stages' but those of its characters, which are looked at last in all that parse."""
    broken = nodes.where("tag = '#error'").select("doc_id", F.lit("parse").alias("rule_id"), "pre", "line", "col", F.lit(FATAL).alias("severity"), F.col("text").alias("message"))
    early = applying(checked(nodes, structural), docs, structural) if structural is not None else None
    late = applying(checked(nodes, rules), docs, rules)
    if early is not None:
        late = late.join(early.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(early)
    sound = docs.join(broken.select("doc_id"), "doc_id", "left_anti")
    return broken.unionByName(late).unionByName(unicode_report(sound))


def checked(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """The violations of all rules, whatever documents they apply to."""
    found = CHECKS[0](nodes, rules)
    for check in CHECKS[1:]:
        found = found.unionByName(check(nodes, rules))
    return found


def report(violations: DataFrame) -> DataFrame:
    """In reading order."""
    return violations.orderBy("doc_id", "line", "col", "rule_id")


def statuses(docs: DataFrame, violations: DataFrame) -> DataFrame:
    """(doc_id, status): each document's worst severity, OK without violations."""
    worst = violations.groupBy("doc_id").agg(F.max("severity").alias("status"))
    return docs.select("doc_id").join(worst, "doc_id", "left").fillna(OK, ["status"])
