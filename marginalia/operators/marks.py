"""The three views of an edition's text from a table of rules, in one pass.

A rule is a row (tag, slot, condition, physical, logical, full). ``*`` stands for any
tag, texts included. A condition is a list of tests joined by spaces: ``key=value`` or
``key=value|value``, ``key!=value``, and ``key~word`` for a word of a list; keys are
attributes, or facts of a node that begin with ``#``:

``#in`` the tag of the element around it; ``#pair`` what a choice or substitution
around it holds (sic+corr, orig+reg, unclear, del+add); ``#nth`` only, first, last or
middle among siblings of its tag; ``#chosen`` yes for the first add and del of a
substitution; ``#first`` the tag of its first child; ``#inner`` text if a text is all it
holds; ``#meter`` yes for a known metre; ``#source`` yes in a source language.

The first rule of a slot whose condition holds says what a view does: ``show``,
``drop`` (with all that is inside), ``open|close`` marks, outer slots first, or ``gap``,
``space``, ``symbol``, ``fraction`` and ``meter``, which write a text in its place.

Rules become one projection over the node table. What is dropped is found by a running
maximum of closing numbers, blocks from the paths, marks and texts are events on the
document's clock, and one grouping makes all three texts: a single shuffle by document.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import fraction, gap_text, is_meter, meter_pattern, squeeze, to_boolean
from marginalia.operators.axes import attr

VIEWS = ("physical", "logical", "full")
RULE = "tag string, slot int, condition string, physical string, logical string, full string"


def same(tag: str, condition: str, shown: str, slot: int = 0) -> tuple[str, int, str, str, str, str]:
    """A rule for all three views."""
    return (tag, slot, condition, shown, shown, shown)


# How each view shows an element.
RULES = [
    same("*", "#in=subst #pair=del+add #chosen=no", "drop"), same("#text", "#in=choice #pair!=", "drop"),
    ("sic", 0, "#pair=sic+corr", "¿|?", "drop", "¿|?"), same("sic", "", "¿|?"), ("corr", 0, "#pair=sic+corr", "drop", "⟨|⟩", "⟨|⟩"), same("corr", "", "⟨|⟩"),
    ("orig", 0, "#pair=orig+reg", "¡|!", "drop", "¡|!"), same("orig", "", "¡|!"), ("reg", 0, "#pair=orig+reg", "drop", "⟨|⟩", "⟨|⟩"), same("reg", "", "⟨|⟩"),
    same("unclear", "#pair=unclear #nth=only", "(|)"), same("unclear", "#pair=unclear #nth=first", "(|"), same("unclear", "#pair=unclear #nth=last", "/|)"), same("unclear", "#pair=unclear", "/|"), same("unclear", "", "(|)"), same("unclear", "cert=low #pair!=unclear", "|?", 1),
    same("supplied", "reason=explanation", "(|)"), same("supplied", "reason=omitted", "⟨|⟩"), same("supplied", "reason=subaudible #source=yes", "⟨|⟩"), same("supplied", "", "[|]"), same("supplied", "cert=low", "|?", 1),
    same("add", "", "⟨⟨|⟩⟩"), same("del", "", "⟦|⟧"), same("surplus", "", "{|}"), same("ex", "", "(|)"), same("q", "", "“|”"), same("quote", "", "“|”"),
    same("seg", "#first=gap #meter=yes", "meter"), same("seg", "rend~pun", "{|}"), same("seg", "cert=low", "¿|?", 1),
    same("gap", "", "gap"), same("space", "", "space"), same("g", "type=numeral #inner=text", "fraction"), same("g", "type=numeral", "show"), same("g", "", "symbol"),
    *(same(tag, "", "drop") for tag in ("note", "app", "listApp", "bibl", "teiHeader", "editionStmt", "facsimile", "handShift", "publicationStmt", "msIdentifier", "encodingDesc", "revisionDesc", "fw")),
]
# What stands for a space of each type; types with a count show one sign for each character.
SPACES = {"semantic": "_", "binding-hole": "◯", "descender": "⊔", "ascender": "⊓", "defect": "□", "feature": "_", "vacat": "_", "unclassified": "_"}
COUNTED_SPACES = ("semantic", "vacat", "unclassified")
MILESTONES = ("pb", "lb", "cb", "gb", "milestone")
WRITTEN = ("gap", "space", "symbol", "fraction", "meter")
#: Signs that no XML text can hold, for what is only a place: a note, a milestone between words and one within a word.
NOTE, BETWEEN, WITHIN = "\x01", "\x02", "\x03"
FACTS = ("in", "pair", "nth", "chosen", "first", "inner", "meter", "source")


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def test_of(tag: str, condition: str) -> str:
    """When a rule holds, as an expression over tag, attributes and facts."""
    out = ["true"] if tag == "*" else [f"tag = {quoted(tag)}"]
    for one in condition.split():
        key, sign, value = re.fullmatch(r"([^=!~]+)(!=|=|~)(.*)", one).groups()
        have = f"coalesce(_{key[1:]}, '')" if key.startswith("#") else f"coalesce(try_element_at(attrs, {quoted(key)}), '')"
        values = ", ".join(map(quoted, value.split("|")))
        out.append(f"{have} IN ({values})" if sign == "=" else f"{have} <> {quoted(value)}" if sign == "!=" else f"array_contains(split({have}, '\\\\s+'), {quoted(value)})")
    return " AND ".join(out)


def with_facts(nodes: DataFrame, symbols: DataFrame | None, prosody: DataFrame | None, sources: DataFrame | None) -> DataFrame:
    """Add the facts that conditions may ask for, and what is needed to write and to move nodes."""
    element = ~F.col("tag").startswith("#")
    within = F.coalesce(F.try_element_at("names", F.lit(-1)), F.lit(""))
    all_, alike = Window.partitionBy("doc_id", "parent"), Window.partitionBy("doc_id", "parent", "tag")
    has = lambda tag: F.coalesce(F.max((F.col("tag") == tag).cast("int")).over(all_) == 1, F.lit(False))
    count = F.count_if(element).over(all_)
    others = F.count_if(element & (F.col("tag") != "unclear")).over(all_)
    choice = F.when((count == 2) & has("sic") & has("corr"), "sic+corr").when((count == 2) & has("orig") & has("reg"), "orig+reg").when((count > 0) & (others == 0), "unclear")
    place, total = F.row_number().over(alike.orderBy("pre")), F.count("*").over(alike)
    order = Window.partitionBy("doc_id").orderBy("pre")
    child = F.struct("tag", "depth", "text", "post", "attrs")
    n = nodes.withColumns({
        "_in": within, "_t": 2 * F.col("pre") - 1 - F.col("depth"), "_end": 2 * F.col("post") + F.col("depth"),
        "_pair": F.when(within == "choice", choice).when((within == "subst") & has("add") & has("del"), "del+add"),
        "_nth": F.when(total == 1, "only").when(place == 1, "first").when(place == total, "last").otherwise("middle"),
        "_chosen": F.when(F.col("tag").isin("add", "del") & (place == 1), "yes").otherwise("no"),
        "_c1": F.lead(child, 1).over(order), "_c2": F.lead(child, 2).over(order),
    })
    edge = lambda tag, c: F.min(F.when((F.col("tag") == tag) & (F.col("_chosen") == "yes"), F.col(c))).over(all_)
    add, gone, gone_end = edge("add", "_t"), edge("del", "_t"), edge("del", "_end")
    turned = (F.col("_pair") == "del+add") & (F.col("_chosen") == "yes") & (add < gone)
    inside = lambda c: F.coalesce(F.col(f"{c}.depth") == F.col("depth") + 1, F.lit(False))
    blank = (F.col("_c1.tag") == "#text") & ~F.col("_c1.text").rlike(r"\S")
    alone = element & inside("_c1") & (F.col("_c1.tag") == "#text") & (F.col("_c1.post") == F.col("post") - 1)
    met = attr(F.col("attrs"), "met")
    n = n.withColumns({
        # an addition before its deletion changes places with it
        "_shift": F.when(turned, F.when(F.col("tag") == "del", add - gone).otherwise(gone_end - gone + 1)).otherwise(0),
        "_first": F.when(element & inside("_c1"), F.when(~blank, F.col("_c1.tag")).when(inside("_c2"), F.col("_c2.tag"))),
        "_inner": F.when(alone, "text"), "_said": F.when(alone, F.col("_c1.text")),
        "_doubtful": F.coalesce(inside("_c1") & (F.col("_c1.tag") == "certainty") & (attr(F.col("_c1.attrs"), "match") == "..") & (attr(F.col("_c1.attrs"), "locus") == "name"), F.lit(False)),
        "_pattern": F.when(is_meter(met), meter_pattern(met)),
    })
    if prosody is not None:
        known = prosody.groupBy(F.col("name").alias("_met")).agg(F.min("pattern").alias("_known"))
        n = n.join(known, (F.col("tag") == "seg") & (met == F.col("_met")), "left").withColumn("_pattern", F.coalesce("_pattern", meter_pattern(F.col("_known"))))
    n = n.withColumn("_meter", F.when(F.col("_pattern").isNotNull(), "yes"))
    if symbols is not None:
        n = n.join(symbols.groupBy(F.col("name").alias("_name")).agg(F.min("text").alias("_shown")), (F.col("tag") == "g") & (attr(F.col("attrs"), "type") == F.col("_name")), "left")
    else:
        n = n.withColumn("_shown", F.lit(None).cast("string"))
    if sources is not None:
        known = sources.select("doc_id", F.col("pre").alias("_up"), F.col("source").alias("_is"))
        asked = nodes.where("tag = 'supplied'").where(attr(F.col("attrs"), "reason") == "subaudible").select("doc_id", "pre", F.explode("path").alias("_up"))
        near = asked.join(known, ["doc_id", "_up"]).groupBy("doc_id", "pre").agg(F.when(F.max_by("_is", "_up"), "yes").alias("_source"))
        n = n.join(near, ["doc_id", "pre"], "left")
    else:
        n = n.withColumn("_source", F.lit(None).cast("string"))
    return n


def written(kind: Column, physical: bool) -> Column:
    """The text that stands in an element's place."""
    a = lambda name: attr(F.col("attrs"), name)
    space = F.when(a("type").isin(*SPACES), a("type")).otherwise("semantic")
    signs = F.create_map(*[F.lit(x) for pair in SPACES.items() for x in pair])
    n = F.when(space.isin(*COUNTED_SPACES) & a("quantity").rlike("^[0-9]+$"), F.greatest(a("quantity").cast("int"), F.lit(1))).otherwise(1)
    symbol = F.coalesce(F.nullif("_shown", F.lit("")), F.concat(F.lit("<"), a("type"), F.lit(">")))
    out = F.when(kind == "gap", gap_text(a("reason"), a("quantity"), a("unit"), a("precision"), physical, F.col("_doubtful"))).when(kind == "space", F.repeat(signs[space], n))
    return out.when(kind == "fraction", fraction(F.coalesce("_said", F.lit("")))).when(kind == "meter", F.concat(F.lit("["), "_pattern", F.lit("]"))).when(kind == "symbol", symbol)


def ruled(n: DataFrame, rules: Sequence[Sequence]) -> DataFrame:
    """Add each view's action, marks before and marks after: those of the first rule of each slot that holds."""
    slots = sorted({r[1] for r in rules})
    of = {slot: [r for r in rules if r[1] == slot] for slot in slots}
    cases = {slot: " ".join(f"WHEN {test_of(r[0], r[2])} THEN {i}" for i, r in enumerate(of[slot], 1)) for slot in slots}
    n, said = n.withColumns({f"_rule{slot}": F.expr(f"CASE {cases[slot]} END") for slot in slots}), {}
    for v, view in enumerate(VIEWS):
        at = lambda slot, part: f"coalesce(try_element_at(array({', '.join(quoted(part(r[3 + v])) for r in of[slot])}), _rule{slot}), '')"  # noqa: E731, B023
        do = ", ".join(f"nullif({at(slot, lambda x: '' if '|' in x else x)}, '')" for slot in slots)
        before = ", ".join(at(slot, lambda x: x.split("|")[0] if "|" in x else "") for slot in slots)
        after = ", ".join(at(slot, lambda x: x.split("|")[1] if "|" in x else "") for slot in reversed(slots))
        said |= {f"_do_{view}": F.expr(f"coalesce({do}, 'show')"), f"_a_{view}": F.expr(f"concat({before})"), f"_z_{view}": F.expr(f"concat({after})")}
    return n.withColumns(said)


def shown_views(nodes: DataFrame, rules: Sequence[Sequence] | None = None, blocks: Sequence[str] = ("p", "ab", "lg", "l", "list", "item", "head", "div"), symbols: DataFrame | None = None, prosody: DataFrame | None = None, sources: DataFrame | None = None, milestone_spaces: bool = False) -> DataFrame:
    """(doc_id, view, block, kind, text) of each block that has a text.

    ``symbols`` is (name, text) of what ``g`` stands for, ``prosody`` (name, pattern) of metres,
    ``sources`` (doc_id, pre, source) of elements whose language is known. White space is squeezed and
    trimmed, and goes before notes; with ``milestone_spaces`` a milestone stands for one space between
    words and for none where it breaks a word, else spaces around it are as written."""
    n = ruled(with_facts(nodes, symbols, prosody, sources), RULES if rules is None else rules)
    earlier = Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    is_text = F.col("tag") == "#text"
    a_note = F.col("tag") == "note"
    place = F.when(a_note, NOTE).when(F.col("tag").isin(*MILESTONES), F.when(F.coalesce(to_boolean(attr(F.col("attrs"), "break"), True), F.lit(True)), BETWEEN).otherwise(WITHIN)).otherwise("")
    shut = lambda view: F.max(F.when(F.col(f"_do_{view}").isin("drop", *WRITTEN), F.col("post"))).over(earlier) > F.col("post")
    n, edges = n.withColumns({f"_hidden_{view}": F.coalesce(shut(view), F.lit(False)) for view in VIEWS}), {}
    for view in VIEWS:
        do = F.col(f"_do_{view}")
        writes = do.isin(*WRITTEN)
        start = F.when(is_text, F.when(do == "show", F.col("text"))).when(writes, written(do, view == "physical")).when(do == "drop", F.when(a_note, NOTE)).otherwise(F.concat(F.col(f"_a_{view}"), place))
        edges |= {f"_start_{view}": F.when(~F.col(f"_hidden_{view}"), start), f"_stop_{view}": F.when(~F.col(f"_hidden_{view}") & (do == "show"), F.col(f"_z_{view}"))}
    n = n.withColumns(edges)
    around = F.filter(F.arrays_zip(F.col("names").alias("tag"), F.col("path").alias("pre")), lambda x: x["tag"].isin(*blocks))
    n = n.where(is_text | ~F.col("tag").startswith("#")).withColumn("_block", F.try_element_at(around, F.lit(-1)))
    event = lambda t, part, shift: F.struct(F.col(t).alias("t"), (F.lit(0) if part == "start" else F.lit(1)).alias("last"), shift.alias("shift"), *[F.col(f"_{part}_{v}").alias(v) for v in VIEWS])
    both = F.array(event("_t", "start", F.col("_shift")), event("_end", "stop", -F.col("_shift")))
    e = n.select("doc_id", F.coalesce("_block.pre", F.lit(0)).alias("block"), F.coalesce("_block.tag", F.lit("p")).alias("kind"), F.explode(both).alias("e")).select("doc_id", "block", "kind", "e.*")
    said = F.coalesce(*[F.nullif(F.col(v), F.lit("")) for v in VIEWS]).isNotNull()
    e = e.where(said | (F.col("shift") != 0))
    order = Window.partitionBy("doc_id").orderBy("t", "last")
    # an element's own end still stands where the element does
    moved = F.sum("shift").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.when(F.col("last") == 1, F.col("shift")).otherwise(0)
    e = e.withColumn("t", F.col("t") + moved)
    parts = F.array_sort(F.collect_list(F.struct("t", "last", *VIEWS)))
    joined = e.groupBy("doc_id", "block", "kind").agg(parts.alias("parts"))
    texts = [F.struct(F.lit(v).alias("view"), F.array_join(F.transform("parts", lambda x: F.coalesce(x[v], F.lit(""))), "").alias("text")) for v in VIEWS]  # noqa: B023
    out = joined.select("doc_id", "block", "kind", F.explode(F.array(*texts)).alias("x")).select("doc_id", "x.view", "block", "kind", "x.text")
    text = F.regexp_replace("text", rf"\s*{NOTE}", "")
    text = F.regexp_replace(F.regexp_replace(text, rf"\s*{WITHIN}\s*", ""), rf"\s*{BETWEEN}\s*", " ") if milestone_spaces else F.translate(text, BETWEEN + WITHIN, "")
    text = F.regexp_replace(squeeze(text), r"\s+(?=[⁰¹²³⁴-⁹]+)", "")
    return out.withColumn("text", text).where("text <> ''").select("doc_id", "view", "block", "kind", "text")


def below(nodes: DataFrame, roots: Column) -> DataFrame:
    """Nodes for which the condition holds, and all below them."""
    w = Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    return nodes.withColumn("_below", F.max(F.when(roots, F.col("post"))).over(w) >= F.col("post")).where("_below").drop("_below")
