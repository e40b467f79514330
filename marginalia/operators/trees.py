"""Rewriting of documents as streams of events: blocks are segmented, spaces settled.

A node opens at 2 * pre - 1 - depth and closes at 2 * post + depth on one clock of its
document, so a node table becomes a stream of opens, closes and texts by arithmetic
alone. Rewriting adds, drops or moves events; window functions over a document's
stream tell what is open, which runs belong together and what is empty; ``numbered``
counts the events anew into a node table. Nothing is joined on ranges, and all windows
of a pass share one shuffle by document. Comments and instructions are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.sources.keep import kept

# What elements are to the segmentation; all others are inline.
KINDS = {
    "p": "para", "ab": "para", "lg": "verse", "l": "line", "list": "list", "item": "item", "quote": "quote", "head": "head", "div": "div", "note": "note",
    "TEI": "frame", "text": "frame", "front": "frame", "body": "frame", "back": "frame", "group": "frame", "teiHeader": "header",
}
# Elements that are no container of text; the first five turn pages, lines and cells.
MILESTONES = ("pb", "lb", "cb", "gb", "milestone")
LEAVES = (*MILESTONES, "gap", "space", "g", "ptr", "anchor", "graphic")
#: Blocks may not stand in these.
TIGHT = ("inline", "note", "para", "verse", "line")
#: Loose inlines of these become paragraphs.
LOOSE = ("div", "item", "quote", "note")
#: Between two ticks of the clock there is room for what is put in.
ROOM = 16


def kind_of(tag: Column, within: Column | None) -> Column:
    """What an element is, by its tag and that of the element around it; without one it is the outermost and at least a frame."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), tag)
    if within is None:
        return F.when(known.isin("inline", "note") | known.isNull(), "frame").otherwise(known)
    return F.when((tag == "label") & (within == "list"), "item").otherwise(F.coalesce(known, F.lit("inline")))


def opened(tag: str = "tag") -> Column:
    return (2 * F.col("pre") - 1 - F.col("depth")).cast("long") * ROOM


def closed() -> Column:
    return (2 * F.col("post") + F.col("depth")).cast("long") * ROOM


def own_kind() -> Column:
    return F.when(F.size("names") == 0, kind_of(F.col("tag"), None)).otherwise(kind_of(F.col("tag"), F.try_element_at("names", F.lit(-1))))


def events(nodes: DataFrame) -> DataFrame:
    """(doc_id, t, what, tag, attrs, text, line, col, kind, until): what is open, close or text; ``until`` is when an element closes."""
    n = nodes.where(~F.col("tag").isin("#comment", "#instruction", "#error")).withColumn("kind", F.when(F.col("tag") == "#text", "text").otherwise(own_kind()))
    event = lambda t, what: F.struct(t.alias("t"), F.lit(what).alias("what"))
    made = F.when(F.col("tag") == "#text", F.array(event(opened(), "text"))).otherwise(F.array(event(opened(), "open"), event(closed(), "close")))
    return n.withColumn("until", closed()).select("doc_id", F.explode(made).alias("e"), "tag", "attrs", "text", "line", "col", "kind", "until").select("doc_id", "e.t", "e.what", "tag", "attrs", "text", "line", "col", "kind", "until")


def stream(*by: str) -> Window:
    return Window.partitionBy("doc_id", *by).orderBy("t")


def so_far(c: Column, *by: str, itself: bool = True) -> Column:
    """A sum over the events before, and this one if asked for."""
    w = stream(*by).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    return F.coalesce(F.sum(c).over(w), F.lit(0))


def levelled(found: DataFrame) -> DataFrame:
    """Add ``depth``: how many elements are open around a node, or around the one that an event opens or closes."""
    step = F.when(F.col("what") == "open", 1).when(F.col("what") == "close", -1).otherwise(0)
    return found.withColumn("depth", so_far(step) - F.when(F.col("what") == "open", 1).otherwise(0))


def without_empty(found: DataFrame) -> DataFrame:
    """Events without elements that hold nothing: no text but white space, and no leaf. What stands under a heading counts only inside that heading.

    Leaves, frames and what is in a header stay."""
    leveled = levelled(found)
    heading = F.col("kind") == "head"
    heads = so_far(F.when(heading & (F.col("what") == "open"), 1).when(heading & (F.col("what") == "close"), -1).otherwise(0))
    leaf = ((F.col("what") == "text") & F.col("text").rlike(r"\S")) | ((F.col("what") == "open") & F.col("tag").isin(*LEAVES))
    counted = leveled.withColumn("_head", (heads > 0) | heading).withColumn("_leaf", leaf.cast("int"))
    counted = counted.withColumn("_all", so_far(F.col("_leaf"))).withColumn("_body", so_far(F.when(F.col("_head"), 0).otherwise(F.col("_leaf"))))
    counted = counted.withColumn("_n", F.when(F.col("_head"), F.col("_all")).otherwise(F.col("_body")))
    # opens and closes of one level take turns
    element = F.col("what") != "text"
    pairs = Window.partitionBy("doc_id", element, "depth").orderBy("t")
    held = F.when(F.col("what") == "open", F.lead("_n").over(pairs) - F.col("_n")).when(F.col("what") == "close", F.col("_n") - F.lag("_n").over(pairs))
    gone = element & (held == 0) & ~F.col("tag").isin(*LEAVES) & ~F.col("kind").isin("frame", "header")
    end = F.when(F.col("what") == "open", F.lead("t").over(pairs))
    marked = counted.withColumn("_gone", gone).withColumn("_end", end)
    # a division of headings alone goes with all that is in it; a space in an empty inline stays
    inside = F.coalesce(F.max(F.when(F.col("_gone") & (F.col("kind") != "inline"), F.col("_end"))).over(stream().rowsBetween(Window.unboundedPreceding, -1)) > F.col("t"), F.lit(False))
    return marked.withColumn("_inside", inside).where("NOT _gone AND NOT _inside").select(*found.columns)


def dealt(df: DataFrame, parts: int | None) -> DataFrame:
    """By document, to this many partitions; by default to the session's number where a window asks for it."""
    return df.repartition(parts, "doc_id") if parts else df


def numbered(found: DataFrame, parts: int | None = None) -> DataFrame:
    """The node table of a stream: texts that have come together are one, all numbers and paths are new."""
    text = F.col("what") == "text"
    joined = found.withColumn("_run", so_far(F.when(text, 0).otherwise(1)))
    w = stream("_run").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(text, F.struct("t", "text"))).over(w)), lambda x: x["text"]), "")
    first = F.min(F.when(text, F.col("t"))).over(w)
    joined = joined.withColumn("text", F.when(text, whole)).withColumn("_first", first).where(~text | (F.col("t") == F.col("_first")))
    placed = levelled(joined).withColumn("pre", so_far(F.when(F.col("what") == "close", 0).otherwise(1)).cast("int"))
    ends = so_far(F.when(F.col("what") == "open", 0).otherwise(1)).cast("int")
    pairs = Window.partitionBy("doc_id", F.col("what") != "text", "depth").orderBy("t")
    placed = placed.withColumn("_ends", ends).withColumn("post", F.when(F.col("what") == "open", F.lead("_ends").over(pairs)).otherwise(F.col("_ends")))
    placed = kept(placed.where("what <> 'close'").select("doc_id", "t", "what", "tag", "attrs", "text", "line", "col", F.col("depth").cast("int").alias("depth"), "pre", "post"))
    deepest = placed.agg(F.max("depth")).first()[0] or 0
    placed = dealt(placed, parts)
    # the last element opened on a level is the one around all that is deeper
    order = Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    up = [F.last(F.when((F.col("what") == "open") & (F.col("depth") == k), F.struct("pre", "tag")), ignorenulls=True).over(order) for k in range(deepest)]
    around = F.slice(F.array(*up), F.lit(1), F.col("depth")) if up else F.array().cast("array<struct<pre:int,tag:string>>")
    out = placed.withColumn("_around", around)
    return out.select("doc_id", "pre", "post", "depth", F.try_element_at("_around", F.lit(-1))["pre"].alias("parent"), F.transform("_around", lambda x: x["pre"]).alias("path"), "tag", "attrs", "text", "line", "col", F.transform("_around", lambda x: x["tag"]).alias("names"))


# blocks


def descended(state: Column, kind: Column, pre: Column) -> Column:
    """What holds inside an element of a kind, given what holds around it.

    ``eff`` is the kind of the innermost element that stays, ``outer`` of the one around
    that, ``raw`` of the innermost element of the source, and ``gone`` whether that is dissolved."""
    lifted = kind.isin("list", "quote") & (state["raw"] == "para")
    out = lifted & ~state["gone"]
    up, up_pre = F.when(out, state["outer"]).otherwise(state["eff"]), F.when(out, state["outer_pre"]).otherwise(state["eff_pre"])
    block = kind.isin("div", "para", "head", "verse", "quote", "list") & up.isin(*TIGHT) & ~((kind == "head") & (up == "verse"))
    part = ((kind == "line") & (state["raw"] == "verse") | (kind == "item") & (state["raw"] == "list")) & state["gone"]
    gone = F.when(state["header"], False).otherwise(block | part)
    return F.struct(
        F.when(gone, up).otherwise(kind).alias("eff"), F.when(gone, up_pre).otherwise(pre).alias("eff_pre"),
        F.when(gone, state["outer"]).otherwise(up).alias("outer"), F.when(gone, state["outer_pre"]).otherwise(up_pre).alias("outer_pre"),
        kind.alias("raw"), gone.alias("gone"), (state["header"] | (kind == "header")).alias("header"), up.alias("up"), up_pre.alias("up_pre"), (out & ~state["header"]).alias("lifted"),
    )


def placed_in(nodes: DataFrame) -> DataFrame:
    """Add ``kind`` and ``at``: what becomes of each node and of what is around it, from its path alone."""
    kinds = F.transform("names", lambda x, i: F.when(i == 0, kind_of(x, None)).otherwise(kind_of(x, F.try_element_at("names", i))))
    start = F.struct(F.lit("frame").alias("eff"), F.lit(0).alias("eff_pre"), F.lit("frame").alias("outer"), F.lit(0).alias("outer_pre"), F.lit("frame").alias("raw"), F.lit(False).alias("gone"), F.lit(False).alias("header"), F.lit("frame").alias("up"), F.lit(0).alias("up_pre"), F.lit(False).alias("lifted"))
    over = F.aggregate(F.arrays_zip(kinds.alias("kind"), F.col("path").alias("pre")), start, lambda s, x: descended(s, x["kind"], x["pre"]))
    own = F.when(F.col("tag") == "#text", "text").otherwise(own_kind())
    return nodes.withColumn("kind", own).withColumn("_over", over).withColumn("at", descended(F.col("_over"), F.col("kind"), F.col("pre"))).withColumn("_raw_gone", F.col("_over.gone")).drop("_over")


def segment(nodes: DataFrame, parts: int | None = None) -> DataFrame:
    """The node table with its blocks in order.

    Lists and quotes directly in a paragraph stand beside what is left of it. Blocks inside
    inlines, notes, paragraphs or verses are dissolved, their headings go, their entries and
    lines are set off by spaces. Loose inlines of divisions, entries, quotes and notes become
    paragraphs, those of verses lines. Where a division has divisions, the blocks between
    them stand in divisions with ``phantom="true"``. What is empty then is left out, also
    divisions and verses of a heading alone. ``parts`` is the number of partitions to work in."""
    n = placed_in(dealt(nodes, parts).where(~F.col("tag").isin("#comment", "#instruction", "#error")))
    blank = (F.col("tag") == "#text") & ~F.col("text").rlike(r"\S")
    n = n.withColumn("_blank", blank)
    before = Window.partitionBy("doc_id", "parent").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum((~F.col("_blank")).cast("int")).over(before), F.lit(0)) == 0
    n = n.withColumn("_drop", (F.col("kind") == "head") & F.col("_raw_gone") & F.element_at(F.concat(F.array(F.lit("")), "names"), -1).isin("div", "lg") & first)
    earlier = Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("_in_dropped", F.coalesce(F.max(F.when(F.col("_drop"), F.col("post"))).over(earlier) > F.col("post"), F.lit(False))).where("NOT _drop AND NOT _in_dropped")
    # the innermost note around a node has its own runs
    notes = F.filter(F.arrays_zip(F.col("names").alias("tag"), F.col("path").alias("pre")), lambda x: x["tag"] == "note")
    n = n.withColumn("note", F.coalesce(F.try_element_at(notes, F.lit(-1))["pre"], F.lit(0)))
    # a paragraph that a block is lifted out of closes before it and opens again behind it
    para = nodes.where(F.col("tag").isin("p", "ab")).select(F.col("doc_id").alias("_pdoc"), F.col("pre").alias("_p"), F.col("tag").alias("_ptag"), F.col("attrs").alias("_pattrs"))
    # nodes that nothing is lifted for ask for no row; a key of their own spreads them
    n = n.withColumn("_at", F.when(F.col("at.lifted"), F.col("parent")).otherwise(-F.col("pre")))
    n = n.join(para, (F.col("doc_id") == F.col("_pdoc")) & (F.col("_at") == F.col("_p")), "left")
    # plain columns: the optimizer loses parts of a struct that is dealt
    n = dealt(n.withColumns({f"_at_{c}": F.col(f"at.{c}") for c in ("gone", "lifted", "up", "up_pre", "header")}).drop("at"), parts)
    t, c, gone = opened(), closed(), F.col("_at_gone")

    def event(t: Column, what: str, tag: Column, attrs: Column, text: Column, kind: Column, until: Column) -> Column:
        return F.struct(t.alias("t"), F.lit(what).alias("what"), tag.alias("tag"), attrs.alias("attrs"), text.alias("text"), kind.alias("kind"), until.alias("until"))

    no_text, no_attrs, never = F.lit(None).cast("string"), F.create_map().cast("map<string,string>"), F.lit(None).cast("long")
    own = lambda t, what: event(t, what, F.col("tag"), F.col("attrs"), no_text, F.col("kind"), c)
    said = lambda t, text: event(t, "text", F.lit("#text"), no_attrs, text, F.lit("text"), never)
    again = lambda t, what: event(t, what, F.col("_ptag"), F.col("_pattrs"), no_text, F.lit("para"), never)
    made = F.when(F.col("tag") == "#text", F.array(said(t, F.col("text")))).when(gone & F.col("kind").isin("line", "item"), F.array(said(t, F.lit(" ")), said(c, F.lit(" "))))
    made = made.when(gone, F.filter(F.array(said(t, F.lit(""))), lambda x: F.lit(False))).when(F.col("_at_lifted"), F.array(again(t - 4, "close"), own(t, "open"), own(c, "close"), again(c + 4, "open"))).otherwise(F.array(own(t, "open"), own(c, "close")))
    e = n.select("doc_id", "note", F.col("_at_up").alias("up"), F.col("_at_up_pre").alias("up_pre"), F.col("_at_header").alias("header"), "line", "col", F.explode(made).alias("e")).select("doc_id", "note", "up", "up_pre", "header", "line", "col", "e.*")
    # runs of inlines between two blocks
    inline = F.col("kind").isin("text", "inline", "note") & ~((F.col("up") == "verse") & F.col("tag").isin(*MILESTONES))
    e = e.withColumn("_inline", inline).withColumn("_run", so_far((~F.col("_inline")).cast("int"), "note"))
    run = Window.partitionBy("doc_id", "note", "_run", "_inline")
    solid = F.col("_inline") & ~((F.col("what") == "text") & ~F.col("text").rlike(r"\S"))
    e = e.withColumn("_a", F.min(F.when(solid, F.col("t"))).over(run)).withColumn("_z", F.max(F.when(solid, F.col("t"))).over(run)).withColumn("_in", F.min_by("up", "t").over(run))
    wrap = F.when(F.col("header"), None).when(F.col("_inline") & F.col("_in").isin(*LOOSE), "p").when(F.col("_inline") & (F.col("_in") == "verse"), "l")
    e = e.withColumn("_wrap", wrap).withColumn("_owner", F.when(F.col("_inline"), F.min_by("up_pre", "t").over(run)))
    loose = F.col("_inline") & F.coalesce(F.col("_a").isNull() | (F.col("t") < F.col("_a")) | (F.col("t") > F.col("_z")), F.lit(False))
    e = e.where(~(loose & (F.col("_wrap").isNotNull() | F.col("_in").isin("list", "frame"))))
    wrapper = lambda t, what, until: event(t, what, F.col("_wrap"), no_attrs, no_text, F.when(F.col("_wrap") == "l", "line").otherwise("para"), until)
    this = event(F.col("t"), "", F.col("tag"), F.col("attrs"), F.col("text"), F.col("kind"), F.col("until")).withField("what", F.col("what"))
    starts, ends = F.col("_wrap").isNotNull() & (F.col("t") == F.col("_a")), F.col("_wrap").isNotNull() & (F.col("t") == F.col("_z"))
    some = F.concat(F.when(starts, F.array(wrapper(F.col("_a") - 2, "open", F.col("_z") + 2))).otherwise(F.array()), F.array(this), F.when(ends, F.array(wrapper(F.col("_z") + 2, "close", never))).otherwise(F.array()))
    e = e.select("doc_id", "up", "up_pre", "header", "_in", "_owner", "line", "col", F.explode(some).alias("e"))
    new = F.col("e.tag").isin("p", "l") & F.col("e.until").isNotNull() & F.col("_owner").isNotNull()
    e = e.select("doc_id", F.when(new, F.col("_in")).otherwise(F.col("up")).alias("up"), F.when(new, F.col("_owner")).otherwise(F.col("up_pre")).alias("up_pre"), "header", "line", "col", "e.*")
    # blocks between divisions
    unit = (F.col("what") == "open") & F.col("until").isNotNull() & (F.col("up") == "div") & F.col("kind").isin("para", "quote", "verse", "list", "div") & ~F.col("header")
    e = e.withColumn("_unit", unit)
    div = F.col("_unit") & (F.col("kind") == "div")
    e = e.withColumn("_part", so_far(div.cast("int"), "_unit", "up_pre"))
    group = Window.partitionBy("doc_id", "_unit", "up_pre", "_part")
    block = F.col("_unit") & ~div
    e = e.withColumn("_any", F.max(div.cast("int")).over(Window.partitionBy("doc_id", "_unit", "up_pre")) == 1)
    e = e.withColumn("_a", F.min(F.when(block, F.col("t"))).over(group)).withColumn("_z", F.max(F.when(block, F.col("until"))).over(group))
    phantom = lambda t, what: event(t, what, F.lit("div"), F.create_map(F.lit("phantom"), F.lit("true")), no_text, F.lit("div"), never)
    covers = block & F.col("_any") & (F.col("t") == F.col("_a"))
    attrs = F.when((F.col("what") == "open") & (F.col("tag") == "div"), F.map_concat("attrs", F.create_map(F.lit("phantom"), F.lit("false")))).otherwise(F.col("attrs"))
    plain = ~F.array_contains(F.map_keys("attrs"), "phantom")
    e = e.withColumn("attrs", F.when(plain, attrs).otherwise(F.col("attrs")))
    some = F.concat(F.array(this), F.when(covers, F.array(phantom(F.col("_a") - 6, "open"), phantom(F.col("_z") + 6, "close"))).otherwise(F.array()))
    e = e.select("doc_id", "line", "col", F.explode(some).alias("e")).select("doc_id", "e.t", "e.what", "e.tag", "e.attrs", "e.text", "line", "col", "e.kind", "e.until")
    return numbered(without_empty(e), parts)


# spaces


def settle_spaces(nodes: DataFrame) -> DataFrame:
    """The node table with its white space in place.

    Spaces are squeezed. Those at the edges of blocks, beside milestones and before
    notes go. A space at an inline's edge moves out to where the elements on its two sides
    meet: behind all that end there and before all that begin. Empty elements are left out."""
    e = without_empty(events(nodes))
    blank = (F.col("what") == "text") & ~F.col("text").rlike(r"\S")
    note, leaf = F.col("kind") == "note", F.col("tag").isin(*LEAVES)
    mile = F.col("tag").isin(*MILESTONES)
    role = F.when(blank, "space").when(F.col("what") == "text", "text").when(leaf & (F.col("what") == "close"), "none").when(mile, "edge").when(leaf, "leaf")
    role = role.when(note & (F.col("what") == "open"), "note").when(note, "after").when(F.col("kind") != "inline", "edge").when(F.col("what") == "open", "in").otherwise("out")
    e = e.withColumn("role", role)
    solid = F.col("role").isin("text", "leaf", "edge", "note", "after")
    lead, trail = F.col("text").rlike(r"^\s"), F.col("text").rlike(r"\s$")
    text = F.col("role") == "text"
    e = e.withColumn("_solid", solid).withColumn("_before", text & lead).withColumn("_behind", text & trail).withColumn("_gap", so_far(solid.cast("int")))
    following = Window.partitionBy("doc_id").orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("_next", F.last(F.when(F.col("_solid"), F.struct("role", "_before", "t")), ignorenulls=True).over(following))
    gap = Window.partitionBy("doc_id", "_gap")
    opens, closes = F.col("role") == "in", F.col("role") == "out"
    e = e.withColumn("_opens", F.min(F.when(opens, F.col("t"))).over(gap)).withColumn("_last_open", F.max(F.when(opens, F.col("t"))).over(gap)).withColumn("_closes", F.count_if(closes).over(gap))
    to_note = F.col("_next.role") == "note"
    # a space right before a note, inside what opened before it, is the note's
    loose = (F.col("role") == "space") & ~(to_note & F.coalesce(F.col("t") > F.col("_last_open"), F.lit(False)))
    spaced = F.max(loose | F.col("_behind") | F.coalesce(F.col("_next._before"), F.lit(False))).over(gap)
    fits = F.col("role").isin("text", "leaf", "after") & (F.col("_next.role").isin("text", "leaf") | (to_note & F.col("_opens").isNotNull()))
    e = e.withColumn("_space", F.col("_solid") & F.coalesce(spaced & fits, F.lit(False)))
    where = F.when(text & (F.col("_closes") == 0), "behind").when((F.col("_next.role") == "text") & F.col("_opens").isNull(), "before").otherwise("between")
    e = e.withColumn("_where", F.when(F.col("_space"), where))
    said = F.last(F.when(F.col("_solid"), F.coalesce("_where", F.lit(""))), ignorenulls=True).over(stream().rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("_said", said)
    squeezed = F.trim(F.regexp_replace("text", r"\s+", " "))
    shown = F.concat(F.when(F.col("_said") == "before", " ").otherwise(""), squeezed, F.when(F.col("_where") == "behind", " ").otherwise(""))
    e = e.where("role <> 'space'").withColumn("text", F.when(text, shown).otherwise(F.col("text")))
    own = F.struct(*[F.col(c) for c in ("t", "what", "tag", "attrs", "text", "kind", "until")])
    put = own.withField("t", F.coalesce("_opens", "_next.t") - 1).withField("what", F.lit("text")).withField("tag", F.lit("#text")).withField("attrs", F.create_map().cast("map<string,string>")).withField("text", F.lit(" ")).withField("kind", F.lit("text"))
    some = F.concat(F.array(own), F.when(F.col("_where") == "between", F.array(put)).otherwise(F.array()))
    e = e.select("doc_id", "line", "col", F.explode(some).alias("e")).select("doc_id", "e.t", "e.what", "e.tag", "e.attrs", "e.text", "line", "col", "e.kind", "e.until")
    return numbered(e)


def markup(nodes: DataFrame) -> DataFrame:
    """(doc_id, xml): documents written out; attributes in the order of their names."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    e = events(nodes)
    attrs = F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda x: F.concat(F.lit(" "), x["key"], F.lit('="'), escape(x["value"]), F.lit('"'))), "")
    shown = F.when(F.col("what") == "text", escape(F.col("text"))).when(F.col("what") == "open", F.concat(F.lit("<"), "tag", attrs, F.lit(">"))).otherwise(F.concat(F.lit("</"), "tag", F.lit(">")))
    rows = F.array_sort(F.collect_list(F.struct("t", shown.alias("x"))))
    return e.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["x"]), "").alias("xml"))
