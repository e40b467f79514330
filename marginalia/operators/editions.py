"""Editions: languages, the three views of a text, blocks, lines, lists and notes.

Views come from the rule table of ``marks``; blocks and spaces are put in order by ``trees``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions.bibliography import ITEM_TYPES
from marginalia.functions.text import clean_passage, is_meter, meter_pattern, squeeze, to_boolean
from marginalia.operators import marks
from marginalia.operators.axes import around, attr, axis, elements, nearest_ancestor, text_of
from marginalia.operators.catalog import display_names, resolve_code, resolve_reference
from marginalia.operators.similarity import in_sequence
from marginalia.operators.windows import break_from_previous, page_line_cell

# Elements whose language matters, those that are in some source language, and block elements.
SENSITIVE = ("div", "note", "p", "ab", "lg", "q", "head", "quote", "label", "foreign", "seg", "lem", "rdg")
SOURCE_TAGS = ("foreign", "lem", "rdg")
BLOCKS = ("p", "ab", "lg", "l", "list", "item", "head", "div")
MILESTONES = ("pb", "lb", "milestone", "fw")
# Language and script of a text, and those that stand for any source language or script.
DEFAULT_LANGUAGE, DEFAULT_SCRIPT, SOURCE_OTHER = "eng", "latin", "source_other"
#: What a search goes through: the editor's readings, without notes and headings.
SEARCH_DROPS = ("note", "head", "app", "listApp", "teiHeader", "sic", "orig", "fw", "display", "milestone", "pb", "lb")
PADA_DROPS = ("rdg", "note", "milestone", "pb", "lb", "gap", "del", "label", "sic", "orig")


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules of views as a table, to be read or extended."""
    return spark.createDataFrame(marks.RULES, marks.RULE)


def assign_language(nodes: DataFrame, langs: DataFrame, scripts: DataFrame | None = None) -> DataFrame:
    """(doc_id, pre, tag, lang, script, source) of language-sensitive elements.

    ``langs`` and ``scripts`` are (code, id, source): what stands before the hyphen of
    ``lang``, or the last ``class:`` word of ``rendition``, is looked up as a code or
    as code_other, and counts for nothing if it is unknown. foreign, lem, rdg and
    edition divisions are in a source language: their own if it is one, else any; the
    same holds for their scripts. All others have their own, else what is above them;
    one that has a language but no script takes the default script when it turns from a
    source language to a study one, and any source script when it turns back."""
    spark = nodes.sparkSession
    scripts = scripts if scripts is not None else spark.createDataFrame([], "code string, id string, source boolean")
    source_of = lambda df: df.select("id", F.coalesce("source", F.lit(False)).alias("source")).groupBy("id").agg(F.max("source").alias("source"))

    def found(df: DataFrame, code: Column, known: DataFrame, name: str) -> DataFrame:
        coded = resolve_code(df.withColumn("code", code), known.select("code", "id")).withColumnRenamed("id", name)
        return coded.join(source_of(known).withColumnsRenamed({"id": name, "source": f"{name}_source"}), name, "left").drop("code")

    own = elements(nodes).select("doc_id", "pre", "parent", "path", "tag", "attrs")
    own = found(own, F.regexp_extract(attr(F.col("attrs"), "lang"), "^[^-]*", 0), langs, "lang")
    last_class = F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(attr(F.col("attrs"), "rendition"), F.lit(r"(?:^|\s)class:(\S+)"), 1)), -1)
    own = found(own, F.nullif(last_class, F.lit("undetermined")), scripts, "script")
    always = F.col("tag").isin(*SOURCE_TAGS) | ((F.col("tag") == "div") & (attr(F.col("attrs"), "type") == "edition"))
    either = F.col("lang").isNotNull() | F.col("script").isNotNull()
    kept = lambda c: F.when(always, F.when(F.coalesce(F.col(f"{c}_source"), F.lit(False)), F.col(c)).otherwise(F.lit(SOURCE_OTHER))).when(F.col("tag").isin(*SENSITIVE), F.col(c))
    own = own.withColumns({"always": always, "lang": kept("lang"), "script": kept("script"), "source": F.when(always, True).when(F.col("tag").isin(*SENSITIVE) & either & F.col("lang").isNotNull(), F.coalesce("lang_source", F.lit(False)))})
    own = own.select("doc_id", "pre", "parent", "path", "tag", "always", "lang", "script", "source")
    # what holds at an element is what the deepest element on its path that says so says
    says = own.where("lang IS NOT NULL").select("doc_id", F.col("pre").alias("up"), F.struct("lang", "source").alias("said"))
    near = around(own.select("doc_id", "pre", "path"), "up", True).join(says, ["doc_id", "up"]).groupBy("doc_id", "pre").agg(F.max_by("said", "up").alias("said"))
    placed = own.drop("source").withColumnRenamed("lang", "own_lang").join(near, ["doc_id", "pre"], "left")
    placed = placed.select("doc_id", "pre", "parent", "path", "tag", "always", "own_lang", "script", F.coalesce("said.lang", F.lit(DEFAULT_LANGUAGE)).alias("lang"), F.coalesce("said.source", F.lit(False)).alias("source"))
    above = placed.select("doc_id", F.col("pre").alias("parent"), F.col("source").alias("source_above"))
    placed = placed.join(above, ["doc_id", "parent"], "left").withColumn("source_above", F.coalesce("source_above", F.lit(False)))
    turned = F.when(F.col("own_lang").isNotNull() & F.col("source_above") & ~F.col("source"), DEFAULT_SCRIPT).when(F.col("own_lang").isNotNull() & ~F.col("source_above") & F.col("source"), SOURCE_OTHER)
    placed = placed.withColumn("set", F.coalesce("script", turned))
    sets = placed.where(F.col("set").isNotNull()).select("doc_id", F.col("pre").alias("up"), "set")
    near = around(placed.select("doc_id", "pre", "path"), "up", True).join(sets, ["doc_id", "up"]).groupBy("doc_id", "pre").agg(F.max_by("set", "up").alias("near"))
    out = placed.where(F.col("tag").isin(*SENSITIVE)).join(near, ["doc_id", "pre"], "left")
    return out.select("doc_id", "pre", "tag", "lang", F.coalesce("near", F.lit(DEFAULT_SCRIPT)).alias("script"), "source")


def bubble_up(nodes: DataFrame, langs: DataFrame) -> DataFrame:
    """(doc_id, pre, lang): an element whose texts below, headings aside, agree on a language has that language.

    ``langs`` is (doc_id, pre, lang) of elements; a text has its nearest one's."""
    heads = nodes.where("tag = 'head'").select("doc_id", F.col("pre").alias("up"), F.lit(True).alias("head"))
    owner = langs.select("doc_id", F.col("pre").alias("up"), "lang")
    text = nodes.where("tag = '#text'").where(F.col("text").rlike(r"\S")).select("doc_id", "pre", "path")
    over = around(text).join(owner, ["doc_id", "up"], "left").join(heads, ["doc_id", "up"], "left")
    said = over.groupBy("doc_id", "pre").agg(F.max_by("lang", F.when(F.col("lang").isNotNull(), F.col("up"))).alias("said"), F.max(F.when(F.col("head"), F.col("up"))).alias("head"))
    # a heading counts for itself and what is in it, not for what is around it
    votes = over.select("doc_id", "pre", "up").join(said, ["doc_id", "pre"]).where(F.col("head").isNull() | (F.col("up") >= F.col("head")))
    under = votes.groupBy("doc_id", F.col("up").alias("pre")).agg(F.min("said").alias("a"), F.max("said").alias("b"))
    return langs.join(under, ["doc_id", "pre"], "left").select("doc_id", "pre", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("lang")).alias("lang"))


def finish_language(nodes: DataFrame, langs: DataFrame) -> DataFrame:
    """(doc_id, pre, tag, lang): milestones are zxx; others keep a language only where text stands directly in them."""
    direct = nodes.where("tag = '#text'").where(F.col("text").rlike(r"\S")).select("doc_id", F.col("parent").alias("pre")).distinct().withColumn("_has", F.lit(True))
    out = elements(nodes).select("doc_id", "pre", "tag").join(langs.select("doc_id", "pre", "lang"), ["doc_id", "pre"], "left").join(direct, ["doc_id", "pre"], "left")
    return out.select("doc_id", "pre", "tag", F.when(F.col("tag").isin(*MILESTONES), "zxx").when(F.col("_has"), F.col("lang")).alias("lang"))


def without_subtrees(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that are neither one of the roots (doc_id, pre) nor below one."""
    gone = around(nodes.select("doc_id", "pre", "path"), "up", True).join(roots.select("doc_id", F.col("pre").alias("up")), ["doc_id", "up"], "left_semi").select("doc_id", "pre").distinct()
    return nodes.join(gone, ["doc_id", "pre"], "left_anti").select(*nodes.columns)


def block_of(nodes: DataFrame) -> DataFrame:
    """(doc_id, at, block, kind): the innermost block element around each text; loose text is in block 0."""
    blocks = nodes.where(F.col("tag").isin(*BLOCKS)).select("doc_id", F.col("pre").alias("up"), F.col("tag").alias("_tag"))
    text = nodes.where("tag = '#text'").select("doc_id", F.col("pre").alias("at"), F.explode_outer("path").alias("up"))
    found = text.join(blocks, ["doc_id", "up"], "left").withColumn("up", F.when(F.col("_tag").isNotNull(), F.col("up")))
    return found.groupBy("doc_id", "at").agg(F.coalesce(F.max("up"), F.lit(0)).alias("block"), F.coalesce(F.max_by("_tag", "up"), F.lit("p")).alias("kind"))


def edition_views(nodes: DataFrame, rules: DataFrame | None = None, symbols: DataFrame | None = None, **more) -> DataFrame:
    """(doc_id, view, block, kind, text): the physical, logical and full text of each block.

    ``symbols`` is (name, text) of what ``g`` elements stand for; further arguments are those of ``marks.shown_views``."""
    # a rule table has as many rows as there are rules, whatever the corpus
    return marks.shown_views(nodes, [tuple(r) for r in rules.collect()] if rules is not None else None, BLOCKS, symbols, **more)


def normalize_blocks(blocks: DataFrame) -> DataFrame:
    """Squeezed and trimmed block texts; empty blocks go; no space before a note marker."""
    text = F.regexp_replace(squeeze(F.col("text")), r"\s+(?=[⁰¹²³⁴-⁹]+)", "")
    return blocks.withColumn("text", text).where("text <> ''")


def segment_blocks(nodes: DataFrame) -> DataFrame:
    """(doc_id, parent, segment, kind, first, n): children of divisions in runs; loose inlines between blocks are paragraphs of their own."""
    divs = nodes.where("tag = 'div'").select("doc_id", F.col("pre").alias("parent"))
    kids = nodes.join(divs, ["doc_id", "parent"]).where(~((F.col("tag") == "#text") & ~F.col("text").rlike(r"\S")))
    kids = kids.withColumn("_block", F.col("tag").isin(*BLOCKS))
    w = Window.partitionBy("doc_id", "parent").orderBy("pre")
    new = (F.col("_block") | F.coalesce(F.lag("_block").over(w), F.lit(True))).cast("int")
    runs = kids.withColumn("_new", new).withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "parent", "segment").agg(F.when(F.first("_block"), F.min("tag")).otherwise("p").alias("kind"), F.min("pre").alias("first"), F.count("*").alias("n"))


def physical_lines(nodes: DataFrame) -> DataFrame:
    """(doc_id, page, line, text): lines as on the object; a hyphen where the next one goes on in a word (``break="no"``)."""
    placed = page_line_cell(nodes)
    runs_on = placed.where("tag = 'lb'").select("doc_id", "page", "line", (attr(F.col("attrs"), "break") == "no").alias("_no")).groupBy("doc_id", "page", "line").agg(F.max("_no").alias("_no"))
    text = placed.where("tag = '#text'").groupBy("doc_id", "page", "line").agg(squeeze(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pre", "text"))), lambda x: x["text"]), "")).alias("text"))
    both = text.join(runs_on, ["doc_id", "page", "line"], "left")
    after = F.lead("_no").over(Window.partitionBy("doc_id").orderBy("page", "line"))
    return both.withColumn("_after", after).select("doc_id", "page", "line", F.when(F.coalesce("_after", F.lit(False)), F.concat("text", F.lit("-"))).otherwise(F.col("text")).alias("text")).where("text <> ''")


def verse_lines(nodes: DataFrame) -> DataFrame:
    """(doc_id, verse, pre, n, text, break): verse lines; one after an enjambed line continues its word, which ends in a hyphen."""
    runs_on = F.coalesce(to_boolean(attr(F.col("attrs"), "enjamb"), False), F.lit(False))
    lines = nodes.where("tag = 'l'").select("doc_id", F.col("parent").alias("verse"), "pre", attr(F.col("attrs"), "n").alias("n"), runs_on.alias("enjamb"))
    out = break_from_previous(lines, ("doc_id", "verse"), "pre").join(text_of(nodes, "l"), ["doc_id", "pre"], "left")
    text = squeeze(F.coalesce("content", F.lit("")))
    return out.select("doc_id", "verse", "pre", "n", F.when(F.col("enjamb"), F.concat(text, F.lit("-"))).otherwise(text).alias("text"), "break")


def anchor_milestones(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, tag, anchor): for each milestone the first text after it, where it takes effect; null at the end."""
    order = Window.partitionBy("doc_id").orderBy(F.col("pre").desc()).rowsBetween(Window.unboundedPreceding, 0)
    solid = F.when((F.col("tag") == "#text") & F.col("text").rlike(r"\S"), F.col("pre"))
    return nodes.withColumn("anchor", F.last(solid, ignorenulls=True).over(order)).where(F.col("tag").isin(*MILESTONES)).select("doc_id", "pre", "tag", "anchor")


def padas(nodes: DataFrame) -> DataFrame:
    """(doc_id, verse, pre, label, text): lines of verses whose labels run a, b, c …; editors' readings, no notes, a hyphen before enjambed ones."""
    kept = without_subtrees(nodes, nodes.where(F.col("tag").isin(*PADA_DROPS)).select("doc_id", "pre"))
    spaced = kept.withColumn("text", F.when(F.col("tag") == "space", " ").otherwise(F.col("text"))).withColumn("tag", F.when(F.col("tag") == "space", "#text").otherwise(F.col("tag")))
    lines = nodes.where("tag = 'l'").select("doc_id", F.col("parent").alias("verse"), "pre", F.coalesce(F.nullif(attr(F.col("attrs"), "n"), F.lit("")), F.lit("X")).alias("label"), attr(F.col("attrs"), "enjamb").alias("enjamb"))
    out = lines.join(text_of(spaced, "l"), ["doc_id", "pre"], "left").withColumn("_v", F.concat_ws("/", "doc_id", "verse"))
    out = in_sequence(out, "_v", "label", "pre")
    text = clean_passage(F.coalesce("content", F.lit("")))
    out = out.withColumn("text", F.when((F.col("enjamb") == "yes") & ~text.startswith("-"), F.concat(F.lit("-"), text)).otherwise(text))
    letters = F.max(F.col("text").rlike(r"\p{L}").cast("int")).over(Window.partitionBy("_v"))
    return out.withColumn("_l", letters).where("_l = 1").select("doc_id", "verse", "pre", "label", "text")


def searchable_text(nodes: DataFrame) -> DataFrame:
    """(doc_id, text): an edition's text for search: blocks end lines, list items begin with a space, notes and headings are left out."""
    kept = without_subtrees(nodes, nodes.where(F.col("tag").isin(*SEARCH_DROPS)).select("doc_id", "pre"))
    text = kept.where("tag = '#text'").select("doc_id", F.col("pre").alias("at"), "text").join(block_of(nodes), ["doc_id", "at"])
    blocks = text.groupBy("doc_id", "block", "kind").agg(squeeze(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "")).alias("text"), F.min("at").alias("first")).where("text <> ''")
    shown = F.when(F.col("kind") == "item", F.concat(F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    return blocks.withColumn("text", shown).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "text"))), lambda x: x["text"]), "\n").alias("text"))


def document_bibliography(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc_id, pre, target, siglum, listed, entry_key): references in order of appearance, the first one of each target; listed ones stand in a listBibl."""
    is_bibl = F.col("tag") == "bibl"
    # a reference and what it points to meet by its number; all that follows stays with the document
    parts = nodes.where(F.col("tag").isin("bibl", "ptr")).select(
        "doc_id",
        F.when(is_bibl, F.col("pre")).otherwise(F.col("parent")).alias("pre"),
        F.when(is_bibl, attr(F.col("attrs"), "n")).alias("siglum"),
        F.when(is_bibl, F.array_contains("names", "listBibl")).alias("listed"),
        F.when(~is_bibl, F.regexp_replace(attr(F.col("attrs"), "target"), "^bib:", "")).alias("target"),
    )
    refs = parts.repartition("doc_id").groupBy("doc_id", "pre").agg(F.max("siglum").alias("siglum"), F.max("listed").alias("listed"), F.collect_list("target").alias("_to"))
    refs = refs.where("listed IS NOT NULL").select("doc_id", "pre", "siglum", F.explode("_to").alias("target"), "listed")
    first = refs.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "target").orderBy(F.col("listed").desc(), "pre"))).where("_n = 1").drop("_n")
    return resolve_reference(first, entries, ITEM_TYPES)


def list_pairs(nodes: DataFrame) -> DataFrame:
    """(doc_id, list, n, label, item): labels and items of a list in pairs; a missing half is empty."""
    content = text_of(nodes)
    lists = nodes.where("tag = 'list'").select("doc_id", F.col("pre").alias("parent"))
    parts = nodes.where(F.col("tag").isin("label", "item")).join(lists, ["doc_id", "parent"]).select("doc_id", F.col("parent").alias("list"), "pre", "tag").join(content, ["doc_id", "pre"], "left")
    w = Window.partitionBy("doc_id", "list").orderBy("pre")
    # a pair begins with a label, or with an item that has none before it
    new = ((F.col("tag") == "label") | (F.coalesce(F.lag("tag").over(w), F.lit("item")) == "item")).cast("int")
    paired = parts.withColumn("_new", new).withColumn("n", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    half = lambda tag: F.coalesce(F.max(F.when(F.col("tag") == tag, squeeze(F.coalesce("content", F.lit(""))))), F.lit("")).alias(tag)
    return paired.groupBy("doc_id", "list", "n").agg(half("label"), half("item"))


def abbreviation_forms(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, contracted, expanded) of expan and choice elements: without ``ex``, and without ``am``."""
    roots = nodes.where(F.col("tag").isin("expan", "abbr"))
    forms = []
    for drop in ("ex", "am"):
        kept = without_subtrees(nodes, nodes.where(F.col("tag") == drop).select("doc_id", "pre"))
        forms.append(text_of(kept.where("tag = '#text'").unionByName(roots.where(F.col("tag") != drop))).select("doc_id", "pre", squeeze(F.col("content")).alias(f"_{drop}")))
    return roots.select("doc_id", "pre").join(forms[0], ["doc_id", "pre"], "left").join(forms[1], ["doc_id", "pre"], "left").select("doc_id", "pre", F.coalesce("_ex", F.lit("")).alias("contracted"), F.coalesce("_am", F.lit("")).alias("expanded"))


def meter_names(nodes: DataFrame, prosody: DataFrame) -> DataFrame:
    """(doc_id, pre, meter, heading): a verse's metre as printed pattern, or its name with the pattern known for it (name, pattern)."""
    verses = nodes.where("tag = 'lg'").select("doc_id", "pre", attr(F.col("attrs"), "met").alias("meter")).where("meter <> ''")
    known = prosody.groupBy(F.col("name").alias("meter")).agg(F.min("pattern").alias("pattern"))
    out = verses.join(known, "meter", "left")
    named = F.when(F.col("pattern").isNotNull(), F.concat(F.initcap("meter"), F.lit(": "), meter_pattern(F.col("pattern")))).otherwise(F.initcap("meter"))
    return out.select("doc_id", "pre", "meter", F.when(is_meter(F.col("meter")), meter_pattern(F.col("meter"))).otherwise(named).alias("heading"))


def division_headings(nodes: DataFrame, langs: DataFrame, people: DataFrame) -> DataFrame:
    """(doc_id, pre, type, heading): a division's own heading, or one by its type; a translation says into what and by whom."""
    divs = nodes.where("tag = 'div'").select("doc_id", "pre", attr(F.col("attrs"), "type").alias("type"), attr(F.col("attrs"), "lang").alias("code"), F.split(attr(F.col("attrs"), "resp"), r"\s+").alias("resp"))
    head = nodes.where("tag = 'head'").select("doc_id", F.col("pre").alias("_pre"), F.col("parent").alias("pre"))
    own = text_of(nodes, "head").withColumnRenamed("pre", "_pre").join(head, ["doc_id", "_pre"]).groupBy("doc_id", "pre").agg(F.min_by("content", "_pre").alias("own"))
    names = divs.select("doc_id", "pre", F.posexplode("resp").alias("i", "r")).withColumn("person_id", F.regexp_replace("r", "^part:", "")).join(people.select("person_id", display_names(F.col("name"))[0].alias("print")), "person_id").groupBy("doc_id", "pre").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "print"))), lambda x: x["print"]), ", ").alias("by"))
    out = divs.join(own, ["doc_id", "pre"], "left").join(names, ["doc_id", "pre"], "left").join(langs.select("code", F.col("name").alias("lang_name")), "code", "left")
    translation = F.concat_ws(" ", F.lit("Translation"), F.concat(F.lit("into "), F.col("lang_name")), F.concat(F.lit("by "), F.regexp_replace("by", r", ([^,]*)$", " and $1")))
    return out.select("doc_id", "pre", "type", F.coalesce(F.nullif(squeeze(F.col("own")), F.lit("")), F.when(F.col("type") == "translation", translation).otherwise(F.initcap("type"))).alias("heading"))


def outline(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, level): divisions with how many divisions are around them, and 1."""
    divs = nodes.where("tag = 'div'").select("doc_id", "pre", "path")
    outer = divs.select("doc_id", F.col("pre").alias("up"), F.lit(1).alias("_one"))
    return divs.withColumn("up", F.explode_outer("path")).join(outer, ["doc_id", "up"], "left").groupBy("doc_id", "pre").agg((F.count("_one") + 1).alias("level"))
