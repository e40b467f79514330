"""Lists of metres as typed nested records, read from the node table of their markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.bibliography import UNITS
from marginalia.functions.text import meter_pattern, squeeze
from marginalia.operators.axes import around, attr, elements
from marginalia.operators.catalog import display_names
from marginalia.sources.keep import kept

# Signs of notes in their order, the placeholder of an entry without a reference, and of a pattern that is not known.
SYMBOLS = ("*", "†", "‡", "§", "¶", "‖", "**", "††", "‡‡")
NO_REFERENCE, NO_PATTERN = "bib:AuthorYear_01", "no data available"


def with_text(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen elements with ``said``: all text in them, squeezed; null if there is none."""
    text = around(nodes.where("tag = '#text'").select("doc_id", F.col("pre").alias("_at"), "path", "text").withColumn("pre", F.col("_at")), "_up")
    inside = text.join(chosen.select("doc_id", F.col("pre").alias("_up")), ["doc_id", "_up"]).groupBy("doc_id", F.col("_up").alias("pre"))
    said = inside.agg(squeeze(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "text"))), lambda x: x["text"]), "")).alias("said"))
    return chosen.join(said, ["doc_id", "pre"], "left").withColumn("said", F.nullif("said", F.lit("")))


def enclosing(k: int) -> Column:
    """The tag of the k-th element around a node, counted from the innermost."""
    return F.try_element_at("names", F.lit(-k))


def prosody_items(nodes: DataFrame, langs: DataFrame, people: DataFrame, default_person: str | None = None) -> DataFrame:
    """(doc_id, entry_id, heading, syllables, class, names, xml, prosody, gana, notes, refs, ref_notes) of the items of lists, numbered through a document.

    ``langs`` is (code, id, name) and ``people`` (person_id, name array). A text's language is what stands
    before the hyphen, else und. Notes name their authors, an unknown one as ``default_person``. References have their
    units (``mixed`` for an unknown one) and the signs of their notes, which are counted through an item."""
    nodes = kept(nodes)  # read by every join below
    tags = ("measure", "label", "name", "seg", "note", "citedRange", "ptr", "head")
    parts = with_text(nodes, elements(nodes).where(F.col("tag").isin(*tags))).withColumn("_code", F.coalesce(F.nullif(F.regexp_extract(attr(F.col("attrs"), "lang"), "^[^-]*", 0), F.lit("")), F.lit("und")))
    known = langs.select(F.col("code").alias("_code"), F.struct("id", "name").alias("lang")).groupBy("_code").agg(F.min("lang").alias("lang"))
    parts = parts.join(known, "_code", "left")
    # authors of notes by name
    print_ = people.groupBy("person_id").agg(F.min(display_names(F.col("name"))[0]).alias("print"))
    resp = parts.where("tag = 'note'").select("doc_id", "pre", F.posexplode(F.filter(F.transform(F.split(attr(F.col("attrs"), "resp"), r"\s+"), lambda x: F.regexp_replace(x, "^part:", "")), lambda x: x != "")).alias("i", "person_id"))
    named = resp.join(print_, "person_id", "left")
    if default_person is not None:
        spare = print_.where(F.col("person_id") == default_person).agg(F.max("print").alias("_spare"))
        named = named.join(F.broadcast(spare), F.lit(True)).withColumn("print", F.coalesce("print", "_spare"))
    authors = named.groupBy("doc_id", "pre").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "person_id", "print"))), lambda x: F.struct(x["person_id"].alias("id"), x["print"].alias("name"))).alias("authors"))
    nobody = F.array().cast("array<struct<id:string,name:string>>")
    parts = parts.join(authors, ["doc_id", "pre"], "left").withColumn("authors", F.coalesce("authors", nobody))
    # what stands directly in an item
    direct = parts.where(enclosing(1) == "item").withColumn("item", F.col("parent"))
    a = lambda name: attr(F.col("attrs"), name)
    one = lambda cond, value: F.min_by(F.when(cond, value), F.when(cond, F.col("pre")))
    has = F.col("said").isNotNull()
    listed = lambda cond, *columns: F.transform(F.array_sort(F.collect_list(F.when(cond & has, F.struct("pre", *columns)))), lambda x: F.struct(*[x[c].alias({"said": "text"}.get(c, c)) for c in columns]))
    segment = lambda kind: one((F.col("tag") == "seg") & (a("type") == kind), F.coalesce("said", F.lit(NO_PATTERN)))
    grouped = direct.groupBy("doc_id", "item").agg(
        one((F.col("tag") == "measure") & (a("unit") == "syllable"), F.col("said")).alias("syllables"),
        one((F.col("tag") == "label") & (a("type") == "generic") & has, F.struct(F.col("said").alias("text"), "lang")).alias("class"),
        listed(F.col("tag") == "name", "said", "lang").alias("names"),
        *[F.nullif(segment(kind), F.lit(NO_PATTERN)).alias(kind) for kind in ("xml", "prosody", "gana")],
        listed(F.col("tag") == "note", "said", "authors").alias("notes"),
    )
    # references
    cited = parts.where((enclosing(1) == "bibl") & (enclosing(2) == "listBibl") & (enclosing(3) == "item")).withColumns({"bibl": F.col("parent"), "item": F.element_at("path", -3)})
    unit = F.when(F.nullif(a("unit"), F.lit("")).isNull(), "page").when(a("unit").isin(*UNITS), a("unit")).otherwise("mixed")
    refs = cited.withColumn("unit", unit).groupBy("doc_id", "item", "bibl").agg(
        F.min_by(F.when(F.col("tag") == "ptr", a("target")), F.when(F.col("tag") == "ptr", F.col("pre"))).alias("target"),
        F.transform(F.array_sort(F.collect_list(F.when((F.col("tag") == "citedRange") & has, F.struct("pre", "unit", "said")))), lambda x: F.struct(x["unit"].alias("unit"), x["said"].alias("value"))).alias("locations"),
        F.transform(F.array_sort(F.collect_list(F.when((F.col("tag") == "note") & has, F.struct("pre", "said", "authors")))), lambda x: F.struct(x["said"].alias("text"), x["authors"].alias("authors"))).alias("notes"),
    )
    refs = refs.where((F.coalesce("target", F.lit("")) != "") & (F.col("target") != NO_REFERENCE)).withColumn("key", F.regexp_replace("target", "^bib:", ""))
    earlier = Window.partitionBy("doc_id", "item").orderBy("bibl").rowsBetween(Window.unboundedPreceding, -1)
    refs = refs.withColumn("_n", F.coalesce(F.sum(F.size("notes")).over(earlier), F.lit(0)))
    signs = F.array(*map(F.lit, SYMBOLS))
    sign = lambda i: F.element_at(signs, (i % len(SYMBOLS) + 1).cast("int"))
    refs = refs.withColumn("notes", F.transform("notes", lambda x, i: F.struct(sign(i + F.col("_n")).alias("symbol"), x["text"].alias("text"), x["authors"].alias("authors"))))
    by_item = refs.groupBy("doc_id", "item").agg(F.array_sort(F.collect_list(F.struct("bibl", "key", "locations", "notes"))).alias("_r"))
    by_item = by_item.select("doc_id", "item", F.transform("_r", lambda x: F.struct(x["key"].alias("key"), x["locations"].alias("locations"), F.array_join(F.transform(x["notes"], lambda y: y["symbol"]), "").alias("symbols"))).alias("refs"), F.flatten(F.transform("_r", lambda x: x["notes"])).alias("ref_notes"))
    items = nodes.where("tag = 'item'").where(enclosing(1) == "list").select("doc_id", F.col("pre").alias("item"), F.col("parent").alias("list"))
    items = items.withColumn("entry_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("item")))
    heads = parts.where("tag = 'head'").where(enclosing(1) == "list").groupBy("doc_id", F.col("parent").alias("list")).agg(F.min_by("said", "pre").alias("heading"))
    out = items.join(heads, ["doc_id", "list"], "left").join(grouped, ["doc_id", "item"], "left").join(by_item, ["doc_id", "item"], "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(dict(out.dtypes)[c]))
    return out.select("doc_id", "entry_id", "heading", "syllables", "class", empty("names").alias("names"), "xml", "prosody", "gana", empty("notes").alias("notes"), empty("refs").alias("refs"), empty("ref_notes").alias("ref_notes"))


def prosody_index(items: DataFrame) -> DataFrame:
    """(doc_id, name, entry_id, pattern, description) of every name: its printed pattern, else its notation, else its feet; without one what its first note says."""
    pattern = F.coalesce(meter_pattern(F.col("prosody")), "xml", "gana")
    described = F.when(pattern.isNull(), F.try_element_at("notes", F.lit(1))["text"])
    rows = items.select("doc_id", "entry_id", F.explode("names").alias("n"), pattern.alias("pattern"), described.alias("description"))
    return rows.select("doc_id", F.col("n.text").alias("name"), "entry_id", "pattern", "description")


def nested_scripts(nodes: DataFrame) -> DataFrame:
    """(doc_id, id, codes, name, inverted_name, parent, above) of nested ``script`` elements: names default to the first code, ``above`` lists the ids of all that are around, outermost first."""
    parts = with_text(nodes, elements(nodes).where(F.col("tag").isin("id", "name", "inverted_name")).where(enclosing(1) == "script")).where("said IS NOT NULL")
    first = lambda tag: F.min_by(F.when(F.col("tag") == tag, F.col("said")), F.when(F.col("tag") == tag, F.col("pre")))
    codes = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("tag") == "id", F.struct("pre", "said")))), lambda x: x["said"]))
    known = parts.groupBy("doc_id", F.col("parent").alias("pre")).agg(codes.alias("codes"), first("name").alias("name"), first("inverted_name").alias("inverted_name")).where(F.size("codes") > 0)
    known = known.withColumn("id", F.col("codes")[0]).withColumn("name", F.coalesce("name", "id")).withColumn("inverted_name", F.coalesce("inverted_name", "name"))
    up = nodes.where("tag = 'script'").select("doc_id", "pre", F.posexplode_outer("path").alias("_i", "_up"))
    over = up.join(known.select("doc_id", F.col("pre").alias("_up"), F.col("id").alias("_id")), ["doc_id", "_up"], "left").groupBy("doc_id", "pre").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("_id").isNotNull(), F.struct("_i", "_id")))), lambda x: x["_id"]).alias("above"))
    return known.join(over, ["doc_id", "pre"]).select("doc_id", "id", "codes", "name", "inverted_name", F.try_element_at("above", F.lit(-1)).alias("parent"), "above")
