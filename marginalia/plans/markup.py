"""Queries over marks, blocks, spaces and rules of editions, each with equal SQL over ``conversations``."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.operators import catalog, constraints, editions, trees, upserts
from marginalia.plans.editions import SQUEEZED, edition_texts, per_turn, turns
from marginalia.plans.queries import query, table
from marginalia.sources import keep, prosody
from marginalia.sources.nodes import xml_nodes

lit = F.lit


def documents_of(rows: DataFrame, *parts: F.Column, before: str, after: str) -> DataFrame:
    """Nodes of one document a conversation: its turns between two pieces of markup."""
    made = rows.groupBy("conv_id").agg(per_turn(*parts).alias("x"))
    return xml_nodes(made.select(F.col("conv_id").cast("string").alias("doc_id"), F.concat(lit(before), "x", lit(after)).alias("data")), "doc_id", "data")


# what a turn is, by (turn + conv_id) % 12: markup with {x} for its text, {r} for its role, {R} for that in capitals and {n} for its number; then the views, one if all are the same
MARKED = [
    ('<supplied reason="omitted">{x}</supplied>', "⟨{x}⟩"), ('<supplied reason="explanation">{x}</supplied>', "({x})"), ('<supplied reason="lost" cert="low">{x}</supplied>', "[{x}?]"), ('<supplied reason="subaudible">{x}</supplied>', "[{x}]"),
    ('<unclear cert="low">{x}</unclear>', "({x}?)"), ("<choice><unclear>{r}</unclear> <unclear>{x}</unclear><unclear>{n}</unclear></choice>", "({r}/{x}/{n})"), ('<seg rend="check pun" cert="low">{x}</seg>', "{{¿{x}?}}"), ('<seg met="-+"><gap reason="lost"/></seg>', "[⏑–]"),
    ("<subst><add>{x}</add> <del>{R}</del></subst>", "⟦{R}⟧⟨⟨{x}⟩⟩"), ("<choice> <orig>{x}</orig> <reg>{R}</reg></choice>", "¡{x}!", "⟨{R}⟩", "¡{x}!⟨{R}⟩"), ('{n}<note>{x}</note><gap reason="illegible" quantity="2"/>', "{n}[**]", "{n}[2×]", "{n}[2×]"), ("<seg>{x}</seg><surplus>{r}</surplus><bibl>{x}</bibl>", "{x}{{{r}}}"),
]


def filled(template: str, sql: bool) -> F.Column | str:
    """A template as a column, or as SQL."""
    parts: list = []
    for plain, name, _, _ in Formatter().parse(template):
        if plain:
            parts.append(f"'{plain}'" if sql else lit(plain))
        if name:
            parts.append({"x": "text", "r": "role", "R": "upper(role)", "n": "turn"}[name] if sql else {"x": F.col("xml"), "r": F.col("role"), "R": F.upper("role"), "n": F.col("turn").cast("string")}[name])
    return " || ".join(parts) if sql else F.concat(*parts)


def marked_sql() -> str:
    views = []
    for v, view in enumerate(("physical", "logical", "full")):
        cases = " ".join(f"WHEN {i} THEN {filled((x * 3 if len(x) == 1 else x)[v], True)}" for i, (_, *x) in enumerate(MARKED))
        views.append(f"SELECT conv_id, '{view}' AS view, string_agg(CASE (turn + conv_id) % 12 {cases} END, '' ORDER BY turn) AS t FROM conversations GROUP BY conv_id")
    return f"SELECT conv_id::VARCHAR AS doc_id, view, md5({SQUEEZED.format('t')}) AS text FROM ({' UNION ALL '.join(views)})"


@query(marked_sql())
def marked_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of turns with all kinds of marks, by attribute: supplied, unclear and segments, choices, substitutions."""
    rows = turns(spark, sf_dir).withColumn("k", (F.col("turn") + F.col("conv_id")) % 12)
    shown = None
    for i, (markup, *_) in enumerate(MARKED):
        shown = F.when(F.col("k") == i, filled(markup, False)) if shown is None else shown.when(F.col("k") == i, filled(markup, False))
    nodes = documents_of(rows, shown, before="<TEI><p>", after="</p></TEI>")
    return editions.edition_views(nodes.repartition(keep.parts_for(rows, "text"), "doc_id")).select("doc_id", "view", F.md5("text").alias("text"))


ESCAPED = "replace(replace({0}, '&', '&amp;'), '<', '&lt;')"
QUOTED = f"replace({ESCAPED.format(SQUEEZED.format('text'))}, '\"', '&quot;')"


@query(f"""
WITH p AS (SELECT conv_id, string_agg({QUOTED} || ' <hi><ref>' || role || '</ref></hi>' || CASE WHEN turn % 2 = 0 THEN '<note>' || turn || '</note>' ELSE '' END || CASE WHEN turn % 3 = 0 THEN '<lb></lb>' WHEN turn % 3 = 1 THEN ' ' ELSE '' END || '<hi>' || turn || '</hi>', ' ' ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id::VARCHAR AS doc_id, md5('<TEI><p>' || t || '</p></TEI>') AS markup FROM p
""")
def settled_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space at the edges of inlines, notes and milestones in its place, with empty elements left out."""
    t = F.col("turn").cast("string")
    note = F.when(F.col("turn") % 2 == 0, F.concat(lit(" <note> "), t, lit(" </note>"))).otherwise("")
    gap = F.when(F.col("turn") % 3 == 0, lit(" <lb/>\n")).when(F.col("turn") % 3 == 1, lit("<hi> <ref/></hi>")).otherwise("<hi/>")
    nodes = documents_of(turns(spark, sf_dir), F.col("xml"), lit("<hi><ref>\t"), F.col("role"), lit("</ref></hi>"), note, gap, lit("<hi>"), t, lit(" </hi>\n"), before="<TEI> <p> ", after=" </p></TEI>")
    return trees.markup(trees.settle_spaces(nodes)).select("doc_id", F.md5("xml").alias("markup"))


LINE = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '\"', '&quot;')"


@query(f"""
WITH c AS (SELECT *, {LINE} AS x, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
d AS (SELECT conv_id, string_agg('<p>' || x || '</p><list><item><p>' || role || '</p></item></list><p n="' || turn || '">' || turn || '<hi> ' || role || ' ' || turn || ' </hi></p><p>loose<note><p>' || turn || '</p></note></p>', '' ORDER BY turn) AS t, string_agg('<div phantom="false"><p>' || x || '</p></div><div phantom="true"><lg><l>' || role || '</l></lg></div>', '' ORDER BY turn) AS u FROM c GROUP BY conv_id)
SELECT conv_id::VARCHAR AS doc_id, md5('<TEI><div phantom="false"><head>h</head>' || t || '</div><div phantom="false"><div phantom="true"><p>first</p></div>' || u || '</div></TEI>') AS markup FROM d
""")
def segmented_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions with lists in paragraphs, blocks in inlines, loose inlines, and blocks beside divisions, put in order."""
    t = F.col("turn").cast("string")
    rows = turns(spark, sf_dir)
    one = F.concat(lit("<p>"), "xml", lit("<list><item>"), "role", lit("</item></list></p><p n=\""), t, lit("\">"), t, lit("<hi><list><item><p>"), "role", lit("</p></item></list><p>"), t, lit("</p> </hi></p>loose<note>"), t, lit("</note>"))
    two = F.concat(lit("<div>"), "xml", lit("</div><lg>"), "role", lit("</lg>"))
    made = rows.groupBy("conv_id").agg(per_turn(one).alias("a"), per_turn(two).alias("b"))
    data = F.concat(lit("<TEI><div><head>h</head>"), "a", lit("</div><div>first"), "b", lit("</div></TEI>"))
    nodes = xml_nodes(made.select(F.col("conv_id").cast("string").alias("doc_id"), data.alias("data")), "doc_id", "data")
    return trees.markup(trees.segment(nodes, keep.parts_for(rows, "text"))).select("doc_id", F.md5("xml").alias("markup"))


# what a turn holds, by (turn + conv_id) % 10, and the rules that it breaks
BROKEN = [
    ('<gap quantity="2"/>', "gap-unit"), ("<choice><unclear/><unclear/><unclear/><unclear/></choice>", "choice-unclear"), ('<rs type="season" key="spring"/>', "calendar-season"), ('<lg><l n="a"/><l n="b"/><l n="a"/></lg>', "verse-unique"),
    ("<app><note/><rdg/></app>", "app-note-last app-lem app-list"), ('<p rend="stanza"/>', "stanza-translation stanza-place"), ('<span to="1 2"/>', "span-from span-single"), ('<milestone type="ref" unit="line" n="1"/>', "milestone-ref"), ("<corr/><reg/>", "in-choice in-choice"), ('<gap quantity="1" unit="line"/>', ""),
]


@query(f"""
WITH r(k, rule_id) AS (VALUES {', '.join(f"({k}, '{rule}')" for k, (_, rules) in enumerate(BROKEN) for rule in rules.split())})
SELECT conv_id::VARCHAR AS doc_id, rule_id, count(*) AS n, min(turn)::INTEGER AS first FROM conversations JOIN r ON (turn + conv_id) % 10 = k GROUP BY ALL
""")
def markup_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each edition breaks each rule of the table, and at which turn first."""
    rows = turns(spark, sf_dir)
    held = F.element_at(F.array(*[lit(x) for x, _ in BROKEN]), ((F.col("turn") + F.col("conv_id")) % 10 + 1).cast("int"))
    nodes = documents_of(rows, lit('<ab n="'), F.col("turn").cast("string"), lit('"/>'), held, before="<TEI><body>", after="</body></TEI>")
    # a turn's mark is the last one before the element
    marks = nodes.where("tag = 'ab'").select("doc_id", "pre", F.element_at("attrs", "n").cast("int").alias("turn"))
    found = constraints.violations(nodes).select("doc_id", "pre", "rule_id").unionByName(marks.select("doc_id", "pre", lit(None).cast("string").alias("rule_id"))).join(marks, ["doc_id", "pre"], "left")
    w = Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    placed = found.withColumn("turn", F.last("turn", ignorenulls=True).over(w)).where("rule_id IS NOT NULL")
    return placed.groupBy("doc_id", "rule_id").agg(F.count("*").alias("n"), F.min("turn").alias("first"))


# nested records and derived rows


@query("""
WITH p AS (SELECT *, string_split(p_name, ' ') AS names, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS entry_id FROM part)
SELECT p_brand AS brand, entry_id, unnest(names) AS name, p_type AS class, p_size::VARCHAR AS syllables, repeat('⏑–', p_size % 4 + 1) AS pattern, CASE WHEN p_size % 2 = 0 THEN 'Ann ' || p_brand ELSE 'Nobody Known' END AS author, '*†' AS symbols, p_type || '|' || p_size AS ref_notes FROM p
""")
def prosody_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as items of lists of metres, written as XML files, a list for each brand, and read back as nested records."""
    rows, c = table(spark, sf_dir, "part"), F.col
    size = c("p_size").cast("string")
    names = F.array_join(F.transform(F.split("p_name", " "), lambda x: F.concat(lit('<name xml:lang="san-Latn">'), x, lit("</name>"))), "")
    known = F.when(c("p_size") % 2 == 0, F.concat(lit("part:"), F.replace("p_brand", lit("#"), lit("-")))).otherwise("part:stranger")
    item = F.concat(lit('<item><measure unit="syllable">'), size, lit('</measure><label type="generic" xml:lang="eng">'), "p_type", lit("</label>"), names, lit('<seg type="prosody">'), F.repeat(lit("-+"), c("p_size") % 4 + 1), lit('</seg><seg type="gana">no data available</seg><note resp="'), known, lit('">seen</note>'), lit('<listBibl><bibl><ptr target="bib:K"/><citedRange unit="verse">'), size, lit("</citedRange><note>"), "p_type", lit("</note></bibl><bibl><ptr target=\"bib:L\"/><note>"), size, lit("</note></bibl></listBibl></item>"))
    lists = rows.groupBy("p_brand").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", item.alias("x")))), lambda r: r["x"]), "").alias("x"))
    path = keep.new_folder(spark)
    # one line a list: an XML document each
    lists.select(F.concat(lit("<TEI><text><list><head>"), "p_brand", lit("</head>"), "x", lit("</list></text></TEI>"))).write.text(path)
    read = spark.read.text(path).select(F.regexp_extract("value", "<head>([^<]*)", 1).alias("brand"), "value")
    langs = spark.createDataFrame([("san", "sanskrit", "Sanskrit"), ("eng", "english", "English")], "code string, id string, name string")
    people = rows.select(F.replace("p_brand", lit("#"), lit("-")).alias("person_id"), F.array(lit("Ann"), "p_brand").alias("name")).unionByName(spark.createDataFrame([("nobody", ["Nobody", "Known"])], "person_id string, name array<string>"))
    items = keep.kept(prosody.prosody_items(xml_nodes(read, "brand", "value"), langs, people, "nobody"))
    keep.delete_folder(spark, path)
    index = prosody.prosody_index(items).select("doc_id", "entry_id", "name", "pattern")
    whole = items.select("doc_id", "entry_id", F.col("class.text").alias("class"), "syllables", F.col("notes")[0]["authors"][0]["name"].alias("author"), F.array_join(F.transform("refs", lambda x: x["symbols"]), "").alias("symbols"), F.array_join(F.transform("ref_notes", lambda x: x["text"]), "|").alias("ref_notes"))
    return index.join(whole, ["doc_id", "entry_id"]).select(F.col("doc_id").alias("brand"), F.col("entry_id").cast("long").alias("entry_id"), "name", "class", "syllables", "pattern", "author", "symbols", "ref_notes")


@query("""
WITH n AS (SELECT conv_id, count(*) AS n, min_by(role, turn) = 'system' AS changed FROM conversations GROUP BY conv_id)
SELECT conv_id::VARCHAR AS name, 'Talk ' || conv_id || CASE WHEN changed THEN ' anew' ELSE '' END AS title, n::INTEGER AS authors, CASE WHEN changed THEN 2 ELSE 1 END AS build FROM n
""")
def rebuilt_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of editions, built, and built again after those that a system opens have changed: each with the build that computed it last."""
    files = edition_texts(spark, sf_dir).select(F.col("doc_id").alias("name"), "data")
    changed = files.withColumn("data", F.when(F.col("data").contains('resp="part:system"'), F.regexp_replace("data", "(<title>[^<]*)", "$1 anew")).otherwise(F.col("data")))
    parse = lambda df: xml_nodes(df, "name", "data").where("tag <> '#error'")

    def build(files: DataFrame, stored: DataFrame, n: int) -> DataFrame:
        record = lambda nodes: catalog.document_record(nodes).select("doc_id", "title", F.size("authors").alias("authors"), lit(n).alias("build"))
        return keep.kept(upserts.rebuild_changed(files, stored, parse, record, "one"))

    none = spark.createDataFrame([], "name string, input_hash string, rules string, title string, authors int, build int")
    return build(changed, build(files, none, 1), 2).select("name", "title", "authors", "build")
