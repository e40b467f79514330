"""Queries over editions that Spark makes of the tables: markup, its node table, and what the operators read from it.

Each conversation is an edition: its turns are the lines of a paragraph, the lines of
a verse and the entries of a list. What an operator must find follows from the turns,
so every query has equal SQL over ``conversations``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import axes, catalog, editions, marks, rules, similarity, trees, windows
from marginalia.plans.queries import query, table
from marginalia.sources.keep import kept, parts_for
from marginalia.sources.nodes import parse_failures, xml_nodes

SQUEEZED = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


def escaped(c: str) -> F.Column:
    return F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, role, text, xml, enjamb): a line runs on where its text does not end in a full stop."""
    rows = table(spark, sf_dir, "conversations").withColumn("turn", F.col("turn").cast("int"))
    return rows.select("conv_id", "turn", "role", "text", escaped("text").alias("xml"), F.when(F.substring("text", -1, 1) == ".", "no").otherwise("yes").alias("enjamb"))


def per_turn(*parts: F.Column) -> F.Column:
    """A text for each turn of a conversation, in order."""
    rows = F.sort_array(F.collect_list(F.struct("turn", F.concat(*parts).alias("x"))))
    return F.array_join(F.transform(rows, lambda r: r["x"]), "")


def edition_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, doc_id, data): one edition a conversation."""
    t, lit = F.col("turn").cast("string"), F.lit
    grouped = turns(spark, sf_dir).groupBy("conv_id").agg(
        F.count("*").cast("int").alias("n"),
        F.min_by("role", "turn").alias("first"),
        per_turn(lit('<author ref="part:'), F.col("role"), lit('">'), F.col("role"), lit("</author>")).alias("authors"),
        per_turn(lit('<lb n="'), t, lit('"/>'), F.col("xml"), lit("<choice><sic>"), F.col("role"), lit("</sic><corr>"), F.upper("role"), lit('</corr></choice><gap reason="lost" quantity="'), (F.col("turn") + 1).cast("string"), lit('"/>')).alias("lines"),
        per_turn(lit('<l n="'), F.char(F.col("turn") + 97), lit('" enjamb="'), F.col("enjamb"), lit('">'), F.col("xml"), lit("</l>")).alias("verse"),
        per_turn(lit("<label>"), F.col("role"), lit("</label><item>"), t, lit("</item>")).alias("entries"),
    )
    key = F.col("conv_id").cast("string")
    data = F.concat(
        lit("<TEI><teiHeader><title>Talk "), key, lit("</title>"), F.col("authors"), lit('<editor ref="part:none">John Doe</editor></teiHeader><text><body><div type="edition" xml:lang="san-Latn" rendition="class:grantha" n="'), key,
        lit('"><pb n="1"/><p>'), F.col("lines"), lit('</p><lg n="'), key, lit('" met="'), F.repeat(lit("-+"), F.col("n")), lit('">'), F.col("verse"),
        lit('</lg></div><div type="translation" xml:lang="eng" resp="part:'), F.col("first"), lit('"><p>'), F.col("n").cast("string"), lit("</p><note>"), key, lit("</note></div><list>"), F.col("entries"), lit("</list></body></text></TEI>"),
    )
    return grouped.select("conv_id", key.alias("doc_id"), data.alias("data"))


def edition_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xml_nodes(edition_texts(spark, sf_dir), "doc_id", "data")


def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lines of pages: a user's turn begins a page, a line after an odd turn goes on in the word."""
    t = F.col("turn").cast("string")
    rows = turns(spark, sf_dir).groupBy("conv_id").agg(per_turn(F.when(F.col("role") == "user", "<pb/>").otherwise(""), F.lit('<lb n="'), t, F.when(F.col("turn") % 2 == 1, '" break="no"/>').otherwise('"/>'), F.col("xml")).alias("x"))
    return xml_nodes(rows.select(F.col("conv_id").cast("string").alias("doc_id"), F.concat(F.lit("<d>"), "x", F.lit("</d>")).alias("data")), "doc_id", "data")


def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(person_id, name): the roles but one as people with two names."""
    return spark.createDataFrame([(role, [role.capitalize(), "Speaker"]) for role in ("user", "assistant")], "person_id string, name array<string>")


C = "SELECT conv_id, turn, role, text, count(*) OVER (PARTITION BY conv_id) AS n, lag(right(text, 1) <> '.') OVER (PARTITION BY conv_id ORDER BY turn) AS runs_on FROM conversations"


# records and people


@query("SELECT conv_id::VARCHAR AS doc_id, 'Talk ' || conv_id AS title, string_agg(role, '|' ORDER BY turn) AS authors, 'John Doe' AS editors, 'part:none' AS editors_ids, 'san-Latn|eng' AS langs, 'grantha' AS scripts FROM conversations GROUP BY conv_id")
def edition_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.document_record(edition_nodes(spark, sf_dir))
    return found.select("doc_id", "title", *[F.array_join(c, "|").alias(c) for c in ("authors", "editors", "editors_ids", "langs", "scripts")])


@query("SELECT conv_id::VARCHAR AS doc_id, 'talk ' || conv_id AS title, string_agg(lower(role), '!!!!!' ORDER BY turn) AS authors, 'san-latn!!!!!eng' AS langs FROM conversations GROUP BY conv_id")
def search_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search_record(catalog.document_record(edition_nodes(spark, sf_dir)).select("doc_id", "title", "authors", "langs"))


BROKEN = "SELECT conv_id, min_by(role, turn) = 'system' AS broken FROM conversations GROUP BY conv_id"


def with_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions, of which those that a system opens miss their last end tag."""
    docs = edition_texts(spark, sf_dir)
    broken = F.col("data").contains('resp="part:system"')
    return docs.withColumn("data", F.when(broken, F.regexp_replace("data", "</TEI>$", "")).otherwise(F.col("data")))


@query(f"SELECT conv_id::VARCHAR AS doc_id, CASE WHEN broken THEN NULL ELSE 'Talk ' || conv_id END AS title, CASE WHEN broken THEN 'und' ELSE 'san-Latn|eng' END AS langs, CASE WHEN broken THEN 0 ELSE turns END AS authors FROM ({BROKEN}) JOIN (SELECT conv_id, count(*)::INTEGER AS turns FROM conversations GROUP BY conv_id) USING (conv_id)")
def fallback_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_broken(spark, sf_dir)
    found = catalog.document_record(xml_nodes(docs, "doc_id", "data").where("tag <> '#error'"))
    return catalog.with_fallback_record(docs.select("doc_id"), found).select("doc_id", "title", F.array_join("langs", "|").alias("langs"), F.size("authors").alias("authors"))


@query(f"SELECT conv_id::VARCHAR AS doc_id, 'no element found' AS message FROM ({BROKEN}) WHERE broken")
def broken_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_failures(with_broken(spark, sf_dir), "doc_id", "data").select("doc_id", "message")


@query("""
WITH f AS (SELECT conv_id, role, min(turn) AS seen FROM conversations WHERE role <> 'system' GROUP BY conv_id, role)
SELECT conv_id::VARCHAR AS doc_id, string_agg(role, '|' ORDER BY seen) AS ids, string_agg(upper(left(role, 1)) || substr(role, 2) || ' Speaker', '|' ORDER BY seen) AS names FROM f GROUP BY conv_id
""")
def edition_contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The speakers of each edition once, in order; the system is a placeholder."""
    nodes = edition_nodes(spark, sf_dir)
    rows = nodes.where("tag = 'author'").select("doc_id", "pre", axes.attr(F.col("attrs"), "ref").alias("id")).join(axes.text_of(nodes, "author").withColumnRenamed("content", "name"), ["doc_id", "pre"])
    found = catalog.merge_contributors(rows, speakers(spark, sf_dir), "system")
    return found.select("doc_id", F.array_join("ids", "|").alias("ids"), F.array_join("names", "|").alias("names"))


# structure

# for each axis from lines of verses (context l) and from lists: how many elements of a tag, by the turns n of a conversation
AXES = {
    "self": {"l": "n", "list": "1"}, "parent": {"lg": "n", "body": "1"}, "child": {"label": "n", "item": "n"}, "descendant": {"label": "n", "item": "n"}, "descendant-or-self": {"l": "n", "list": "1", "label": "n", "item": "n"},
    "ancestor": {"TEI": "n + 1", "text": "n + 1", "body": "n + 1", "div": "n", "lg": "n"}, "ancestor-or-self": {"TEI": "n + 1", "text": "n + 1", "body": "n + 1", "div": "n", "lg": "n", "l": "n", "list": "1"},
    "following-sibling": {"l": "n * (n - 1) / 2"}, "preceding-sibling": {"l": "n * (n - 1) / 2", "div": "2"}, "following": {"l": "n * (n - 1) / 2", "div": "n", "p": "n", "note": "n", "list": "n", "label": "n * n", "item": "n * n"},
    "preceding": {"teiHeader": "n + 1", "title": "n + 1", "author": "n * n + n", "editor": "n + 1", "pb": "n + 1", "p": "n + 2", "lb": "n * n + n", "choice": "n * n + n", "sic": "n * n + n", "corr": "n * n + n", "gap": "n * n + n", "l": "n * (n - 1) / 2 + n", "lg": "1", "div": "2", "note": "1"},
}
SQL_AXES = " UNION ALL ".join(f"SELECT '{axis}' AS axis, '{tag}' AS tag, sum({n})::BIGINT AS n FROM c" for axis, tags in AXES.items() for tag, n in tags.items())


@query(f"WITH c AS (SELECT count(*) AS n FROM conversations GROUP BY conv_id), a AS ({SQL_AXES}) SELECT * FROM a WHERE n > 0")
def edition_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many elements of each tag stand on each axis of all lines of verses and lists."""
    nodes = kept(edition_nodes(spark, sf_dir))  # read for every axis
    context, out = nodes.where("tag IN ('l', 'list')"), None
    for name in AXES:
        some = axes.axis(axes.elements(nodes), context, name).groupBy("tag").agg(F.count("*").alias("n")).select(F.lit(name).alias("axis"), "tag", "n")
        out = some if out is None else out.unionByName(some)
    return out


@query("""
WITH c AS (SELECT count(*) AS n FROM conversations GROUP BY conv_id)
SELECT 'next' AS axis, 'label' AS tag, 'item' AS other, sum(n)::BIGINT AS n FROM c UNION ALL SELECT 'next', 'item', 'label', sum(n - 1)::BIGINT FROM c HAVING sum(n - 1) > 0
UNION ALL SELECT 'previous', 'item', 'label', sum(n)::BIGINT FROM c UNION ALL SELECT 'previous', 'label', 'item', sum(n - 1)::BIGINT FROM c HAVING sum(n - 1) > 0
UNION ALL SELECT 'first-child', 'list', 'label', count(*) FROM c UNION ALL SELECT 'parent', 'label', 'list', count(*) FROM c
""")
def edition_stuck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of list entries with nothing but blanks between."""
    nodes = kept(edition_nodes(spark, sf_dir))  # read for every axis
    tags = axes.elements(nodes).select("doc_id", "pre", F.col("tag").alias("other"))
    context, out = nodes.where("tag IN ('label', 'item', 'list')"), None
    for name in ("next", "previous", "first-child", "parent"):
        found = axes.stuck_axis(nodes, context, name).join(tags, ["doc_id", "pre"])
        found = found.join(context.select("doc_id", F.col("pre").alias("context"), "tag"), ["doc_id", "context"]).where("other IN ('label', 'item', 'list') AND tag <> other")
        some = found.groupBy("tag", "other").agg(F.count("*").alias("n")).select(F.lit(name).alias("axis"), "tag", "other", "n")
        out = some if out is None else out.unionByName(some)
    return out.where("NOT (axis IN ('next', 'previous') AND (tag = 'list' OR other = 'list'))")


@query("""
WITH c AS (SELECT count(*) AS n FROM conversations GROUP BY conv_id)
SELECT 'p' AS tag, 2 * count(*) AS n, count(*)::BIGINT AS mixed, 0::BIGINT AS empty, count(*)::BIGINT AS plain FROM c
UNION ALL SELECT 'l', sum(n)::BIGINT, 0, 0, sum(n)::BIGINT FROM c UNION ALL SELECT 'lb', sum(n)::BIGINT, 0, sum(n)::BIGINT, sum(n)::BIGINT FROM c
UNION ALL SELECT 'lg', count(*), 0, 0, 0 FROM c UNION ALL SELECT 'choice', sum(n)::BIGINT, 0, 0, 0 FROM c
""")
def edition_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether elements hold elements, texts, both or nothing."""
    flags = axes.node_flags(edition_nodes(spark, sf_dir)).where("tag IN ('p', 'l', 'lb', 'lg', 'choice')")
    return flags.groupBy("tag").agg(F.count("*").alias("n"), *[F.count_if(c).alias(c) for c in ("mixed", "empty", "plain")])


@query("SELECT conv_id::VARCHAR AS doc_id, conv_id || '.' || conv_id AS number FROM conversations GROUP BY conv_id")
def verse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return axes.hierarchical_number(edition_nodes(spark, sf_dir), "lg").select("doc_id", "number")


@query("WITH c AS (SELECT count(*) AS n FROM conversations GROUP BY conv_id) SELECT 'san-Latn' AS value, sum(5 + 6 * n)::BIGINT - count(*) AS n FROM c UNION ALL SELECT 'eng', 3 * count(*) FROM c")
def nearest_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many elements each lang attribute holds for."""
    return axes.nearest_ancestor(edition_nodes(spark, sf_dir), "lang").groupBy("value").agg(F.count("*").alias("n"))


# languages


def languages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    langs = spark.createDataFrame([("san_other", "sanskrit", True), ("eng", "english", False)], "code string, id string, source boolean")
    scripts = spark.createDataFrame([("grantha", "grantha", True)], "code string, id string, source boolean")
    return langs, scripts


@query("WITH c AS (SELECT DISTINCT conv_id FROM conversations), t(tag, lang, script, k) AS (VALUES ('div', 'sanskrit', 'grantha', 1), ('p', 'sanskrit', 'grantha', 1), ('lg', 'sanskrit', 'grantha', 1), ('div', 'english', 'latin', 1), ('p', 'english', 'latin', 1), ('note', 'english', 'latin', 1)) SELECT tag, lang, script, sum(k)::BIGINT AS n FROM c, t GROUP BY ALL UNION ALL SELECT 'label', 'eng', 'latin', count(*) FROM conversations")
def edition_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = editions.assign_language(edition_nodes(spark, sf_dir), *languages(spark, sf_dir))
    return found.groupBy("tag", "lang", "script").agg(F.count("*").alias("n"))


@query("SELECT conv_id::VARCHAR AS doc_id, 'eng' AS before, 'french' AS after FROM conversations GROUP BY conv_id")
def bubbled_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paragraph whose parts all are in one language takes it; its heading does not count."""
    docs = turns(spark, sf_dir).groupBy("conv_id").agg(per_turn(F.lit('<seg lang="fra">'), F.col("xml"), F.lit("</seg>")).alias("x"))
    nodes = xml_nodes(docs.select(F.col("conv_id").cast("string").alias("doc_id"), F.concat(F.lit("<d><p><head>title</head>"), "x", F.lit("</p></d>")).alias("data")), "doc_id", "data")
    known = spark.createDataFrame([("fra", "french", False)], "code string, id string, source boolean")
    langs = editions.assign_language(nodes, known)
    both = langs.where("tag = 'p'").select("doc_id", "pre", F.col("lang").alias("before")).join(editions.bubble_up(nodes, langs).select("doc_id", "pre", F.col("lang").alias("after")), ["doc_id", "pre"])
    return both.select("doc_id", "before", "after")


@query("WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) SELECT 'lb' AS tag, 'zxx' AS lang, sum(n)::BIGINT AS n FROM c UNION ALL SELECT 'pb', 'zxx', count(*) FROM c UNION ALL SELECT 'p', 'sanskrit', count(*) FROM c UNION ALL SELECT 'p', 'english', count(*) FROM c UNION ALL SELECT 'lg', NULL, count(*) FROM c UNION ALL SELECT 'div', NULL, 2 * count(*) FROM c UNION ALL SELECT 'label', 'eng', sum(n)::BIGINT FROM c")
def final_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = edition_nodes(spark, sf_dir)
    found = editions.finish_language(nodes, editions.assign_language(nodes, *languages(spark, sf_dir)))
    return found.where("tag IN ('lb', 'pb', 'p', 'lg', 'div', 'label')").groupBy("tag", "lang").agg(F.count("*").alias("n"))


# views, lines and verses


@query(f"""
WITH c AS ({C}),
p AS (SELECT conv_id, unnest(['physical', 'logical', 'full']) AS view, turn, role, text, turn + 1 AS q FROM c),
x AS (SELECT conv_id, view, string_agg(text || CASE view WHEN 'physical' THEN '¿' || role || '?[' || repeat('*', q::INTEGER) || ']' WHEN 'logical' THEN '⟨' || upper(role) || '⟩[' || q || '+]' ELSE '¿' || role || '?⟨' || upper(role) || '⟩[' || q || '+]' END, '' ORDER BY turn) AS t FROM p GROUP BY conv_id, view)
SELECT conv_id::VARCHAR AS doc_id, view, 'p' AS kind, md5({SQUEEZED.format('t')}) AS text FROM x
UNION ALL SELECT conv_id::VARCHAR, view, 'l', md5({SQUEEZED.format('text')}) FROM p
""")
def views_of_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three views of editions' paragraphs and verses, in one pass over the nodes."""
    nodes = edition_nodes(spark, sf_dir).repartition(parts_for(table(spark, sf_dir, "conversations"), "text"), "doc_id")
    inside = marks.below(nodes, (F.col("tag") == "div") & (axes.attr(F.col("attrs"), "type") == "edition"))
    found = editions.edition_views(inside)
    return found.select("doc_id", "view", "kind", F.md5("text").alias("text"))


@query(f"WITH c AS ({C}) SELECT conv_id::VARCHAR AS doc_id, chr(97 + turn::INTEGER) AS n, NOT coalesce(runs_on, false) AS \"break\", md5({SQUEEZED.format('text')} || CASE WHEN right(text, 1) <> '.' THEN '-' ELSE '' END) AS text FROM c")
def edition_verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editions.verse_lines(edition_nodes(spark, sf_dir)).select("doc_id", "n", "break", F.md5("text").alias("text"))


PAGED = "SELECT conv_id, turn, role, text, greatest(1, sum((role = 'user')::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn)) AS page FROM conversations"


@query(f"WITH p AS ({PAGED}) SELECT conv_id::VARCHAR AS doc_id, page::BIGINT AS page, row_number() OVER (PARTITION BY conv_id, page ORDER BY turn) AS line, md5(text) AS text FROM p")
def page_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page and line of every text, from milestones; there is a first page before the first milestone."""
    return windows.page_line_cell(page_nodes(spark, sf_dir)).where("tag = '#text'").select("doc_id", F.col("page").cast("long").alias("page"), F.col("line").cast("long").alias("line"), F.md5("text").alias("text"))


@query(f"""
WITH p AS ({PAGED}), l AS (SELECT conv_id, page, row_number() OVER (PARTITION BY conv_id, page ORDER BY turn) AS line, {SQUEEZED.format('text')} AS text, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) % 2 = 1, false) AS goes_on FROM p)
SELECT conv_id::VARCHAR AS doc_id, page::BIGINT AS page, line, md5(text || CASE WHEN goes_on THEN '-' ELSE '' END) AS text FROM l
""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editions.physical_lines(page_nodes(spark, sf_dir)).select("doc_id", F.col("page").cast("long").alias("page"), F.col("line").cast("long").alias("line"), F.md5("text").alias("text"))


@query(f"""
WITH p AS (SELECT conv_id, turn, role, sum(2 + (role = 'user')::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn) AS last FROM conversations)
SELECT conv_id::VARCHAR AS doc_id, 'lb' AS tag, last::BIGINT AS pre, (last + 1)::BIGINT AS anchor FROM p UNION ALL SELECT conv_id::VARCHAR, 'pb', (last - 1)::BIGINT, (last + 1)::BIGINT FROM p WHERE role = 'user'
""")
def milestone_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text at which each milestone takes effect, by the nodes' numbers."""
    return editions.anchor_milestones(page_nodes(spark, sf_dir)).select("doc_id", "tag", F.col("pre").cast("long").alias("pre"), F.col("anchor").cast("long").alias("anchor"))


@query("""
WITH p AS (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), b AS (SELECT conv_id, role, turn, turn % 2 = 0 OR turn = first AS "break" FROM p)
SELECT conv_id::VARCHAR AS doc_id, 'lb' AS tag, "break", count(*) AS n FROM b GROUP BY ALL UNION ALL SELECT conv_id::VARCHAR, 'pb', "break", count(*) FROM b WHERE role = 'user' GROUP BY ALL
UNION ALL SELECT DISTINCT conv_id::VARCHAR, 'milestone', true, 1 FROM b
""")
def milestone_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages, lines and cells begin between words or within one; a cell that nothing follows is between."""
    t = F.col("turn").cast("string")
    rows = turns(spark, sf_dir).groupBy("conv_id").agg(per_turn(F.when(F.col("role") == "user", "<pb/> ").otherwise(""), F.lit('<lb n="'), t, F.when(F.col("turn") % 2 == 1, '" break="no"/>').otherwise('"/>'), F.col("xml")).alias("x"))
    nodes = xml_nodes(rows.select(F.col("conv_id").cast("string").alias("doc_id"), F.concat(F.lit("<d>"), "x", F.lit('<milestone break="no"/> </d>')).alias("data")), "doc_id", "data")
    return windows.milestone_breaks(nodes.where("depth > 0")).groupBy("doc_id", "tag", "break").agg(F.count("*").alias("n"))


CLEAN = r"trim(regexp_replace(translate(regexp_replace(translate(replace(regexp_replace(nfc_normalize({0}), '\[\d+.*?\]', '', 'g'), '[]', ''), 'ә_', 'ə '), '[◉◆“”.+\\,|/\"॥।*!]', '', 'g'), '''ʼ', '’’'), '[\s\xA0]+', ' ', 'g'))"


@query(f"WITH c AS ({C}), x AS (SELECT *, {CLEAN.format('text')} AS clean FROM c) SELECT conv_id::VARCHAR AS doc_id, chr(97 + turn::INTEGER) AS label, md5(CASE WHEN right(text, 1) <> '.' AND NOT starts_with(clean, '-') THEN '-' ELSE '' END || clean) AS text FROM x")
def edition_padas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editions.padas(edition_nodes(spark, sf_dir)).select("doc_id", "label", F.md5("text").alias("text"))


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def labels_in_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose labels run a, b, c …; a system's turn is labelled otherwise."""
    rows = table(spark, sf_dir, "conversations").withColumn("label", F.when(F.col("role") == "system", "#").otherwise(F.char(F.col("turn") + 97)))
    return similarity.in_sequence(rows, "conv_id", "label", "turn").select("conv_id", "turn", "role")


@query("""
WITH r AS (SELECT conv_id, turn, right(text, 1) = '.' AS ends, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS new FROM conversations))
SELECT conv_id, turn, bool_and(ends) OVER (PARTITION BY conv_id, run) OR run = 1 AS ends FROM r
""")
def runs_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all turns of a run end in a full stop; the first run counts as if."""
    rows = windows.run_ids(table(spark, sf_dir, "conversations").withColumn("ends", F.substring("text", -1, 1) == "."), "conv_id", "turn", "role")
    return windows.run_all(rows, "conv_id", "turn", "run", "ends").select("conv_id", "turn", "ends")


# lists, headings, metres, search


@query("SELECT conv_id::VARCHAR AS doc_id, turn + 1 AS n, role AS label, turn::VARCHAR AS item FROM conversations")
def edition_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editions.list_pairs(edition_nodes(spark, sf_dir)).select("doc_id", "n", "label", "item")


@query("WITH f AS (SELECT conv_id, min_by(role, turn) AS first FROM conversations GROUP BY conv_id) SELECT conv_id::VARCHAR AS doc_id, 'edition' AS type, 'Edition' AS heading, 1::BIGINT AS level FROM f UNION ALL SELECT conv_id::VARCHAR, 'translation', 'Translation into English' || CASE WHEN first = 'system' THEN '' ELSE ' by ' || upper(left(first, 1)) || substr(first, 2) || ' Speaker' END, 1 FROM f")
def edition_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = edition_nodes(spark, sf_dir)
    names = spark.createDataFrame([("eng", "English")], "code string, name string")
    return editions.division_headings(nodes, names, speakers(spark, sf_dir)).join(editions.outline(nodes), ["doc_id", "pre"]).select("doc_id", "type", "heading", "level")


@query("SELECT conv_id::VARCHAR AS doc_id, repeat('⏑–', count(*)::INTEGER) AS heading FROM conversations GROUP BY conv_id")
def edition_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("user", "-+"), ("assistant", "-+")], "name string, pattern string")
    return editions.meter_names(edition_nodes(spark, sf_dir), known).select("doc_id", "heading")


@query(f"""
WITH c AS ({C})
SELECT conv_id::VARCHAR AS doc_id, md5({SQUEEZED.format("string_agg(text || upper(role), '' ORDER BY turn)")} || chr(10) || string_agg({SQUEEZED.format('text')}, chr(10) ORDER BY turn) || chr(10) || any_value(n) || chr(10) || string_agg(role, '' ORDER BY turn) || chr(10) || string_agg(' ' || turn, chr(10) ORDER BY turn)) AS text FROM c GROUP BY conv_id
""")
def edition_search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search reads of each edition: the editor's readings, blocks as lines, list entries set off."""
    return editions.searchable_text(edition_nodes(spark, sf_dir)).select("doc_id", F.md5("text").alias("text"))


@query("SELECT conv_id::VARCHAR AS doc_id, string_agg(role || '.', '' ORDER BY turn) AS contracted, string_agg(role || turn, '' ORDER BY turn) AS expanded FROM conversations GROUP BY conv_id")
def abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).groupBy("conv_id").agg(per_turn(F.lit("<abbr>"), F.col("role"), F.lit("<am>.</am></abbr><ex>"), F.col("turn").cast("string"), F.lit("</ex>")).alias("x"))
    nodes = xml_nodes(rows.select(F.col("conv_id").cast("string").alias("doc_id"), F.concat(F.lit("<d><expan>"), "x", F.lit("</expan></d>")).alias("data")), "doc_id", "data")
    found = editions.abbreviation_forms(nodes).join(nodes.where("tag = 'expan'").select("doc_id", "pre"), ["doc_id", "pre"])
    return found.select("doc_id", "contracted", "expanded")


@query("""
WITH f AS (SELECT o_custkey, p_brand, min(l_linenumber * 10000000 + l_orderkey) AS at, min(p_partkey) AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
e AS (SELECT p_brand, arg_min(p_type, lpad(p_partkey::VARCHAR, 12, '0')) AS type FROM part GROUP BY 1)
SELECT o_custkey::VARCHAR AS doc_id, p_brand AS target, CASE WHEN type LIKE '%BRASS' OR type LIKE '%brass' THEN NULL ELSE 'unsupported type' END AS reason FROM f JOIN e USING (p_brand)
""")
def cited_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents that cite the brands of what they ordered: each brand once, with the reason why it is not in the bibliography."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    refs = lines.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set(F.concat(F.lit('<bibl><ptr target="bib:'), "p_brand", F.lit('"/></bibl>')))), "").alias("x"), F.min(F.concat(F.lit('<bibl n="A"><ptr target="bib:'), "p_brand", F.lit('"/></bibl>'))).alias("y"))
    nodes = xml_nodes(refs.select(F.col("o_custkey").cast("string").alias("doc_id"), F.concat(F.lit("<d>"), "x", F.lit("<listBibl>"), "y", F.lit("</listBibl></d>")).alias("data")), "doc_id", "data", ("bibl", "ptr"))
    kind = F.when(F.lower("p_type").endswith("brass"), "book").otherwise("gadget")
    entries = table(spark, sf_dir, "part").select(F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("key"), F.col("p_brand").alias("shortTitle"), kind.alias("itemType"))
    return editions.document_bibliography(nodes, entries).select("doc_id", "target", "reason")


# rules


@query("""
WITH c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (right(text, 1) <> '.') AS run_on, min_by(role, turn) AS first FROM conversations GROUP BY conv_id),
v AS (SELECT 'gap-unit' AS rule_id, sum(n) AS n FROM c UNION ALL SELECT 'gap-extent', 0 FROM c UNION ALL SELECT 'gap-parent', sum(n) FROM c UNION ALL SELECT 'lb-verse', sum(n) FROM c UNION ALL SELECT 'lg-met', 0 FROM c
UNION ALL SELECT 'one-item', sum(n > 1) FROM c UNION ALL SELECT 'lg-last', 0 FROM c UNION ALL SELECT 'item-label', 0 FROM c UNION ALL SELECT 'l-first', count(*) FROM c UNION ALL SELECT 'l-n', 0 FROM c
UNION ALL SELECT 'resp-known', count(*) FROM c UNION ALL SELECT 'lg-mixed', sum(n) FROM c UNION ALL SELECT 'lang-code', 0 FROM c UNION ALL SELECT 'enjamb-word', sum(run_on) FROM c UNION ALL SELECT 'editor-two', 0 FROM c UNION ALL SELECT 'lb-text', sum(n) FROM c UNION ALL SELECT 'ed-only', 0 FROM c)
SELECT rule_id, n::BIGINT AS n FROM v WHERE n > 0 GROUP BY ALL
""")
def edition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule of each kind and some that nothing breaks: how many violations of each."""
    given = [
        ("gap-unit", "requires", "gap", "quantity", "unit", "a counted gap needs a unit", 2, None), ("gap-extent", "excludes", "gap", "quantity", "extent", "count or extent, not both", 2, None), ("gap-parent", "parent", "gap", "ab seg", None, "gap outside a text block", 1, None),
        ("lb-verse", "ancestor", "lb", "lg", None, "line break outside a verse", 1, None), ("lg-met", "not-ancestor", "lg", "note", None, "verse in a note", 1, None), ("one-item", "max-child", "list", "item", "1", "several items", 1, None), ("lg-last", "last", "lg", None, None, "something follows the verse", 1, None),
        ("item-label", "preceded", "item", "label", None, "item without a label", 1, None), ("l-first", "child", "lg", "head", "1", "verse without a heading", 1, None), ("l-n", "unique", "lg", "n", "l", "two lines with one label", 2, None), ("resp-known", "target", "div", "resp", None, "nobody of that name", 2, None),
        ("lg-mixed", "parent-attr", "l", "met", "mixed", "metre on a line of a verse that is not mixed", 1, None), ("lang-code", "pattern", "div", "lang", "^[a-z]{3}(-.*)?$", "language code of three letters", 2, None), ("enjamb-word", "values", "l", "enjamb", "no", "a line that runs on", 0, None), ("editor-two", "count", "editor", "ref", "1", "several people", 2, None),
        ("lb-text", "text", "lb", None, None, "empty", 0, None), ("ed-only", "text", "lb", None, None, "empty", 0, "XX"),
    ]
    docs = edition_texts(spark, sf_dir).select("doc_id", F.lit("ED").alias("name"), F.lit("").alias("text"))
    found = rules.validate(docs, kept(edition_nodes(spark, sf_dir)), rules.rule_frame(spark, given))
    return found.groupBy("rule_id").agg(F.count("*").alias("n"))


@query(f"""
WITH b AS ({BROKEN}), c AS (SELECT conv_id, max(length(text)) > 400 AS long FROM conversations GROUP BY conv_id)
SELECT conv_id::VARCHAR AS doc_id, CASE WHEN broken THEN 3 ELSE 2 END AS status, CASE WHEN broken THEN 'parse' ELSE 'gap-unit' END AS worst FROM b JOIN c USING (conv_id)
""")
def edition_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each edition's worst severity and a rule behind it; what does not parse is not looked at further."""
    docs = with_broken(spark, sf_dir).select("doc_id", F.lit("ED").alias("name"), F.lit("").alias("text"), "data")
    given = rules.rule_frame(spark, [("gap-unit", "requires", "gap", "quantity", "unit", "a counted gap needs a unit", 2, "ED"), ("lb-text", "text", "lb", None, None, "empty", 1, None)])
    found = rules.validate(docs, kept(xml_nodes(docs, "doc_id", "data")), given)
    worst = found.groupBy("doc_id").agg(F.max_by("rule_id", "severity").alias("worst"))
    return rules.statuses(docs, found).join(worst, "doc_id").select("doc_id", F.col("status").cast("int").alias("status"), "worst")


UNUSUAL = "replace(replace(replace(text, 'tion', 'бum'), 'ch', 'q' || chr(772)), 'ou', 'r' || chr(805))"


@query(f"""
WITH t AS (SELECT doc_id, {UNUSUAL} AS text FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS line, lines FROM (SELECT doc_id, regexp_split_to_array(text, '[\\r\\n]') AS lines FROM t)),
n AS (SELECT doc_id, line, lines[line] AS x FROM l),
v AS (SELECT doc_id, line, 'б' AS cluster, length(x) - length(replace(x, 'б', '')) AS n FROM n UNION ALL SELECT doc_id, line, 'q' || chr(772), (length(x) - length(replace(x, 'q' || chr(772), ''))) // 2 FROM n)
SELECT doc_id, line::INTEGER AS line, cluster, n::BIGINT AS n FROM v WHERE n > 0
""")
def unicode_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unexpected clusters by line, in documents with a Cyrillic letter, an unknown and a known combination in place of some syllables."""
    changed = F.replace(F.replace(F.replace("text", F.lit("tion"), F.lit("бum")), F.lit("ch"), F.lit("q̄")), F.lit("ou"), F.lit("r̥"))
    docs = table(spark, sf_dir, "documents").select("doc_id", changed.alias("text"))
    return rules.grapheme_issues(docs).groupBy("doc_id", F.col("line").cast("int").alias("line"), "cluster").agg(F.count("*").alias("n"))
