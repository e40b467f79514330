"""Node tables, editions, rules, joins, increments and streams on small literal frames."""

import itertools

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.operators import axes, catalog, editions, rules, similarity, statistics, upserts, windows
from marginalia.sources import files
from marginalia.sources.nodes import html_nodes, parse_failures, xml_nodes
from marginalia.streaming.feeds import merge_batches, read_merged, refresh_ticks

TEI = """<TEI xmlns="http://x"><teiHeader><title>One</title><author>A</author></teiHeader><text><body>
<div type="edition" lang="san-Latn"><p n="1">ka<lb n="1"/>ra <choice><sic>bad</sic><corr>good</corr></choice> <supplied>lost</supplied><note>n</note></p>
<lg n="5" met="-+"><l n="a" enjamb="yes">rama </l><l n="b"> sita<lb n="2" break="no"/>m</l></lg></div>
<div type="translation" resp="part:p1" lang="eng"><head>Head</head>loose <hi>x</hi><p>told</p></div>
<list><label>k</label><item>v</item><item>w</item></list></body></text></TEI>"""


def nodes(spark, *texts):
    return xml_nodes(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, data string"), "id", "data").cache()


def test_nodes_and_axes(spark):
    n = nodes(spark, "<a k='1  2'><b>x</b>\n<b>y<c/></b></a>", "<a><b></a>")
    tags = {r.pre: r for r in n.where("doc_id = '0'").collect()}
    assert tags[1].attrs == {"k": "1 2"} and tags[2].parent == 1
    assert parse_failures(spark.createDataFrame([("1", "<a><b></a>"), ("2", "<a/>")], "id string, d string"), "id", "d").select("doc_id", "line").collect() == [("1", 1)]
    b = n.where("doc_id = '0' AND tag = 'b'")
    count = lambda name: axes.axis(axes.elements(n), b, name).count()
    assert [count(x) for x in ("self", "parent", "ancestor", "descendant", "following-sibling", "preceding-sibling")] == [2, 2, 2, 1, 1, 1]
    stuck = lambda name: {(r.context, r.pre) for r in axes.stuck_axis(n, b, name).collect()}
    first, second = sorted(r.pre for r in b.collect())
    assert stuck("next") == {(first, second)} and stuck("previous") == {(second, first)} and stuck("parent") == {(first, 1)}
    flags = {r.pre: r for r in axes.node_flags(n).where("doc_id = '0'").collect()}
    assert flags[second].mixed and flags[first].plain and not flags[1].mixed
    assert {r.content for r in axes.text_of(n, "b").collect()} == {"x", "y"}
    assert html_nodes(spark.createDataFrame([("1", "<p>a<br>b")], "i string, h string"), "i", "h").where("tag = '#text'").count() == 2


def test_editions(spark):
    n = nodes(spark, TEI)
    views = {(r.view, r.kind): r.text for r in editions.edition_views(n, editions.rule_table(spark)).where("kind = 'p'").where(F.col("text").contains("ka")).collect()}
    assert views["physical", "p"] == "kara ¿bad? [lost]" and views["logical", "p"] == "kara ⟨good⟩ [lost]"
    codes = spark.createDataFrame([("san", "Sanskrit", True), ("eng", "eng", False)], "code string, id string, source boolean")
    langs = editions.assign_language(n, codes)
    got = {(r.tag, r.lang, r.script) for r in langs.collect()}
    assert {("div", "Sanskrit", "source_other"), ("lg", "Sanskrit", "source_other"), ("div", "eng", "latin"), ("note", "Sanskrit", "source_other")} <= got and "TEI" not in {x[0] for x in got}
    assert editions.bubble_up(n, langs).count() == langs.count()
    assert {r.lang for r in editions.finish_language(n, langs).where("tag = 'lb'").collect()} == {"zxx"}
    verse = editions.verse_lines(n).orderBy("pre").collect()
    assert [(r.text, r["break"]) for r in verse] == [("rama-", True), ("sitam", False)]
    assert [(r.label, r.text) for r in editions.padas(n).orderBy("pre").collect()] == [("a", "-rama"), ("b", "sitam")]
    assert editions.searchable_text(n).first().text.startswith("kara good lost\n")
    assert [(r.label, r["item"]) for r in editions.list_pairs(n).orderBy("n").collect()] == [("k", "v"), ("", "w")]
    heads = {r.type: r.heading for r in editions.division_headings(n, spark.createDataFrame([("eng", "English")], "code string, name string"), spark.createDataFrame([("p1", ["Jo", "Do"])], "person_id string, name array<string>")).collect()}
    assert heads == {"edition": "Edition", "translation": "Head"}
    assert {r.kind for r in editions.segment_blocks(n).collect()} == {"p", "lg", "head"}
    assert {r.level for r in editions.outline(n).collect()} == {1}
    assert editions.meter_names(n, spark.createDataFrame([], "name string, pattern string")).first().heading == "⏑–"
    assert [r.page for r in editions.physical_lines(n).collect()] and editions.anchor_milestones(n).count() == 2
    record = catalog.document_record(n).first()
    assert record.title == "One" and record.authors == ["A"] and "eng" in record.langs
    forms = editions.abbreviation_forms(nodes(spark, "<d><expan><abbr>a<am>.</am></abbr><ex>bc</ex></expan></d>")).orderBy("pre").first()
    assert (forms.contracted, forms.expanded) == ("a.", "abc")
    assert axes.hierarchical_number(nodes(spark, "<d><div n='1'><div n='2'><lg n='3'/></div></div></d>"), "lg").first().number == "1.2.3"


def test_rules(spark):
    n = nodes(spark, "<r><a x='1' y='2'/><b/><c id='q'/><c ref='#z'/><l n='a'/><l n='a'/><p> </p></r>", "<r>")
    given_rules = [("ex", "excludes", "a", "x", "y", "m", 2, None), ("req", "requires", "a", "x", "z", "m", 2, None), ("par", "parent", "b", "q", None, "m", 1, None), ("na", "not-ancestor", "b", "r", None, "m", 1, None), ("ch", "child", "r", "z", "1", "m", 1, None), ("last", "last", "b", None, None, "m", 1, None), ("pre", "preceded", "c", "b", None, "m", 1, None), ("tgt", "target", "c", "ref", None, "m", 1, None), ("uq", "unique", "r", "n", "l", "m", 1, None), ("pa", "parent-attr", "b", "k", None, "m", 1, None), ("pat", "pattern", "a", "x", "^[0-9]$", "m", 1, None), ("val", "values", "a", "y", "1 3", "m", 1, None), ("txt", "text", "p", None, None, "m", 1, None), ("off", "text", "p", None, None, "m", 1, "ZZ")]
    docs = spark.createDataFrame([("0", "AB", "ok"), ("1", "AB", "б")], "doc_id string, name string, text string")
    found = rules.validate(docs, n, rules.rule_frame(spark, given_rules)).cache()
    hit = {r.rule_id for r in found.where("doc_id = '0'").collect()}
    assert hit == {"ex", "req", "par", "na", "ch", "last", "pre", "tgt", "uq", "pa", "val", "txt"}
    assert {r.rule_id for r in found.where("doc_id = '1'").collect()} == {"parse"}
    assert {r.doc_id: r.status for r in rules.statuses(docs, found).collect()} == {"0": 2, "1": 3}
    assert rules.unicode_report(docs).first().message == "unexpected character: CYRILLIC SMALL LETTER BE"
    staged = rules.validate(docs, n, rules.rule_frame(spark, given_rules), rules.rule_frame(spark, [("first", "child", "r", "nothing", "1", "m", 3, None)]))
    assert {r.rule_id for r in staged.where("doc_id = '0'").collect()} == {"first"}


def test_graphemes(spark):
    df = spark.createDataFrame([(1, "α ಕ್ r\u0325\nq\u0304 б\rә க்ष b\u0308\u0323")], "doc_id long, text string")
    got = [(r.line, r.cluster) for r in rules.grapheme_issues(df).orderBy("line", "place").collect()]
    assert got == [(2, "q\u0304"), (2, "б"), (3, "\u1e05\u0308")]


def test_two_documents(spark):
    """State never passes from one document to the next."""
    n = nodes(spark, "<d><lg><l n='a' enjamb='yes'>x</l><l n='b' enjamb='true'>y</l></lg></d>", "<d><lg><l n='a'>z</l><l n='b'>w</l></lg></d>")
    assert [(r.doc_id, r["break"]) for r in editions.verse_lines(n).orderBy("doc_id", "pre").collect()] == [("0", True), ("0", False), ("1", True), ("1", True)]
    n = nodes(spark, "<TEI><div type='edition'><p>x<foreign lang='eng'>y</foreign></p></div><div lang='tam'><p lang='eng'>z</p><p rendition='class:grantha'>u</p></div></TEI>", "<TEI><div><q>v</q></div></TEI>")
    langs = spark.createDataFrame([("tam", "tam", True), ("eng", "eng", False)], "code string, id string, source boolean")
    scripts = spark.createDataFrame([("grantha", "grantha", True)], "code string, id string, source boolean")
    got = [(r.doc_id, r.tag, r.lang, r.script) for r in editions.assign_language(n, langs, scripts).orderBy("doc_id", "pre").collect()]
    other = "source_other"
    assert got == [("0", "div", other, other), ("0", "p", other, other), ("0", "foreign", other, other), ("0", "div", "tam", other), ("0", "p", "eng", "latin"), ("0", "p", "tam", "grantha"), ("1", "div", "eng", "latin"), ("1", "q", "eng", "latin")]
    n = nodes(spark, "<d><p>a<gap quantity='3' reason='lost'/>b<gap/><gap reason='ellipsis'/>c<gap quantity='2' unit='line' reason='illegible' precision='low'/></p></d>", "<d><p>x<space type='vacat' quantity='2'/>y<g type='numeral'>3/4</g><g type='danda'>.</g><choice><sic>s</sic><corr>c</corr></choice><corr>k</corr></p></d>")
    views = {(r.doc_id, r.view): r.text for r in editions.edition_views(n, editions.rule_table(spark), spark.createDataFrame([("danda", "।")], "name string, text string")).collect()}
    assert views["0", "full"] == "a[3+]b[…]…c[ca. 2 illegible lines]" and views["0", "physical"] == "a[***]b[…]…c[ca. 2 illegible lines]"
    assert views["1", "full"] == "x__y¾।¿s?⟨c⟩⟨k⟩" and views["1", "logical"] == "x__y¾।⟨c⟩⟨k⟩" and views["1", "physical"] == "x__y¾।¿s?⟨k⟩"


def test_search_offsets(spark):
    df = spark.createDataFrame([("d", "süße")], "doc_id string, text string").withColumn("folded", F.lit("süsse"))
    spans = lambda needle: [(r.display_start, r.display_length) for r in catalog.to_display_offsets(catalog.match_offsets(df, "folded", needle), "text").orderBy("start").collect()]
    assert spans("se") == [(2, 2)] and spans("üs") == [(1, 2)] and spans("s") == [(0, 1), (2, 1)]


def test_catalog_joins(spark):
    people = spark.createDataFrame([("p1", ["Ann", "Lee"]), ("p2", ["Solo"])], "person_id string, name array<string>")
    git = spark.createDataFrame([("al", "p1")], "git_name string, person_id string")
    owners = spark.createDataFrame([("f1", "al"), ("f1", "zz"), ("f2", "zz")], "name string, git_name string")
    docs = spark.createDataFrame([("f1", 1), ("f2", 3)], "name string, status int")
    assert {r.display for r in catalog.plain_name(owners, people, git).collect()} == {"Ann Lee", "zz"}
    assert {r.name for r in catalog.by_owner(docs, owners, git, "!zz").collect()} == {"f1", "f2"} and catalog.by_owner(docs, owners, git, "p1").count() == 1
    rows = spark.createDataFrame([("d", 1, "", "Ann Lee"), ("d", 2, "part:p1", "A. L."), ("d", 3, "", "Bo"), ("d", 4, "part:none", "John Doe"), ("d", 5, "part:zz", " Bo "), ("e", 1, "p2", "")], "doc_id string, pre int, id string, name string")
    assert {(r.doc_id, tuple(r.ids), tuple(r.names)) for r in catalog.merge_contributors(rows, people, "none").collect()} == {("d", ("p1", None), ("Ann Lee", "Bo")), ("e", ("p2",), ("Solo",))}
    refs = spark.createDataFrame([("A",), ("B",), ("",)], "target string")
    entries = spark.createDataFrame([("k", "A", "book"), ("l", "B", "note")], "key string, shortTitle string, itemType string")
    assert {r.target: r.reason for r in catalog.resolve_reference(refs, entries, ["book"]).collect()} == {"A": None, "B": "unsupported type", "": "missing title"}
    codes = spark.createDataFrame([("tam", "t1"), ("san_other", "s9")], "code string, id string")
    assert {r.code: r.id for r in catalog.resolve_code(spark.createDataFrame([("san",), ("tam",)], "code string"), codes).collect()} == {"san": "s9", "tam": "t1"}
    assert spark.createDataFrame([("abc.xml",)], "x string").select(catalog.glob_match(F.col("x"), "a*[!z].x?l")).first()[0]
    assert catalog.page_bounds(101, 9, 50) == (3, 101, 101) and catalog.page_bounds(0, 1) == (1, 0, 0)
    scan = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    assert catalog.with_fallback_record(scan, spark.createDataFrame([("a", ["x"])], "doc_id string, langs array<string>")).where("doc_id = 'b'").first().langs == ["und"]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abc", max_size=12), min_size=2, max_size=14), st.sampled_from([0.3, 0.5, 0.8]))
def test_similar_pairs_equals_brute_force(spark, texts, t):
    grams = [{x[i : i + 3] for i in range(len(x) - 2)} for x in texts]
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if grams[i] and grams[j] and len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= t}
    df = spark.createDataFrame([(1, i, sorted(g)) for i, g in enumerate(grams)], "k int, id long, g array<string>")
    assert {(r.id, r.id2) for r in similarity.similar_pairs(df, "id", "g", "k", t).collect()} == want


def test_windows(spark):
    marks = nodes(spark, "<d>a<pb/>b<lb/>c<lb/>d<milestone/>e<pb/>f</d>")
    got = {r.text: (r.page, r.line, r.cell) for r in windows.page_line_cell(marks).where("tag = '#text'").collect()}
    assert got == {"a": (1, 1, 1), "b": (1, 1, 1), "c": (1, 1, 1), "d": (1, 2, 1), "e": (1, 2, 2), "f": (2, 1, 1)}
    df = spark.createDataFrame([("d", 1, 1, True), ("d", 2, 2, False), ("d", 3, 2, True)], "doc string, pos int, run int, flag boolean")
    assert [r.flag for r in windows.run_all(df, "doc", "pos", "run", "flag").orderBy("pos").collect()] == [True, False, False]
    verses = spark.createDataFrame([("v", "a", 1), ("v", "b", 2), ("w", "a", 1), ("w", "c", 2)], "v string, n string, pos int")
    assert {r.v for r in similarity.in_sequence(verses, "v", "n", "pos").collect()} == {"v"}


def test_closure_properties(spark):
    df = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a")], "id string, parent string")
    closed = statistics.closure(df, "id", "parent")
    assert {tuple(x) for x in closed.collect()} == {("r", "r", 0), ("a", "a", 0), ("b", "b", 0), ("a", "r", 1), ("b", "a", 1), ("b", "r", 2)}
    assert [x.id for x in statistics.children_of(closed, "r").collect()] == ["a"]


def test_increments(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "key string, version int, v string")
    new = spark.createDataFrame([("a", 3, "z"), ("c", 4, "w")], "key string, version int, v string")
    once = upserts.upsert_latest(old, new, "key", "version")
    assert {tuple(r) for r in once.collect()} == {("a", 3, "z"), ("b", 2, "y"), ("c", 4, "w")}
    assert {tuple(r) for r in upserts.upsert_latest(once, new, "key", "version").collect()} == {tuple(r) for r in once.collect()}
    assert {r.v for r in upserts.upsert(old, new, "key", "nothing").collect()} == {"x", "y", "w"}
    gone = spark.createDataFrame([("c",)], "key string")
    assert {r.key for r in upserts.merge_feed(old, new, gone, 3).collect()} == {"a", "b"} and {r.key for r in upserts.merge_feed(old, new, gone, 0).collect()} == {"a"}
    assert upserts.next_mark(new, 2).first().mark == 4
    scan = spark.createDataFrame([("f", "r1", 5), ("g", "r1", 9), ("h", "r2", 1), ("i", "r3", 1)], "name string, repo string, mtime int")
    state = spark.createDataFrame([("r1", "c2", "k", "c1", "k", 5), ("r2", "c2", "k2", "c1", "k", 5), ("r3", "c", "k", "c", "k", 0)], "repo string, commit_hash string, code_hash string, old_commit string, old_code string, high_water int")
    assert {r.name for r in upserts.pending_files(scan, state).collect()} == {"g", "h"}
    kept = upserts.delete_cascade({"t": old}, "key", gone.withColumn("key", F.lit("a")))["t"]
    assert [r.key for r in kept.collect()] == ["b"]
    assert {r.key: r.value for r in upserts.stamp(spark.createDataFrame([("last_batch", "1")], "key string, value string"), 7, F.lit(5)).collect()} == {"last_updated": "5", "last_batch": "7"}


def test_streams_equal_batches(spark, tmp_path):
    rows = [("a", 1, False), ("b", 2, False), ("a", 3, False), ("b", 4, True)]
    df = spark.createDataFrame(rows, "key string, version int, deleted boolean")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(merge_batches(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.key, r.version) for r in read_merged(spark, str(tmp_path / "out"), "key string, version int").collect()] == [("a", 3)]
    events = spark.createDataFrame([("2024-01-01 00:10:00",), ("2024-01-01 00:50:00",), ("2024-01-01 02:00:00",)], "t string").select(F.to_timestamp("t").alias("ts"))
    assert sorted(r.notices for r in refresh_ticks(events).collect()) == [1, 2]


def test_files(spark, tmp_path):
    (tmp_path / "c/.git").mkdir(parents=True)
    for name in ("ED_INSx.xml", "ED_template.xml", "other.xml", ".git/ED_INSy.xml", "ED_INSz.XML"):
        (tmp_path / "c" / name).write_text("<a/>")
    scan = files.with_file_facts(files.scan_corpus(spark, str(tmp_path / "c"), ["ED_INS"]))
    assert {r.name for r in scan.collect()} == {"ED_INSx", "ED_INSz"}
    (tmp_path / "s.tsv").write_text("names\ttext\tdescription\tsearch\na b\tX\t\t\nc\tY\td\ts\n")
    assert {tuple(r) for r in files.read_symbols(spark, str(tmp_path / "s.tsv")).collect()} == {("a", "X", "a", "X"), ("b", "X", "b", "X"), ("c", "Y", "d", "s")}
    pages = spark.createDataFrame([("u", "x\nBEGIN 1\na\nb\nEND\nz\nBEGIN 2\nc\nEND")], "url string, data string")
    assert [r.body for r in files.marked_segments(pages, "url", "data", "^BEGIN", "^END").orderBy("entry").collect()] == ["a\nb", "c"]
    (tmp_path / "b.jsonl").write_text('{"key":"k","version":1,"data":{"itemType":"book","shortTitle":"s"}}\nbroken\n')
    assert files.read_bibliography(spark, str(tmp_path / "b.jsonl")).count() == 1
    files.dump_sorted_json(spark.createDataFrame([("b", 1), ("a", 2)], "key string, v int"), "key", str(tmp_path / "dump"))
    assert spark.read.text(str(tmp_path / "dump")).count() == 2


def test_references_of_documents(spark):
    """The first reference of each target, listed ones before others, from one reading of the markup."""
    docs = [
        ("1", '<d><bibl n="B"><ptr target="bib:a"/></bibl><bibl><ptr target="bib:b"/><ptr target="c"/></bibl><listBibl><p><bibl n="A"><ptr target="bib:a"/><b><ptr target="far"/></b></bibl></p></listBibl><p><ptr target="loose"/></p><bibl><ptr/></bibl></d>'),
        ("2", '<ptr target="root"/>'), ("3", "<d><bibl/></d>"), ("4", "<d>"), ("5", '<d><listBibl><bibl><bibl n="in"><ptr target="b"/></bibl><ptr target="b"/></bibl></listBibl></d>'),
    ]
    nodes = xml_nodes(spark.createDataFrame(docs, "doc_id string, data string"), "doc_id", "data")
    entries = spark.createDataFrame([("k2", "a", "book"), ("k1", "b", "gadget")], "key string, shortTitle string, itemType string")
    found = editions.document_bibliography(nodes, entries)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {(r.doc_id, r.pre, r.siglum, r.target, r.listed, r.entry_key, r.reason) for r in found.collect()} == {
        ("1", 9, "A", "a", True, "k2", None), ("1", 4, "", "b", False, "k1", "unsupported type"), ("1", 4, "", "c", False, None, "not in bibliography"),
        ("1", 15, "", "", False, None, "missing title"), ("5", 3, "", "b", True, "k1", "unsupported type"),
    }
    some = xml_nodes(spark.createDataFrame(docs, "doc_id string, data string"), "doc_id", "data", ("bibl", "ptr"))
    assert sorted(map(tuple, editions.document_bibliography(some, entries).collect()), key=str) == sorted(map(tuple, found.collect()), key=str)
