"""Nested readers and rebuilds of derived rows."""

from pyspark.sql import functions as F

from marginalia.operators import catalog, upserts
from marginalia.sources import prosody
from marginalia.sources.nodes import xml_nodes

LIST = """<TEI xmlns="http://x"><text><body><list><head>Even  ones</head>
<item xml:id="a"><measure unit="syllable">22</measure><label type="generic" xml:lang="san-Latn">vikr̥ti</label><label type="other">no</label>
<name xml:lang="san-Latn">campaka<hi>mālā</hi></name><name> </name><name xml:lang="tam">second</name><name>third</name>
<seg type="xml">-+/</seg><seg type="prosody">-+||</seg><seg type="prosody">later</seg><seg type="gana">no data available</seg>
<note resp="part:ab part:zz">first <b>note</b></note><note/><note>second</note>
<listBibl><bibl><ptr target="bib:AuthorYear_01"/><note>lost</note></bibl><bibl><ptr target="bib:Key_01"/><citedRange>7</citedRange><citedRange unit="chapter">8</citedRange><citedRange unit="verse"> </citedRange><note>n1</note><note resp="part:ab">n2</note></bibl><bibl><note>none</note></bibl><bibl><ptr target="bib:Key_02"/><note>n3</note></bibl></listBibl></item>
<item><name>bare</name><seg type="xml"> </seg><note>what it is</note></item></list>
<list><item><name>fourth</name><seg type="gana">na-ja</seg></item></list></body></text></TEI>"""


def frames(spark):
    langs = spark.createDataFrame([("san", "sanskrit", "Sanskrit"), ("tam", "tamil", "Tamil"), ("und", "undetermined", "Undetermined")], "code string, id string, name string")
    people = spark.createDataFrame([("ab", ["Ann", "Bee"]), ("jo", ["Jo", "Do"])], "person_id string, name array<string>")
    return langs, people


def test_prosody(spark, tmp_path):
    (tmp_path / "list.xml").write_text(LIST)
    files = spark.read.text(str(tmp_path), wholetext=True).select(F.lit("list").alias("id"), "value")
    items = prosody.prosody_items(xml_nodes(files, "id", "value"), *frames(spark), "jo")
    a, b, c = (r.asDict(True) for r in items.orderBy("entry_id").collect())
    san, und = {"id": "sanskrit", "name": "Sanskrit"}, {"id": "undetermined", "name": "Undetermined"}
    ann, jo = {"id": "ab", "name": "Ann Bee"}, {"id": "zz", "name": "Jo Do"}
    assert (a["entry_id"], a["heading"], a["syllables"], a["xml"], a["prosody"], a["gana"]) == (1, "Even ones", "22", "-+/", "-+||", None)
    assert a["class"] == {"text": "vikr̥ti", "lang": san}
    assert a["names"] == [{"text": "campakamālā", "lang": san}, {"text": "second", "lang": {"id": "tamil", "name": "Tamil"}}, {"text": "third", "lang": und}]
    assert a["notes"] == [{"text": "first note", "authors": [ann, jo]}, {"text": "second", "authors": []}]
    assert a["refs"] == [{"key": "Key_01", "locations": [{"unit": "page", "value": "7"}, {"unit": "mixed", "value": "8"}], "symbols": "*†"}, {"key": "Key_02", "locations": [], "symbols": "‡"}]
    assert a["ref_notes"] == [{"symbol": "*", "text": "n1", "authors": []}, {"symbol": "†", "text": "n2", "authors": [ann]}, {"symbol": "‡", "text": "n3", "authors": []}]
    assert (b["entry_id"], b["xml"], b["refs"], c["entry_id"], c["heading"], c["gana"], c["syllables"]) == (2, None, [], 3, None, "na-ja", None)
    index = {(r.name, r.entry_id, r.pattern, r.description) for r in prosody.prosody_index(items).collect()}
    assert index == {("campakamālā", 1, "⏑–||", None), ("second", 1, "⏑–||", None), ("third", 1, "⏑–||", None), ("bare", 2, None, "what it is"), ("fourth", 3, "na-ja", None)}


def test_scripts(spark):
    text = "<scripts><script><id>brahmi</id><id>br</id><id>br</id><name>Brāhmī <b>family</b></name><script><id>grantha</id><inverted_name>script, Grantha</inverted_name><script><id>vatteluttu</id></script></script><script><name>no code</name></script></script></scripts>"
    got = {r.id: r for r in prosody.nested_scripts(xml_nodes(spark.createDataFrame([("1", text)], "i string, x string"), "i", "x")).collect()}
    assert {k: (r.codes, r.name, r.inverted_name, r.parent, r.above) for k, r in got.items()} == {
        "brahmi": (["brahmi", "br"], "Brāhmī family", "Brāhmī family", None, []),
        "grantha": (["grantha"], "grantha", "script, Grantha", "brahmi", ["brahmi"]),
        "vatteluttu": (["vatteluttu"], "vatteluttu", "vatteluttu", "grantha", ["brahmi", "grantha"]),
    }


def test_rebuild(spark):
    met = spark.sparkContext.accumulator(0)

    def counted(df):
        nodes = xml_nodes(df, "name", "data").where("tag <> '#error'")
        met.add(df.count())
        return nodes

    record = lambda nodes: catalog.document_record(nodes).select("doc_id", "title", F.size("authors").alias("authors"))
    doc = lambda t, n=1: f"<TEI><title>{t}</title>{'<author>A</author>' * n}</TEI>"
    frame = lambda rows: spark.createDataFrame(list(rows.items()), "name string, data string")
    none = spark.createDataFrame([], "name string, input_hash string, rules string, title string, authors int")
    files = {"a": doc("one"), "b": doc("two", 2), "c": "<broken", "d": None}
    first = upserts.rebuild_changed(frame(files), none, counted, record, "r1").checkpoint()
    rows = lambda df: {r["name"]: (r.title, r.authors, r.rules) for r in df.collect()}
    assert rows(first) == {"a": ("one", 1, "r1"), "b": ("two", 2, "r1"), "c": (None, None, "r1"), "d": (None, None, "r1")} and met.value == 4
    del files["d"]
    files |= {"b": doc("changed"), "e": doc("new")}
    second = upserts.rebuild_changed(frame(files), first, counted, record, "r1").checkpoint()
    assert rows(second) == {"a": ("one", 1, "r1"), "b": ("changed", 1, "r1"), "c": (None, None, "r1"), "e": ("new", 1, "r1")} and met.value == 6
    third = upserts.rebuild_changed(frame(files), second, counted, record, "r2")
    assert {r for _, _, r in rows(third).values()} == {"r2"} and met.value == 10
