"""Text, bibliography and JSON functions on small literal frames."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from marginalia.functions import bibliography as bib
from marginalia.functions import structured, text


def values(spark, f, *inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("x"))).collect()]


def test_normalize_text(spark):
    assert values(spark, text.normalize_text, "Éœuvre Süße", "  Đæ ", None) == ["eoeuvre susse", "dae", ""]
    assert values(spark, text.search_key, "Éœuvre Süße", "ŒÆß") == ["eoeuvre susse", "oeaess"]


def test_passages(spark):
    assert values(spark, text.normalize_passage, "R̥̄ta-ṁ ’x!") == ["ṝtaṃ ax"]
    assert values(spark, text.clean_passage, "a [12 n] b_c  ʼd' । []") == ["a b c ’d’"]
    assert values(spark, lambda c: F.sort_array(text.trigrams(c)), "abcabc", "ab", "") == [["abc", "bca", "cab"], [], []]
    assert values(spark, lambda c: text.jaccard(c, F.lit("abcd")), "abcd", "xyz", "ab", "abce") == [1.0, 0.0, 0.0, pytest.approx(1 / 3)]


def test_files_and_space(spark):
    assert values(spark, text.clean_file, "﻿\n\na  \n\nb \n\n", "", "é") == ["a\n\nb\n", "", unicodedata.normalize("NFC", "é") + "\n"]
    assert values(spark, text.squeeze, " a \n b\t", None) == ["a b", None]


def test_small_functions(spark):
    assert values(spark, text.sentence_case, "hELLO World  x", "one", None) == ["Hello World  x", "One", ""]
    assert values(spark, lambda c: text.to_boolean(c, False), "Yes", "0", "?") == [True, False, False]
    assert values(spark, text.meter_pattern, "-+=2", "12|॥") == ["⏑–⏓⏔", "12|||"]
    assert values(spark, text.is_meter, "-+|", "abc") == [True, False]
    assert values(spark, text.fraction, "1/2", "7/12", "x") == ["½", "7⁄12", "x"]
    assert values(spark, text.tamil_to_latin, "தமிழ்", "க") == ["tamiḻ", "ka"]
    assert values(spark, lambda c: text.format_url("/a/%s", c), "x y/é") == ["/a/x%20y/%C3%A9"]
    assert values(spark, text.markup_text, "<p>a&amp;b<script>1</script> c</p>") == ["a&b c"]
    assert values(spark, lambda c: text.absolute_link(c, F.lit("http://h.x/a/b?q")), "/c", "d", "http://z", "//e/f") == ["http://h.x/c", "http://h.x/a/d", "http://z", "http://e/f"]
    assert values(spark, lambda c: text.rewrite_ref(c, ["me.org"], "texts"), "https://me.org/texts/A.xml", "https://x.org/A.xml", "B.html") == ["/A", "https://x.org/A.xml", "/B"]
    assert values(spark, lambda c: text.gap_text(c, F.lit("3"), F.lit("character"), F.lit("high")), "lost", "illegible", None) == ["[3+]", "[3×]", "[3*]"]
    assert values(spark, lambda c: text.gap_text(F.lit("lost"), c, F.lit("character"), F.lit("low")), None, "2") == ["[…]", "[ca. 2+]"]
    assert values(spark, lambda c: text.plural(c, F.lit(2), {"child": "children"}), "child", "box", "city", "cat") == ["children", "boxes", "cities", "cats"]
    assert values(spark, text.clusters, "r̥̄a") == [["r̥̄", "a"]]


def test_bibliography(spark):
    who = [{"creatorType": "author", "firstName": "Ann", "lastName": "Lee", "name": None}, {"creatorType": "editor", "firstName": None, "lastName": "Ng", "name": None}]
    rows = [("k1", 1, {"itemType": "book", "shortTitle": "S", "title": "T", "date": "1990–1991", "extra": "Shorthand: XY\nx", "publisher": "n.pub", "place": "Rome", "edition": "2", "DOI": "https://doi.org/10.1/ab", "creators": who, "tags": [{"tag": "a"}]}), ("k2", 2, {"itemType": "journalArticle", "shortTitle": "S2", "title": "Q", "date": "n.d.", "creators": [], "pages": "1-2", "publicationTitle": "J"}), ("k3", 3, {"itemType": "note", "shortTitle": "S3"})]
    df = bib.flat_records(spark.createDataFrame(rows, bib.RECORD))
    assert [r.key for r in bib.eligible_entries(df).orderBy("key").collect()] == ["k1", "k2"]
    out = {r.key: r for r in bib.entry_text(bib.short_reference(bib.sort_key(bib.fix_record(df)))).collect()}
    assert out["k1"].shorthand == "XY" and out["k1"].publisher is None and out["k1"].sort_key == "XY k1"
    assert out["k1"].reference == "Lee and Ng 1990–1991" and out["k2"].reference == "Anonymous N.d."
    assert out["k1"].entry.startswith("XY. T. 2nd edition. Rome, 1990–1991.") and "DOI: 10.1/ab." in out["k1"].entry
    assert out["k2"].entry == "Anonymous. N.d. “Q.” J, pp. 1–2." and out["k3"].entry is None and out["k3"].sort_key is None
    assert [tuple(r) for r in bib.unnest_tags(df).collect()] == [("k1", "a")]
    assert bib.unnest_creators(df).count() == 2
    ranges = spark.createDataFrame([([("page", "3-4"), ("mixed", "x"), ("note", "1")],)], "r array<struct<unit:string,value:string>>")
    assert ranges.select(bib.cited_ranges(F.col("r"))).first()[0] == "pp.\u00a03–4, x, n.\u00a01"
    assert values(spark, bib.doi, "https://doi.org/10.1163/2", "https://w.com/the/10.5/x", "no") == ["10.1163/2", "10.5/x", None]


def test_json(spark):
    assert values(spark, structured.json_type, "[1]", '{"a":1}', '"x"', "1", "1.5", "null", "{") == ["array", "object", "text", "integer", "real", "null", None]
    assert values(spark, structured.json_length, "[1,2]", "{}", "?") == [2, 0, None]
    assert values(spark, lambda c: structured.json_elements(c), '["a","b"]') == [["a", "b"]]


def test_references_of_characters(spark):
    from marginalia.functions import bibliography

    df = spark.createDataFrame([("&lt;i&gt; &amp;lt; &#233;&#xE9; &eacute;&mdash;e&#x301;&nbsp;x &unknown; &",), (None,)], "x string")
    assert [r[0] for r in df.select(bibliography.unescape(F.col("x"))).collect()] == ["<i> &lt; éé é—é x &unknown; &", None]


def test_milestone_breaks(spark):
    from marginalia.operators import windows
    from marginalia.sources.nodes import xml_nodes

    texts = ["<d><pb break='no'/> <lb/><milestone/>a<pb/><lb break='no'/>b<lb/><lb break='no'/>c<milestone break='no'/>d<lb break='no'/><milestone break='no'/> </d>", "<d>a<pb break='no'/><hi/><lb/>b<lb break='no'/>c</d>", "<d>x</d>"]
    nodes = xml_nodes(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "i string, x string"), "i", "x")
    got = {}
    for r in windows.milestone_breaks(nodes.where("depth > 0")).orderBy("doc_id", "pre").collect():
        got.setdefault(r.doc_id, []).append((r.tag, r["break"]))
    assert got["0"] == [("pb", True), ("lb", True), ("milestone", True), ("pb", False), ("lb", False), ("lb", True), ("lb", False), ("milestone", False), ("lb", True), ("milestone", True)]
    assert got["1"] == [("pb", False), ("lb", True), ("lb", False)]


def test_composed_by_line(spark):
    """Lines, not whole texts, are composed in Python; what becomes ASCII is expected."""
    from marginalia.functions.text import nfc
    from marginalia.operators import rules

    given = [(1, "ascii\nб\r\nq̄ é\rK"), (2, None), (3, "̄\ńa" * 300), (4, "plain")]
    found = rules.grapheme_issues(spark.createDataFrame(given, "doc_id long, text string")).drop("names")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("posexplode(split(")
    rows = [(r.doc_id, r.line, r.place, r.cluster) for r in found.collect()]
    assert sorted(rows) == [(1, 2, 0, "б"), (1, 4, 0, "q̄")]
    texts = [None if i % 7 == 0 else f"é{i}" for i in range(1000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").coalesce(1)
    assert [r[0] for r in df.orderBy("i").select(nfc(F.col("t"))).collect()] == [t and unicodedata.normalize("NFC", t) for t in texts]
