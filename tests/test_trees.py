"""Segmentation and spaces on small documents, each with the exact markup that comes out."""

import pytest

from marginalia.operators import trees
from marginalia.sources.nodes import xml_nodes

SPACES = [
    ("<TEI><p>foo<hi><ref> bar</ref></hi></p></TEI>", "<TEI><p>foo <hi><ref>bar</ref></hi></p></TEI>"),
    ("<TEI><p> foo <hi> bar </hi> </p>\n</TEI>", "<TEI><p>foo <hi>bar</hi></p></TEI>"),
    ("<TEI><p>a<hi>x </hi><num> y</num>z</p></TEI>", "<TEI><p>a<hi>x</hi> <num>y</num>z</p></TEI>"),
    ("<TEI><p>a <hi>x<ref>y </ref></hi>z  w</p></TEI>", "<TEI><p>a <hi>x<ref>y</ref></hi> z w</p></TEI>"),
    ("<TEI><p>a<hi> </hi>b <hi/><hi><ref> </ref></hi>c</p></TEI>", "<TEI><p>a b c</p></TEI>"),
    ("<TEI><p>a <note> n </note> b <lb/> c<hi>d </hi><lb/><pb/> </p></TEI>", "<TEI><p>a<note>n</note> b<lb></lb>c<hi>d</hi><lb></lb><pb></pb></p></TEI>"),
    ("<TEI><p>a<hi>x </hi><note>n</note>, a <hi><note>m</note></hi> b<hi> <note>k</note></hi></p></TEI>", "<TEI><p>a<hi>x</hi><note>n</note>, a <hi><note>m</note></hi> b<hi><note>k</note></hi></p></TEI>"),
    ("<TEI><p>a <gap/> b<gap/> <gap/><hi> c</hi></p></TEI>", "<TEI><p>a <gap></gap> b<gap></gap> <gap></gap> <hi>c</hi></p></TEI>"),
    ("<TEI><div><head>h</head></div><div><p> </p><head>k</head><p>x</p></div><lg><head>v</head></lg></TEI>", "<TEI><div><head>k</head><p>x</p></div></TEI>"),
    ("<TEI><!-- c --> <p>a <!-- d --> b</p></TEI>", "<TEI><p>a b</p></TEI>"),
    ("<TEI> </TEI>", "<TEI></TEI>"),
]
NO, YES = ' phantom="false"', ' phantom="true"'
BLOCKS = [
    # lists and quotes leave their paragraph
    ('<TEI><div><p n="1">a<list><item>x</item></list>b<quote>q</quote></p></div></TEI>', f'<TEI><div{NO}><p n="1">a</p><list><item><p>x</p></item></list><p n="1">b</p><quote><p>q</p></quote></div></TEI>'),
    ("<TEI><div><p><list><label>k</label><item>x <hi>y</hi></item></list></p></div></TEI>", f"<TEI><div{NO}><list><label><p>k</p></label><item><p>x <hi>y</hi></p></item></list></div></TEI>"),
    # a list in an entry's paragraph of a list in a paragraph
    ("<TEI><div><p>a<list><item><p>b<list><item>c</item></list>d</p></item></list>e</p></div></TEI>", f"<TEI><div{NO}><p>a</p><list><item><p>b</p><list><item><p>c</p></item></list><p>d</p></item></list><p>e</p></div></TEI>"),
    # blocks in inlines, notes and paragraphs are dissolved
    ("<TEI><div><p>a<p>b</p><hi>c<p>d<list><item>e</item><item>f</item></list></p></hi></p></div></TEI>", f"<TEI><div{NO}><p>ab<hi>cd e  f </hi></p></div></TEI>"),
    ("<TEI><div><p>a<div><head>gone</head><p>b</p></div></p></div></TEI>", f"<TEI><div{NO}><p>ab</p></div></TEI>"),
    ("<TEI><div><p>a<div>x<head>stays</head></div></p></div></TEI>", f"<TEI><div{NO}><p>axstays</p></div></TEI>"),
    ("<TEI><div><p>a<lg><head>gone</head><l>b</l><l>c</l></lg>d</p></div></TEI>", f"<TEI><div{NO}><p>a b  c d</p></div></TEI>"),
    ("<TEI><div><lg><head>v</head><l>a<p>b</p></l> c <lb/>d</lg></div></TEI>", f"<TEI><div{NO}><lg><head>v</head><l>ab</l><l> c </l><lb></lb><l>d</l></lg></div></TEI>"),
    ("<TEI><div><p>a<note>n<p>m</p></note>b</p></div></TEI>", f"<TEI><div{NO}><p>a<note><p>nm</p></note>b</p></div></TEI>"),
    # loose inlines, also around a note that has runs of its own
    ("<TEI><div> x <hi>y</hi><note>n</note> z <p>p</p> <head>h</head>w</div></TEI>", f"<TEI><div{NO}><p> x <hi>y</hi><note><p>n</p></note> z </p><p>p</p><head>h</head><p>w</p></div></TEI>"),
    # blocks beside divisions
    ("<TEI><div><head>h</head>a<p>b</p><div>c</div><lg><l>d</l></lg><list><item>e</item></list><div><p>f</p></div></div></TEI>", f"<TEI><div{NO}><head>h</head><div{YES}><p>a</p><p>b</p></div><div{NO}><p>c</p></div><div{YES}><lg><l>d</l></lg><list><item><p>e</p></item></list></div><div{NO}><p>f</p></div></div></TEI>"),
    ("<TEI><div><p>a<list><item>b</item></list></p><div><p>c</p></div></div></TEI>", f"<TEI><div{NO}><div{YES}><p>a</p><list><item><p>b</p></item></list></div><div{NO}><p>c</p></div></div></TEI>"),
    # nothing changes in a header, or where all is in order; empty parts go
    ("<TEI><teiHeader><title>t</title><s><p>u<list><item>v</item></list></p></s></teiHeader><text><body><div><p>w</p><p/></div></body></text></TEI>", f"<TEI><teiHeader><title>t</title><s><p>u<list><item>v</item></list></p></s></teiHeader><text><body><div{NO}><p>w</p></div></body></text></TEI>"),
    ("<TEI/>", "<TEI></TEI>"),
]


def rewritten(spark, change, texts):
    nodes = xml_nodes(spark.createDataFrame([(str(i), x) for i, x in enumerate(texts)], "id string, x string").repartition(2), "id", "x")
    out = change(nodes)
    assert out.columns == nodes.columns
    return out, {int(r.doc_id): r.xml for r in trees.markup(out).collect()}


@pytest.mark.parametrize("change, cases", [(trees.settle_spaces, SPACES), (trees.segment, BLOCKS)])
def test_rewriting(spark, change, cases):
    """All documents of a list at once: nothing passes from one to another."""
    out, got = rewritten(spark, change, [x for x, _ in cases])
    assert [got[i] for i in range(len(cases))] == [y for _, y in cases]
    # the numbers are those of the markup read anew
    again = xml_nodes(trees.markup(out), "doc_id", "xml")
    numbers = lambda df: {(r.doc_id, r.pre, r.post, r.depth, r.parent, tuple(r.path), r.tag, r.text, tuple(r.names)) for r in df.collect()}
    assert numbers(out) == numbers(again)


def test_twice(spark):
    """What is in order stays as it is."""
    _, once = rewritten(spark, trees.settle_spaces, [y for _, y in SPACES])
    assert [once[i] for i in range(len(SPACES))] == [y for _, y in SPACES]


def test_empty(spark):
    none = xml_nodes(spark.createDataFrame([], "id string, x string"), "id", "x")
    assert trees.segment(none).count() == 0 and trees.settle_spaces(none).count() == 0


def test_axis_profile(spark):
    """Counts by arithmetic are those of the pairs on each axis."""
    from collections import Counter

    from marginalia.operators import axes

    texts = ["<a><b>x<c/><c><b/></c></b>\n<b/><d><c/><b><c/></b></d></a>", "<b/>", "<a><a><a/></a><!-- c --><b/>t<b/></a>"]
    nodes = xml_nodes(spark.createDataFrame([(str(i), x) for i, x in enumerate(texts)], "id string, x string"), "id", "x").cache()
    names = ("self", "child", "parent", "descendant", "descendant-or-self", "ancestor", "ancestor-or-self", "following-sibling", "preceding-sibling", "following", "preceding")
    every = axes.elements(nodes)
    want = Counter((name, r.tag) for name in names for r in axes.axis(every, every, name).select("tag").collect())
    assert {(r.axis, r.tag): r.n for r in axes.axis_profile(nodes).collect()} == want


def test_parts_follow_the_texts(spark, monkeypatch):
    """What one task sorts does not grow with the input: nodes are dealt by document into parts that follow the texts."""
    from marginalia.operators import marks
    from marginalia.sources import keep

    monkeypatch.setattr(keep, "PART_CHARS", 100)
    texts = spark.createDataFrame([(str(i), "<d><p>" + "x" * 50 + "<list><item>a</item></list>b</p></d>") for i in range(40)], "doc_id string, data string")
    assert keep.parts_for(texts, "data") >= 30 and keep.parts_for(texts.limit(0), "data") == 4
    nodes = xml_nodes(texts, "doc_id", "data")
    parts = keep.parts_for(texts, "data")
    for found in (trees.markup(trees.segment(nodes, parts)), marks.shown_views(nodes.repartition(parts, "doc_id"))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        # no window or grouping deals the documents anew
        assert f", {parts}), REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
    assert sorted(r.xml for r in trees.markup(trees.segment(nodes, parts)).collect()) == sorted(r.xml for r in trees.markup(trees.segment(nodes)).collect())
