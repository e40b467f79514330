"""Views of small texts: each mark by its attribute."""

from pyspark.sql import functions as F

from marginalia.operators import editions, marks
from marginalia.sources.nodes import xml_nodes

# markup in a paragraph -> physical, logical, full; one text where all are the same
CASES = [
    ('<supplied reason="lost">a</supplied><supplied reason="omitted">b</supplied><supplied reason="explanation">c</supplied><supplied reason="undefined" cert="low">d</supplied><supplied>e</supplied>', "[a]⟨b⟩(c)[d?][e]"),
    ('<supplied reason="subaudible">a</supplied><foreign><supplied reason="subaudible" cert="low">b</supplied></foreign>', "[a]⟨b?⟩"),
    ('<unclear>a</unclear><unclear cert="low">b</unclear>', "(a)(b?)"),
    ("<choice><unclear>a</unclear> <unclear cert='low'>b</unclear><unclear>c</unclear></choice>x<choice><unclear>d</unclear></choice>", "(a/b/c)x(d)"),
    ("<choice>\n<sic>s</sic> <corr>c</corr>\n</choice>", "¿s?", "⟨c⟩", "¿s?⟨c⟩"),
    ("<choice><orig>o</orig><reg>r</reg></choice><sic>s</sic><reg>g</reg><choice><sic>x</sic><corr>y</corr><corr>z</corr></choice>", "¡o!¿s?⟨g⟩¿x?⟨y⟩⟨z⟩", "⟨r⟩¿s?⟨g⟩¿x?⟨y⟩⟨z⟩", "¡o!⟨r⟩¿s?⟨g⟩¿x?⟨y⟩⟨z⟩"),
    ("<subst><del>d</del><add>a</add></subst> <subst><add>a<hi>b</hi></add> lost <del>c<supplied>e</supplied></del></subst>f <subst><add>only</add></subst>", "⟦d⟧⟨⟨a⟩⟩ ⟦c[e]⟧⟨⟨ab⟩⟩f ⟨⟨only⟩⟩"),
    ("<subst><add>x<subst><add>y</add><del>z</del></subst></add><del>w</del></subst>", "⟦w⟧⟨⟨x⟦z⟧⟨⟨y⟩⟩⟩⟩"),
    ('<seg rend="pun">a</seg><seg rend="check pun" cert="low">b</seg><seg cert="low">c</seg><seg rend="check">d</seg>', "{a}{¿b?}¿c?d"),
    ('<seg met="-+"> <gap reason="lost" quantity="2"/></seg><seg met="indra"><gap/></seg><seg met="none"><gap/></seg><seg met="-+">a<gap/></seg>', "[⏑–][––][…]a[…]"),
    ('<gap reason="lost" quantity="3"/><gap quantity="1"><certainty match=".." locus="name"/></gap><gap reason="illegible" quantity="2" unit="line"/>', "[***][*][2 illegible lines]", "[3+][1*][2 illegible lines]", "[3+][1*][2 illegible lines]"),
    ('<space type="vacat" quantity="2"/><space type="binding-hole" quantity="2"/><g type="numeral">1/2</g><g type="numeral">7<hi>8</hi></g><g type="danda">.</g><g type="other">§</g>', "__◯½78।<other>"),
    ("a <note>n</note>, b<hi> <surplus>c</surplus></hi> <expan><abbr>d<am>.</am></abbr><ex>e</ex></expan> <q>f</q>", "a, b {c} d.(e) “f”"),
    ("<bibl>gone</bibl>a<fw>gone</fw><app><lem>gone</lem></app>", "a"),
]


def views(spark, texts, **more):
    docs = spark.createDataFrame([(str(i), f"<TEI><p>{x}</p></TEI>") for i, x in enumerate(texts)], "id string, x string").repartition(2)
    nodes = xml_nodes(docs, "id", "x")
    foreign = nodes.where("tag = 'foreign'").select("doc_id", "pre", F.lit(True).alias("source"))
    symbols, metres = spark.createDataFrame([("danda", "।")], "name string, text string"), spark.createDataFrame([("indra", "++")], "name string, pattern string")
    found = editions.edition_views(nodes, None, symbols, prosody=metres, sources=foreign, **more)
    return {(int(r.doc_id), r.view): r.text for r in found.collect()}


def test_marks(spark):
    got = views(spark, [c[0] for c in CASES])
    for i, (x, *want) in enumerate(CASES):
        want = want * 3 if len(want) == 1 else want
        assert [got[i, v] for v in marks.VIEWS] == want, x


def test_milestones(spark):
    texts = ["a <lb/>b<lb break='no'/>c <lb break='no'/> d<pb/><lb/>e <note>n</note><lb/>f"]
    assert views(spark, texts, milestone_spaces=True)[0, "full"] == "a bcd e f"
    assert views(spark, texts)[0, "full"] == "a bc def"


def test_own_rules(spark):
    nodes = xml_nodes(spark.createDataFrame([("1", "<p>a<hi rend='b i'>x</hi><hi n='1'>y</hi></p>")], "id string, x string"), "id", "x")
    rules = editions.rule_table(spark).unionByName(spark.createDataFrame([("hi", 0, "rend~i", "*|*", "show", "drop"), ("hi", 0, "n=1|2", "drop", "_|", "<|>")], marks.RULE))
    assert {r.view: r.text for r in editions.edition_views(nodes, rules).collect()} == {"physical": "a*x*", "logical": "ax_y", "full": "a<y>"}
