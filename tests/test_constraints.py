"""Every rule with a text that breaks it and one that doesn't."""

from marginalia.operators import constraints
from marginalia.sources.nodes import xml_nodes

T = "<div type='translation'>{}</div>"
# rule -> what breaks it, and what does not
CASES = {
    "when-alone": ("<date when='1' to='2'/>", "<date when='1'/>"), "from-or-not-before": ("<date from='1' notBefore='1'/>", "<date from='1' to='2'/>"), "to-or-not-after": ("<date to='1' notAfter='1'/>", "<date to='1' notBefore='1'/>"),
    "calendar-text": ("<date calendar='x'> </date>", "<date calendar='x'><b>1</b></date>"), "unit-twice": ("<m unitRef='1' unit='2'/>", "<m unitRef='1'/>"), "subtype-alone": ("<m subtype='x'/>", "<m subtype='x' type='y'/>"),
    "span-end": ("<x xml:id='q'/><m spanTo='#q'/>", "<m spanTo='#q'/><x xml:id='q'/>"), "scheme-version": ("<m schemeVersion='1' scheme='free'/>", "<m schemeVersion='1' scheme='y'/>"),
    "stanza-translation": ("<p rend='stanza'/>", T.format("<p rend='stanza'/>")), "stanza-place": ("<div type='edition'><p rend='stanza'/></div>", "<div type='commentary'><b/><c><p rend='stanza'/></c></div>"),
    "corresp-stanza": (T.format("<p corresp='x'/>"), T.format("<p rend='stanza' corresp='x'/>")), "corresp-translation": (T.format("") + "<p corresp='x'/>", T.format("<p corresp='x'/>")),
    "choice-unclear": ("<choice><unclear/><unclear/><unclear/><unclear/></choice>", "<choice><unclear/><unclear/><unclear/></choice>"), "fortnight": ("<rs type='fortnight' subtype='grey'/>", "<rs type='fortnight' subtype='dark'/>"), "tithi-key": ("<rs type='tithi' key='1'/>", "<rs type='tithi' n='1'/>"),
    **{f"calendar-{k}": (f"<rs type='{k}' key='none'/>", f"<rs type='{k}' key='{v.split()[-1]}'/>") for k, v in constraints.CALENDAR.items()},
    "num-range": ("<num value='1' atLeast='1' atMost='2'/>", "<num atLeast='1' atMost='2'/>"), "num-most": ("<num atMost='2'/>", "<num value='2'/>"), "num-least": ("<num atLeast='2'/>", "<num/>"),
    "gloss-label": ("<list type='gloss'><item><label/></item></list>", "<list type='gloss'><label/><item/></list>"), "head-foreign": ("<head><foreign/><hi/></head>", "<head>a<foreign/></head>"),
    "bibl-note-last": ("<listBibl><bibl><note/><x/></bibl></listBibl>", "<listBibl><bibl><x/><note/></bibl></listBibl>"), "app-note-last": ("<app><note/><note/><rdg/></app>", "<app><rdg/><note/><note/></app>"),
    "note-child": ("<note><note/></note>", "<note/><note/>"), "note-nested": ("<note><b><note/></b></note>", "<note><b/></note><note/>"),
    "note-commentary": ("<div type='commentary'><note/></div>", "<div type='commentary'><p><b><note/></b></p></div>"), "note-apparatus": ("<div type='apparatus'><note/></div>", "<div type='apparatus'><app><note/></app></div>"), "note-bibliography": ("<div type='bibliography'><note/></div>", "<div type='bibliography'><listBibl><note/></listBibl></div>"),
    "milestone-n": ("<milestone unit='x'/>", "<milestone unit='x' n='1'/>"), "milestone-yati": ("<milestone type='yati'/>", "<milestone type='yati' break='no'/>"), "milestone-ref": ("<milestone type='ref'/>", T.format("<milestone type='ref'/>")), "milestone-ref-unit": ("<milestone type='ref' unit='x'/>", "<milestone type='ref' unit='line'/>"),
    "range-note": ("<listBibl><citedRange><note/></citedRange></listBibl>", "<citedRange><note/></citedRange>"), "bibl-note-end": ("<listBibl><bibl><note/><x/></bibl></listBibl>", "<bibl><note/><x/></bibl>"), "bibl-note": ("<div type='commentary'><bibl><note/></bibl></div>", "<div type='edition'><bibl><note/></bibl></div>"),
    "who-part": ("<m who='jo'/>", "<m who='part:jo'/>"), "match-met": ("<certainty match='../@met'/>", "<lg><certainty match='../@met'/></lg>"), "match-gap": ("<lg><certainty match='..'/></lg>", "<gap><certainty match='..'/></gap>"), "match-met-value": ("<certainty match='../@met'/>", "<certainty match='../@met' locus='value'/>"), "match-gap-name": ("<certainty match='..' locus='value'/>", "<certainty match='..' locus='name'/>"),
    "seg-subtype": ("<seg subtype='x' type='y'/>", "<seg subtype='x' type='component'/>"), "seg-low": ("<seg cert='low'/>", T.format("<seg cert='low'/>")), "seg-pun": ("<seg rend='pun'/>", T.format("<seg rend='pun'/>")), "seg-highlight": ("<seg type='highlight'/>", "<rdg><seg type='highlight'/></rdg>"),
    "app-lem": ("<app><rdg/></app>", "<app><lem/></app>"), "app-source": ("<app><lem/></app>", "<app><lem source='x'/></app>"), "app-list": ("<app/>", "<listApp><app/></listApp>"), "lem-blocks": ("<lem><ab/></lem>", "<lem><hi/></lem>"), "lem-line": ("<lem><l/></lem>", "<lem><l/><l/></lem>"), "rdg-blocks": ("<rdg><l/></rdg>", "<rdg>a</rdg>"),
    "apparatus-method": ("<variantEncoding location='external' method='parallel-segmentation'/>", "<variantEncoding location='internal' method='parallel-segmentation'/>"), "p-in-p": ("<p><hi><p/></hi></p>", "<p><note><b/></note></p><p/>"), "p-in-line": ("<l><ab/></l>", "<l><note><p/></note></l>"), "div-in-line": ("<l><div/></l>", "<l/><div/>"), "div-in-p": ("<p><b><div/></b></p>", "<p><floatingText><div/></floatingText></p>"),
    "hi-unmetrical": ("<hi rend='unmetrical'/>", "<l><hi rend='unmetrical'/></l>"), "quote-translation": ("<quote type='translation'/><quote type='diplomatic'/>", "<quote type='diplomatic'/><b/><quote type='translation'/>"), "in-choice": ("<corr/>", "<choice><corr/></choice>"), "overstrike": ("<add place='overstrike'/>", "<add place='overstrike'/>a<b/><del/>"),
    "ptr-siglum": ("<bibl><ptr rend='title'/></bibl>", "<p><ptr rend='title'/></p>"), "ptr-one": ("<ref target='a' cRef='b'/>", "<ptr target='a'/>"), "label-marginalia": ("<label type='marginalia' n='1'/>", "<label type='marginalia' n='1' place='x'/>"), "note-unknown": ("<listApp type='other'><note type='unknown'/></listApp>", "<listApp type='parallels'><note type='unknown'/></listApp>"),
    "note-rend": ("<note rend='x'/>", "<note rend='x' type='altLem'/>"), "title-lang": ("<title type='original'/>", "<title type='original' xml:lang='x'/>"), "line-n": ("<l/>", "<l n='a'/>"), "line-corresp": ("<l corresp='x'/>", "<rdg><l corresp='x'/></rdg>"), "line-parent": ("<p rend='other'><l/></p>", "<p rend='stanza'><l/></p>"), "line-nested": ("<l><lg/></l>", "<l><note><lg/></note></l>"),
    "verse-supplied": ("<supplied><lg n='1'/></supplied>", "<supplied><lg/></supplied>"), "verse-empty": ("<lg><b/></lg><l/>", "<lg><b><gap/></b></lg>"), "verse-unique": ("<lg><l n='a'/><l n='a'/></lg>", "<lg><l n='a'/><l n='b'/></lg><lg><l n='a'/></lg>"), "title-editorial": ("<titleStmt><title/></titleStmt>", "<titleStmt><title type='editorial'/></titleStmt>"),
    "hand-script": ("<handNote scriptRef='class:1'/>", "<handNote scriptRef='class:1 maturity:2'/>"), "join-two": ("<join target='#a'/>", "<join target='#a #b'/>"), "interpolation-n": ("<div type='interpolation' n='1'/>", "<div type='interpolation'/>"), "edition-lang": ("<div type='edition'/>", "<div type='edition' xml:lang='x'/>"), "subst-parts": ("<subst><add/></subst>", "<subst><add/><surplus/></subst>"),
    "displacement": ("<locus type='displacement'/>", "<rdg><locus type='displacement'/></rdg>"), "locus-range": ("<locus from='1'/>", "<locus from='1' to='2'/>"), "hand-desc": ("<handDesc><b><p/></b></handDesc>", "<handDesc><p/></handDesc>"), "hand-detail": ("<lem hand='1'/><b/><witDetail/>", "<lem hand='1'/> <witDetail/>"), "group-lem": ("<rdgGrp><lem/><lem/></rdgGrp>", "<rdgGrp><lem/></rdgGrp>"),
    "witness-id": ("<listWit><listWit/></listWit>", "<listWit><listWit xml:id='a'/></listWit>"), "span-target": ("<span to='1' target='2'/>", "<span target='2'/>"), "span-from": ("<span to='1'/>", "<span from='0' to='1'/>"), "span-single": ("<span from='0' to='1 2'/>", "<span from='0' to='1'/>"), "fw-place": ("<b/><fw/><pb/>", "<pb/><b/><fw/>"),
    "gap-extent": ("<space quantity='1' extent='x'/>", "<gap extent='x'/>"), "gap-unit": ("<gap quantity='1'/>", "<gap quantity='1' unit='x'/>"), "gap-supplied": ("<supplied reason='lost'><gap/></supplied>", "<supplied reason='undefined'><gap/></supplied>"), "expan-ex": ("<expan>a</expan><ex/>", "<expan><b><ex/></b></expan>"), "ex-expan": ("<ex/>", "<expan><ex/></expan>"), "ex-abbr": ("<abbr><ex/></abbr>", "<expan><ex/></expan>"),
    "div-types": ("<div type='a'><div type='b'/></div>", "<div type='a'><div type='textpart'/><div type='a'/></div>"),
}


def found(spark, texts):
    nodes = xml_nodes(spark.createDataFrame([(k, f"<r>{x}</r>") for k, x in texts.items()], "id string, x string").repartition(2), "id", "x")
    out = {}
    for r in constraints.violations(nodes).collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_every_rule(spark):
    assert set(CASES) == {r[0] for r in constraints.RULES} and len(constraints.RULES) == len({r[0] for r in constraints.RULES})
    bad = found(spark, {k: x for k, (x, _) in CASES.items()})
    assert [k for k in CASES if k not in {r.rule_id for r in bad.get(k, [])}] == []
    good = found(spark, {k: x for k, (_, x) in CASES.items()})
    assert [k for k in CASES if k in {r.rule_id for r in good.get(k, [])}] == []
    assert all(r.message and r.line == 1 and r.severity in (1, 2) for rows in bad.values() for r in rows)


def test_sets(spark):
    docs = spark.createDataFrame([("1", "INS_a", "<r><l/><gap quantity='1'/></r>"), ("2", "CRIT_b", "<r><l/></r>"), ("3", "other", "<r><l/></r>")], "doc_id string, name string, x string")
    all_ = constraints.violations(xml_nodes(docs, "doc_id", "x"))
    got = {(r.doc_id, r.rule_id) for r in constraints.of_sets(all_, docs, {"INS": "i", "CRIT": "c"}).collect()}
    assert got == {("1", "line-parent"), ("2", "line-n")}


def test_own_rules(spark):
    nodes = xml_nodes(spark.createDataFrame([("1", "<r><a><b k='x y'/></a><b/></r>"), ("2", "<r>")], "id string, x string"), "id", "x")
    mine = [("b-in-a", "x", "b", "parent:a @k>1", 1, "m"), ("a-last", "x", "a", "next:b", 2, "m")]
    assert {(r.doc_id, r.rule_id, r.pre) for r in constraints.violations(nodes, mine).collect()} == {("1", "b-in-a", 3), ("1", "a-last", 2)}
