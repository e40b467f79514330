"""Rules on markup as rows, all evaluated in one scan of the node table.

A rule is (rule_id, sets, context, broken, severity, message). ``sets`` names the rule sets it belongs to;
``context`` is a tag, tags joined by ``|``, or ``*``. ``broken`` says when it is broken:
alternatives joined by `` or ``, each a list of tests joined by spaces, ``!`` before a test for its contrary:

``@a`` the attribute is there; ``@a=v|w`` has one of these values; ``@a^=v`` begins so; ``@a*=v`` holds it; ``@a>1`` has more than so many words;
``parent:T`` ``ancestor:T`` ``child:T`` ``inside:T`` ``before:T`` ``after:T`` ``next:T`` ``prev:T`` there is such an element: around it, in it, among
the siblings before or after it, or right beside it. T is a tag, tags joined by ``|``, ``*``, or ``-tag`` for any but that;
``[a=v,b]`` behind it tests its attributes likewise; ``child:T>2`` counts;
``text`` there is text in it; ``unlike:a`` its attribute is not that of its parent; ``repeats:T@a`` two children T have one value of a;
``follows:a`` an element with the id that a names comes after it.

A test on ancestors is a running maximum of closing numbers, on siblings a window by
parent, on what is inside the next match in order, on parents and children one join each.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.operators.axes import elements
from marginalia.operators.marks import quoted

RULE = "rule_id string, sets string, context string, broken string, severity int, message string"
WARNING, ERROR = 1, 2
#: Letters of ``sets`` below.
SETS = {"i": "inscription", "c": "critical", "b": "bestow", "p": "prosody", "t": "tei"}
TRANSLATION = "div[type=translation]"

# Names of times of a calendar, by type.
CALENDAR = {
    "month": "caitra vaisakha jyaistha asadha sravana bhadrapada asvina karttika margasira pausa magha phalguna",
    "naksatra": "krttika rohini mrgasirsa ardra punarvasu pusya aslesa magha purva-phalguni uttara-phalguni hasta citra svati visakha anuradha jyestha mula purva-asadha uttara-asadha sravana dhanistha satabhisaj purva-bhadrapada uttara-bhadrapada revati asvini bharani",
    "sadvara": "tunglai hariyang wurukung paniruan was mawulu", "pancavara": "pahing pon wagai kaliwuan umanis", "season": "hemanta grisma varsa",
    "wuku": "sinta landep wukir kurantil tolu gumbreg warigalit warigagung julung sungsang galungan dungulan kuningan langki madasiha pujut pahang kuruwlut marakih tambir madangkungan mahatal wuyai manahil prangbakat balamuki wugu wayang kulawu dukut watugunung",
    "chinese": "rat buffalo-ox tiger hare-cat dragon snake horse goat monkey cock dog pig", "solstice": "winter summer", "equinox": "autumn spring", "eclipse": "lunar solar",
}
# When each rule is broken. Messages are our own.
RULES = [
    ("when-alone", "bcipt", "*", "@when @notBefore or @when @notAfter or @when @from or @when @to", WARNING, "@when excludes other attributes of dates"),
    ("from-or-not-before", "bcipt", "*", "@from @notBefore", WARNING, "@from excludes @notBefore"),
    ("to-or-not-after", "bcipt", "*", "@to @notAfter", WARNING, "@to excludes @notAfter"),
    ("calendar-text", "bcipt", "*", "@calendar !text", ERROR, "@calendar needs a date as content"),
    ("unit-twice", "bcipt", "*", "@unitRef @unit", WARNING, "@unit is not needed beside @unitRef"),
    ("subtype-alone", "bcipt", "*", "@subtype !@type", ERROR, "@subtype needs @type"),
    ("span-end", "bit", "*", "@spanTo !follows:spanTo", ERROR, "@spanTo must name a later element"),
    ("scheme-version", "bit", "*", "@schemeVersion !@scheme or @schemeVersion @scheme=free", ERROR, "@schemeVersion needs a @scheme"),
    ("stanza-translation", "bc", "p", "@rend=stanza !ancestor:" + TRANSLATION, ERROR, "a stanza belongs in a translation"),
    ("stanza-place", "i", "p", f"@rend=stanza !ancestor:{TRANSLATION} !ancestor:div[type=commentary]", ERROR, "a stanza belongs in a translation or a commentary"),
    ("corresp-stanza", "i", "p", f"@corresp !@rend=stanza or @corresp !ancestor:{TRANSLATION}", ERROR, "@corresp belongs on a stanza of a translation"),
    ("corresp-translation", "c", "p", "@corresp !ancestor:" + TRANSLATION, ERROR, "@corresp belongs in a translation"),
    ("choice-unclear", "bc", "choice", "child:unclear>3", ERROR, "at most three unclear readings"),
    ("fortnight", "b", "rs", "@type=fortnight !@subtype=dark|bright", ERROR, "a fortnight is dark or bright"),
    ("tithi-key", "b", "rs", "@type=tithi @key", ERROR, "a tithi has @n, no @key"),
    *((f"calendar-{kind}", "b", "rs", f"@type={kind} !@key={'|'.join(names.split())}", ERROR, f"unknown key of type {kind}") for kind, names in CALENDAR.items()),
    ("num-range", "bi", "num", "@value @atMost or @value @atLeast", ERROR, "@value excludes a range"),
    ("num-most", "bi", "num", "@atMost !@atLeast", ERROR, "@atMost needs @atLeast"),
    ("num-least", "bi", "num", "@atLeast !@atMost", ERROR, "@atLeast needs @atMost"),
    ("gloss-label", "bcipt", "list", "@type=gloss !child:label", ERROR, "a gloss list needs labels"),
    ("head-foreign", "bi", "head", "child:-foreign", ERROR, "a heading holds no element but foreign"),
    ("bibl-note-last", "bi", "note", "parent:bibl ancestor:listBibl after:*", ERROR, "a note ends its entry of the bibliography"),
    ("app-note-last", "bi", "note", "parent:app after:-note", ERROR, "notes end an entry of the apparatus"),
    ("note-child", "bi", "note", "child:note", ERROR, "no note in a note"),
    ("note-nested", "i", "note", "ancestor:note", ERROR, "notes do not nest"),
    ("note-commentary", "i", "note", "ancestor:div[type=commentary] !ancestor:p !ancestor:item", ERROR, "in a commentary a note stands in a paragraph or an entry"),
    ("note-apparatus", "i", "note", "ancestor:div[type=apparatus] !parent:app", ERROR, "in an apparatus a note stands in app"),
    ("note-bibliography", "i", "note", "ancestor:div[type=bibliography] !ancestor:p !ancestor:listBibl", ERROR, "in a bibliography a note stands in a paragraph or a list"),
    ("milestone-n", "bc", "milestone", "!@unit or !@n", ERROR, "a milestone has @unit and @n"),
    ("milestone-yati", "bc", "milestone", "@type=yati !@break=no", ERROR, "a caesura has break=no"),
    ("milestone-ref", "bc", "milestone", "@type=ref !ancestor:" + TRANSLATION, ERROR, "a reference milestone belongs in a translation"),
    ("milestone-ref-unit", "bc", "milestone", "@type=ref !@unit=stanza|line", ERROR, "a reference milestone counts stanzas or lines"),
    ("range-note", "bip", "citedRange", "child:note ancestor:listBibl", ERROR, "a note stands beside citedRange"),
    ("bibl-note-end", "bp", "note", "parent:bibl[] ancestor:listBibl after:*", ERROR, "a note ends its entry"),
    ("bibl-note", "b", "bibl", "child:note ancestor:div[type=commentary] or child:note ancestor:div[type=apparatus]", ERROR, "no note in bibl here"),
    ("who-part", "bc", "*", "@who !@who^=part:", ERROR, "@who begins with part:"),
    ("match-met", "bi", "certainty", "@match=../@met !parent:lg", ERROR, "this @match belongs in lg"),
    ("match-gap", "bi", "certainty", "@match=.. !parent:gap", ERROR, "this @match belongs in gap"),
    ("match-met-value", "i", "certainty", "@match=../@met !@locus=value", ERROR, "this @match needs locus=value"),
    ("match-gap-name", "i", "certainty", "@match=.. !@locus=name", ERROR, "this @match needs locus=name"),
    ("seg-subtype", "bci", "seg", "@subtype !@type=component", ERROR, "@subtype needs type=component"),
    ("seg-low", "bci", "seg", "@cert=low !ancestor:" + TRANSLATION, ERROR, "an uncertain segment belongs in a translation"),
    ("seg-pun", "bci", "seg", "@rend=pun !ancestor:" + TRANSLATION, ERROR, "a pun belongs in a translation"),
    ("seg-highlight", "c", "seg", "@type=highlight !parent:lem|rdg", ERROR, "a highlight belongs in lem or rdg"),
    ("app-lem", "b", "app", "!child:lem", ERROR, "app needs lem"),
    ("app-source", "bi", "app", "child:lem !child:lem>1 !child:lem[source] !child:rdg|note", ERROR, "lem by itself needs @source"),
    ("app-list", "i", "app", "!parent:listApp", ERROR, "app belongs in listApp"),
    ("lem-blocks", "bi", "lem", "child:p|ab|lg", ERROR, "no block in lem"),
    ("lem-line", "bi", "lem", "child:l !child:l>1", ERROR, "one line is not marked in lem"),
    ("rdg-blocks", "bi", "rdg", "child:p|ab|lg|l", ERROR, "no block or line in rdg"),
    ("apparatus-method", "bct", "variantEncoding", "@location=external @method=parallel-segmentation", ERROR, "an external apparatus has no parallel segmentation"),
    ("p-in-p", "cp", "p", "ancestor:p|ab !ancestor:floatingText !parent:exemplum|item|note|q|quote|remarks|said|sp|stage|cell|figure", ERROR, "no paragraph in a paragraph"),
    ("p-in-line", "cp", "p|ab", "ancestor:l !ancestor:floatingText !parent:figure|note", ERROR, "no paragraph in a line of verse"),
    ("div-in-line", "cp", "div", "ancestor:l !ancestor:floatingText", ERROR, "no division in a line of verse"),
    ("div-in-p", "cp", "div", "ancestor:p|ab !ancestor:floatingText", ERROR, "no division in a paragraph"),
    ("hi-unmetrical", "c", "hi", "@rend=unmetrical !ancestor:l", ERROR, "unmetrical text belongs in a line of verse"),
    ("quote-translation", "c", "quote", "@type=translation !before:quote[type=diplomatic|normalized]", ERROR, "a translated quotation follows its original"),
    ("in-choice", "c", "corr|reg|orig", "!parent:choice", ERROR, "belongs in choice"),
    ("overstrike", "c", "add", "@place=overstrike !before:del !after:del", ERROR, "an addition over something needs del"),
    ("ptr-siglum", "c", "ptr", "@rend=siglum|title parent:bibl", ERROR, "this rendition is not for bibl"),
    ("ptr-one", "cp", "ptr|ref", "@target @cRef", ERROR, "@target excludes @cRef"),
    ("label-marginalia", "c", "label", "@type=marginalia !@n or @type=marginalia !@place", ERROR, "a marginal label has @n and @place"),
    ("note-unknown", "c", "note", "@type=unknown !ancestor:listApp[type=parallels]", ERROR, "this type is for parallels"),
    ("note-rend", "c", "note", "@rend !@type=altLem", ERROR, "@rend is for an alternative lemma"),
    ("title-lang", "c", "title", "@type=original !@lang", ERROR, "an original title has a language"),
    ("line-n", "c", "l", "!@corresp !@n", ERROR, "a line has @n"),
    ("line-corresp", "c", "l", "@corresp !ancestor:rdg", ERROR, "@corresp belongs in a reading"),
    ("line-parent", "i", "l", "!parent:lg !parent:p[rend=stanza]", ERROR, "a line stands in a verse or a stanza"),
    ("line-nested", "c", "l|lg", "ancestor:l !ancestor:note", ERROR, "no verse in a line"),
    ("verse-supplied", "c", "lg", "parent:supplied @n", ERROR, "a supplied verse has no @n"),
    ("verse-empty", "c", "lg", "!inside:lg|l|gap", ERROR, "a verse holds lines or a gap"),
    ("verse-unique", "i", "lg", "repeats:l@n", ERROR, "lines of a verse have labels of their own"),
    ("title-editorial", "c", "titleStmt", "!child:title[type=editorial]", ERROR, "there is no editorial title"),
    ("hand-script", "c", "handNote", "@scriptRef !@scriptRef*=class: or @scriptRef !@scriptRef*=maturity:", ERROR, "@scriptRef has a class and a maturity"),
    ("join-two", "c", "join", "!@target>1", ERROR, "@target has two values at least"),
    ("interpolation-n", "c", "div", "@type=interpolation @n", ERROR, "an interpolation has no @n"),
    ("edition-lang", "c", "div", "@type=edition !@lang", ERROR, "an edition has a language"),
    ("subst-parts", "c", "subst", "!child:add or !child:del|surplus", ERROR, "a substitution has an addition and a deletion"),
    ("displacement", "c", "locus", "@type=displacement !parent:rdg", ERROR, "a displacement belongs in a reading"),
    ("locus-range", "c", "locus", "@from !@to or @to !@from", ERROR, "@from and @to go together"),
    ("hand-desc", "c", "handDesc", "!child:p|handNote", ERROR, "handDesc has a paragraph or a note"),
    ("hand-detail", "c", "lem|rdg", "@hand !next:witDetail", ERROR, "@hand needs witDetail beside it"),
    ("group-lem", "c", "rdgGrp", "child:lem>1", ERROR, "one lem in a group"),
    ("witness-id", "c", "listWit", "parent:listWit !@id", ERROR, "a family of witnesses has an id"),
    ("span-target", "c", "span", "@from @target or @to @target", ERROR, "@target excludes @from and @to"),
    ("span-from", "c", "span", "@to !@from", ERROR, "@to needs @from"),
    ("span-single", "c", "span", "@to>1 or @from>1", ERROR, "@from and @to have one value"),
    ("fw-place", "i", "fw", "!before:pb !before:fw", ERROR, "fw follows a page break"),
    ("gap-extent", "t", "gap|space", "@quantity @extent", ERROR, "@quantity excludes @extent"),
    ("gap-unit", "t", "gap|space", "@quantity !@unit", ERROR, "@quantity needs @unit"),
    ("gap-supplied", "t", "gap", "!@reason=ellipsis ancestor:supplied[!reason=undefined]", ERROR, "no gap in supplied text"),
    ("expan-ex", "t", "expan", "!inside:ex", ERROR, "an expansion holds ex"),
    ("ex-expan", "t", "ex", "!ancestor:expan", ERROR, "ex belongs in an expansion"),
    ("ex-abbr", "t", "ex", "parent:abbr", ERROR, "ex is no part of abbr"),
    ("div-types", "t", "div", "@type !@type=textpart parent:div unlike:type", ERROR, "divisions nest by one type, but for parts of texts"),
]
_TEST = re.compile(r"(!?)(?:@(\w+)(?:(\^=|\*=|=|>)(\S+))?|(parent|ancestor|child|inside|before|after|next|prev):([^\[>]+)(?:\[([^\]]*)\])?(?:>(\d+))?|(text)|unlike:(\w+)|repeats:(\w+)@(\w+)|follows:(\w+))")


def rule_frame(spark: SparkSession, rules: list[tuple] | None = None) -> DataFrame:
    """The rules as a table, to be read or extended."""
    return spark.createDataFrame([tuple(r) for r in rules or RULES], RULE)


def value_test(attrs: str, name: str, sign: str | None, value: str | None) -> str:
    have = f"try_element_at({attrs}, {quoted(name)})"
    if sign is None:
        return f"{have} IS NOT NULL"
    have = f"coalesce({have}, '')"
    if sign == ">":
        return f"size(filter(split({have}, ' +'), x -> x <> '')) > {int(value)}"
    if sign == "=":
        return f"{have} IN ({', '.join(map(quoted, value.split('|')))})"
    return f"{'startswith' if sign == '^=' else 'contains'}({have}, {quoted(value)})"


def element_test(tag: str, attrs: str, tags: str, more: str | None) -> str:
    """Whether an element is one of the tags and its attributes are as asked."""
    out = ["true"] if tags == "*" else [f"{tag} <> {quoted(tags[1:])}"] if tags.startswith("-") else [f"{tag} IN ({', '.join(map(quoted, tags.split('|')))})"]
    for one in (more or "").split(","):
        if one:
            negated, name, value = re.fullmatch(r"(!?)(\w+)(?:=(.*))?", one).groups()
            out.append(f"{'NOT ' if negated else ''}({value_test(attrs, name, '=' if value is not None else None, value)})")
    return " AND ".join(f"({x})" for x in out)


class Facts:
    """Columns that the tests of some rules need, each once."""

    def __init__(self) -> None:
        self.windows: dict[str, F.Column] = {}
        self.children: dict[str, F.Column] = {}
        self.repeats: dict[str, tuple[str, str]] = {}
        self.parents = False
        self.targets: set[str] = set()

    def named(self, where: dict, key: str, made) -> str:
        name = f"_{re.sub(r'[^A-Za-z0-9]', '_', key)}_{sum(map(ord, key))}"
        if name not in where:
            where[name] = made
        return name

    def test(self, one: str) -> str:
        m = _TEST.fullmatch(one)
        if m is None:
            raise ValueError(f"no test {one!r}")
        negated, name, sign, value, axis, tags, more, count, text, unlike, child, attribute, target = m.groups()
        if name:
            out = value_test("attrs", name, sign, value)
        elif text:
            out = self.within("text", "tag = '#text' AND text RLIKE '\\\\S'")
        elif unlike:
            self.parents = True
            out = f"coalesce(try_element_at(attrs, {quoted(unlike)}), '') <> coalesce(try_element_at(_up.attrs, {quoted(unlike)}), '')"
        elif child:
            key = f"repeats_{child}_{attribute}"
            self.repeats[f"_{key}"] = (child, attribute)
            out = f"coalesce(_{key}, false)"
        elif target:
            self.targets.add(target)
            out = f"coalesce(_target_{target} > pre, false)"
        else:
            out = self.axis(one.lstrip("!"), axis, tags, more, count)
        return f"NOT ({out})" if negated else f"({out})"

    def within(self, key: str, match: str) -> str:
        """A match comes next and closes before the element does."""
        after = Window.partitionBy("doc_id").orderBy(F.col("pre").desc()).rowsBetween(Window.unboundedPreceding, -1)
        return f"coalesce({self.named(self.windows, 'in ' + key, F.last(F.expr(f'CASE WHEN {match} THEN post END'), ignorenulls=True).over(after))} < post, false)"

    def axis(self, key: str, axis: str, tags: str, more: str | None, count: str | None) -> str:
        match = element_test("tag", "attrs", tags, more)
        element = "NOT startswith(tag, '#')"
        if axis == "parent":
            self.parents = True
            return f"coalesce({element_test('_up.tag', '_up.attrs', tags, more)}, false)"
        if axis == "ancestor":
            earlier = Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
            return f"coalesce({self.named(self.windows, key, F.max(F.expr(f'CASE WHEN {match} THEN post END')).over(earlier))} > post, false)"
        if axis == "inside":
            return self.within(key, f"{element} AND {match}")
        if axis == "child":
            name = self.named(self.children, key.split(">")[0], F.count_if(F.expr(match)))
            return f"coalesce({name}, 0) > {int(count or 0)}"
        order = Window.partitionBy("doc_id", "parent", F.expr(element)).orderBy("pre")
        if axis in ("next", "prev"):
            beside = (F.lead if axis == "next" else F.lag)(F.expr(match)).over(order)
            return f"coalesce({self.named(self.windows, key, beside)}, false)"
        # siblings after it: the first of all in reverse order
        way = Window.partitionBy("doc_id", "parent", F.expr(element)).orderBy(F.col("pre").desc() if axis == "after" else F.col("pre")).rowsBetween(Window.unboundedPreceding, -1)
        return f"coalesce({self.named(self.windows, key, F.max(F.expr(match)).over(way))}, false)"


def violations(nodes: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """(doc_id, rule_id, sets, pre, line, col, severity, message) of each element that breaks a rule."""
    rules, facts = [tuple(r) for r in rules or RULES], Facts()
    cases: dict[str, list[str]] = {}
    for i, (_, _, context, broken, _, _) in enumerate(rules):
        holds = " OR ".join("(" + " AND ".join(facts.test(one) for one in way.split()) + ")" for way in broken.split(" or "))
        for tag in context.split("|"):
            cases.setdefault(tag, []).append(f"CASE WHEN {holds} THEN {i} END")
    n = nodes.where(F.col("tag") != "#error").withColumns(facts.windows)
    n = elements(n)
    if facts.parents:
        up = elements(nodes).select(F.col("doc_id").alias("_doc"), F.col("pre").alias("_pre"), F.struct("tag", "attrs").alias("_up"))
        n = n.join(up, (F.col("doc_id") == F.col("_doc")) & (F.col("parent") == F.col("_pre")), "left").drop("_doc", "_pre")
    if facts.children:
        kids = elements(nodes).where("parent IS NOT NULL").groupBy(F.col("doc_id").alias("_doc"), F.col("parent").alias("_pre")).agg(*[c.alias(k) for k, c in facts.children.items()])
        n = n.join(kids, (F.col("doc_id") == F.col("_doc")) & (F.col("pre") == F.col("_pre")), "left").drop("_doc", "_pre")
    for name, (child, attribute) in facts.repeats.items():
        value = F.try_element_at("attrs", F.lit(attribute))
        twice = elements(nodes).where(F.col("tag") == child).groupBy(F.col("doc_id").alias("_doc"), F.col("parent").alias("_pre")).agg((F.count(value) > F.count_distinct(value)).alias(name))
        n = n.join(twice, (F.col("doc_id") == F.col("_doc")) & (F.col("pre") == F.col("_pre")), "left").drop("_doc", "_pre")
    for name in sorted(facts.targets):
        ids = elements(nodes).where(F.try_element_at("attrs", F.lit("id")).isNotNull()).groupBy(F.col("doc_id").alias("_doc"), F.try_element_at("attrs", F.lit("id")).alias("_id")).agg(F.max("pre").alias(f"_target_{name}"))
        asked = F.regexp_replace(F.try_element_at("attrs", F.lit(name)), "^#", "")
        n = n.join(ids, (F.col("doc_id") == F.col("_doc")) & (asked == F.col("_id")), "left").drop("_doc", "_id")
    every = f"array({', '.join(cases.pop('*', ['CAST(NULL AS INT)']))})"
    own = " ".join(f"WHEN {quoted(tag)} THEN array({', '.join(tests)})" for tag, tests in cases.items())
    found = F.expr(f"filter(concat({every}, CASE tag {own} ELSE array() END), x -> x IS NOT NULL)") if cases else F.expr(f"filter({every}, x -> x IS NOT NULL)")
    broken = n.select("doc_id", "pre", "line", "col", F.explode(found).alias("_i"))
    table = nodes.sparkSession.createDataFrame([(i, r[0], r[1], r[4], r[5]) for i, r in enumerate(rules)], "_i int, rule_id string, sets string, severity int, message string")
    # as many rows as there are rules
    return broken.join(F.broadcast(table), "_i").select("doc_id", "rule_id", "sets", "pre", "line", "col", "severity", "message")


def of_sets(found: DataFrame, docs: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """The violations of the set that a document's name asks for: the letter of the first prefix in ``prefixes`` that it begins with; without one it has no rules."""
    letter = F.lit(None).cast("string")
    for prefix, one in reversed(prefixes.items()):
        letter = F.when(F.col("name").startswith(prefix), one).otherwise(letter)
    chosen = docs.select("doc_id", letter.alias("_set")).where("_set IS NOT NULL")
    return found.join(chosen, "doc_id").where(F.contains(F.col("sets"), F.col("_set"))).drop("_set", "sets")
