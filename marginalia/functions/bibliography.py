"""Bibliography records: repair, sort keys, names, references and full entries.

A record is a row with ``key``, ``itemType``, ``shortTitle``, ``date``, ``extra``,
``creators`` (array of creatorType, firstName, lastName, name), ``tags`` and the
fields of its type; all texts may be null.
"""

from __future__ import annotations

import html
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import batched, sentence_case, squeeze

ANONYMOUS = "Anonymous"
CREATOR = "struct<creatorType:string,firstName:string,lastName:string,name:string>"
FIELDS = (
    "itemType string, shortTitle string, title string, date string, pages string, extra string, place string, publisher string, volume string, issue string, series string, seriesNumber string, edition string, "
    "publicationTitle string, bookTitle string, proceedingsTitle string, institution string, university string, thesisType string, reportType string, websiteTitle string, blogTitle string, repository string, DOI string, url string, "
    f"deleted string, creators array<{CREATOR}>, tags array<struct<tag:string>>"
)
RECORD = f"key string, version long, data struct<{', '.join(f.replace(' ', ':', 1) for f in FIELDS.split(', '))}>"
# Types of records that entries are made for.
ITEM_TYPES = ("book", "journalArticle", "conferencePaper", "report", "bookSection", "thesis", "webpage", "document", "blogPost", "newspaperArticle", "dataset")
# Units of a cited range, with abbreviations for one and for several.
UNITS = {"volume": ("vol.", "vols."), "appendix": ("appendix", "appendices"), "book": ("book", "books"), "section": ("§", "§§"), "page": ("p.", "pp."), "item": ("№", "№"), "figure": ("fig.", "figs."), "plate": ("plate", "plates"), "table": ("table", "tables"), "note": ("n.", "nn."), "part": ("part", "parts"), "entry": ("s.v.", "s.vv."), "line": ("l.", "ll.")}


def flat_records(df: DataFrame) -> DataFrame:
    """Rows of (key, version, data) with the fields of data beside the key."""
    return df.select("key", "version", "data.*")


def eligible_entries(df: DataFrame) -> DataFrame:
    """Records with a short title and a supported type that are not deleted (``data`` flattened)."""
    return df.where((F.coalesce(F.btrim("shortTitle"), F.lit("")) != "") & F.col("itemType").isin(*ITEM_TYPES) & F.col("deleted").isNull())


def extra_field(extra: Column, name: str) -> Column:
    """The value of a ``name: value`` line, name in any case."""
    return F.nullif(F.btrim(F.regexp_extract(F.coalesce(extra, F.lit("")), rf"(?im)^\s*{name}\s*:\s*(.*?)\s*$", 1)), F.lit(""))


def _unescaped(s: str) -> str:
    return unicodedata.normalize("NFC", html.unescape(s.replace("&nbsp;", " ")))


def unescape(c: Column) -> Column:
    """Composed text without character references, named or numbered; a hard space is a space."""
    return batched(_unescaped)(c)


def fix_record(df: DataFrame) -> DataFrame:
    """Composed, unescaped texts; hyphens in ranges; empty dates and publishers for n.d. and n.pub; shorthand and original date from ``extra``."""
    out = df
    for field in df.dtypes:
        if field[1] == "string" and field[0] not in ("key", "extra"):
            out = out.withColumn(field[0], unescape(F.col(field[0])))
    blank = lambda c, *words: F.when(F.lower(F.btrim(c)).isin(*words), F.lit(None)).otherwise(F.col(c))
    if "pages" in df.columns:
        out = out.withColumn("pages", F.replace("pages", F.lit("–"), F.lit("-")))
    if "publisher" in df.columns:
        out = out.withColumn("publisher", blank("publisher", "n.pub", "n.pub."))
    out = out.withColumn("date", F.replace(blank("date", "n.d", "n.d."), F.lit("–"), F.lit("-")))
    return out.withColumns({"shorthand": extra_field(F.col("extra"), "shorthand"), "original_date": extra_field(F.col("extra"), "original ?date")})


def person(x: Column, order: str) -> Column:
    """A creator's name: ``index`` with the last name in front, ``natural``, or ``short``, the last name alone.

    A first name without a last one stands beside "Anonymous"; without either the single name counts."""
    first, last = (F.nullif(x[c], F.lit("")) for c in ("firstName", "lastName"))
    if order == "short":
        return F.coalesce(last, _name(x))
    known = F.coalesce(last, F.when(first.isNotNull(), F.lit(ANONYMOUS)))
    both = F.concat_ws(", ", known, first) if order == "index" else F.concat_ws(" ", first, known)
    return F.when(known.isNotNull(), both).otherwise(_name(x))


def _some(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _name(x: Column) -> Column:
    return F.when(_some(x["name"]), x["name"]).otherwise(F.lit(ANONYMOUS))


def with_and(names: Column) -> Column:
    """a; a and b; a, b and c."""
    n = F.size(names)
    head = F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 0, F.lit(None)).when(n == 1, names[0]).otherwise(F.concat_ws(" and ", head, F.element_at(names, -1)))


def creators_text(creators: Column, style: str = "front") -> Column:
    """Names in a row: ``front`` puts the first one's last name in front, ``back`` none; anonymous where there is none."""
    creators = F.coalesce(creators, F.array().cast(f"array<{CREATOR}>"))
    if style == "front":
        names = F.transform(creators, lambda x, i: F.when(i == 0, person(x, "index")).otherwise(person(x, "natural")))
    else:
        names = F.transform(creators, lambda x: person(x, "natural"))
    return F.coalesce(with_and(names), F.lit(ANONYMOUS))


def of_types(creators: Column, *types: str) -> Column:
    return F.filter(F.coalesce(creators, F.array().cast(f"array<{CREATOR}>")), lambda x: x["creatorType"].isin(*types))


def shown_date(date: Column, original: Column) -> Column:
    """The date, with that of the original in brackets before it; N.d. where there is none."""
    dashed = lambda c: F.replace(c, F.lit("-"), F.lit("–"))
    return F.concat_ws(" ", F.concat(F.lit("["), dashed(original), F.lit("]")), F.coalesce(dashed(F.nullif(date, F.lit(""))), F.lit("N.d.")))


def short_reference(df: DataFrame, name: str = "reference") -> DataFrame:
    """A 2001; A and B 2001; A et al. 2001. Parts of a book or journal are not named after its editors."""
    part = F.col("itemType").isin("bookSection", "journalArticle")
    who = F.when(part, of_types(F.col("creators"), "author")).otherwise(of_types(F.col("creators"), "author", "editor", "bookAuthor"))
    names = F.transform(who, lambda x: person(x, "short"))
    n = F.size(names)
    text = F.when(n == 0, F.lit(ANONYMOUS)).when(n == 1, names[0]).when(n == 2, F.concat_ws(" and ", names[0], names[1])).otherwise(F.concat(names[0], F.lit(" et al.")))
    return df.withColumn(name, F.concat_ws(" ", text, shown_date(F.col("date"), F.col("original_date"))))


def sort_key(df: DataFrame, name: str = "sort_key") -> DataFrame:
    """Shorthand, or the first creator's last or single name and the date, then the key; null for unsupported types.

    Parts of books and articles are not sorted by their editors or the book's authors."""
    part = F.col("itemType").isin("bookSection", "journalArticle")
    who = F.filter(F.coalesce(F.col("creators"), F.array().cast(f"array<{CREATOR}>")), lambda x: ~(part & x["creatorType"].isin("editor", "bookAuthor")))
    first = F.when(F.size(who) > 0, F.concat_ws(" ", F.coalesce(F.nullif(who[0]["lastName"], F.lit("")), who[0]["name"], F.lit("")), F.coalesce("date", F.lit(""))))
    key = F.concat_ws(" ", F.coalesce(F.col("shorthand"), first, F.lit("")), F.col("key"))
    return df.withColumn(name, F.when(F.col("itemType").isin(*ITEM_TYPES), key))


def period(c: Column) -> Column:
    """End with a full stop unless a stop, ? or ! already ends it, closing marks aside."""
    return F.when(c.rlike(r"[.?!][^\p{L}\p{N}.?!]*$"), c).otherwise(F.concat(c, F.lit(".")))


def several(c: Column) -> Column:
    return c.rlike("[,\\-–—]")


def cited_ranges(ranges: Column) -> Column:
    """(unit, value) pairs as text: abbreviated units, plural where the value is a list or range; ``mixed`` has no unit."""
    one = F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, v[0])])
    many = F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, v[1])])

    def shown(r: Column) -> Column:
        value = F.when(r["unit"] == "page", F.replace(r["value"], F.lit("-"), F.lit("–"))).otherwise(r["value"])
        unit = F.when(several(r["value"]), F.try_element_at(many, r["unit"])).otherwise(F.try_element_at(one, r["unit"]))
        return F.when(r["unit"] == "mixed", value).otherwise(F.concat_ws(" ", unit, value))

    return F.array_join(F.transform(ranges, shown), ", ")


def doi(c: Column) -> Column:
    """A DOI from its ``10.`` on; null where there is none at the start of a path segment."""
    path = F.btrim(F.regexp_replace(F.regexp_replace(c, r"^[a-zA-Z]+://[^/]*", ""), r"[?#].*$", ""), F.lit("/"))
    return F.nullif(F.regexp_extract(path, r"(?:^|/)(10\..*)$", 1), F.lit(""))


def ordinal_edition(c: Column) -> Column:
    """1st edition, 2nd edition, …; what is no number stays."""
    n = F.btrim(c)
    suffix = F.when(n == "1", "st").when(n == "2", "nd").when(n == "3", "rd").otherwise("th")
    return F.when(n.rlike("^[0-9]+$"), F.concat(n, suffix, F.lit(" edition"))).otherwise(F.nullif(n, F.lit("")))


def _field(df: DataFrame, name: str) -> Column:
    return F.nullif(F.btrim(F.col(name)), F.lit("")) if name in df.columns else F.lit(None).cast("string")


def entry_text(df: DataFrame, name: str = "entry") -> DataFrame:
    """The full entry of each record by its type; null for unsupported types."""
    f = lambda n: _field(df, n)
    quoted = F.coalesce(F.concat(F.lit("“"), period(f("title")), F.lit("”")), F.lit("Untitled."))
    creators = F.col("creators")
    front = F.when(f("shorthand").isNotNull(), period(f("shorthand"))).otherwise(
        F.concat_ws(" ", period(creators_text(of_types(creators, "author", "editor", "bookAuthor"))), period(shown_date(F.col("date"), F.col("original_date"))))
    )
    authors_only = F.when(f("shorthand").isNotNull(), period(f("shorthand"))).otherwise(F.concat_ws(" ", period(creators_text(of_types(creators, "author"))), period(shown_date(F.col("date"), F.col("original_date")))))
    credit = lambda kind, words: F.when(F.size(of_types(creators, kind)) > 0, period(F.concat_ws(" ", F.lit(words), creators_text(of_types(creators, kind), "back"))))
    pages = F.when(f("pages").isNotNull(), F.concat(F.when(several(f("pages")), F.lit("pp. ")).otherwise(F.lit("p. ")), F.replace(f("pages"), F.lit("-"), F.lit("–"))))
    late_date = F.when(f("shorthand").isNotNull() & f("date").isNotNull(), shown_date(F.col("date"), F.col("original_date")))
    published = period(F.concat_ws(", ", F.concat_ws(": ", F.coalesce(f("place"), F.lit("No place")), f("publisher")), late_date, pages))
    series = F.when(f("series").isNotNull(), period(F.concat_ws(" ", f("series"), f("seriesNumber"))))
    volume = F.when(f("volume").isNotNull(), F.concat(F.lit("Vol. "), f("volume")))
    issue = F.when(f("issue").isNotNull(), F.concat(F.lit("("), f("issue"), F.lit(")")))
    edition = F.when(ordinal_edition(f("edition")).isNotNull(), period(ordinal_edition(f("edition"))))
    ident = F.when(doi(f("DOI")).isNotNull(), F.concat(F.lit("DOI: "), doi(f("DOI")), F.lit(".")))
    links = F.when(f("url").isNotNull(), F.concat(F.lit("URL: "), F.array_join(F.transform(F.split(f("url"), r"\s+"), lambda u: F.rtrim(u, F.lit(";"))), "; "), F.lit(".")))
    title, tail = period(F.coalesce(f("title"), F.lit("Untitled"))), F.concat_ws(" ", ident, links)
    inside = lambda where: period(F.concat_ws(", ", F.concat(F.lit("In: "), where), volume))
    journal = period(F.concat_ws(", ", F.concat_ws(" ", f("publicationTitle"), f("volume"), issue), pages))
    layouts = {
        "book": (front, title, credit("bookAuthor", "By"), volume, series, edition, published),
        "journalArticle": (authors_only, quoted, journal),
        "newspaperArticle": (authors_only, quoted, journal),
        "bookSection": (authors_only, quoted, inside(f("bookTitle")), credit("bookAuthor", "By"), credit("editor", "Edited by"), series, edition, published),
        "conferencePaper": (authors_only, quoted, inside(F.coalesce(f("proceedingsTitle"), f("title"))), credit("editor", "Edited by"), series, published),
        "report": (front, title, period(F.concat_ws(", ", f("reportType"), f("institution"), f("place")))),
        "thesis": (front, title, period(F.concat_ws(", ", F.coalesce(f("thesisType"), F.lit("Thesis")), f("university"), f("place")))),
        "webpage": (front, quoted, period(F.coalesce(f("websiteTitle"), F.lit("Web page")))),
        "blogPost": (front, quoted, period(F.coalesce(f("blogTitle"), F.lit("Blog")))),
        "document": (front, title, period(F.coalesce(f("publisher"), F.lit("Document")))),
        "dataset": (front, title, period(F.coalesce(f("repository"), F.lit("Dataset")))),
    }
    text = F.lit(None).cast("string")
    for kind, parts in layouts.items():
        text = F.when(F.col("itemType") == kind, squeeze(F.concat_ws(" ", *parts, tail))).otherwise(text)
    return df.withColumn(name, text)


def unnest_creators(df: DataFrame) -> DataFrame:
    """(key, place, creatorType, firstName, lastName, name): one row for each creator."""
    return df.select("key", F.posexplode("creators").alias("place", "creator")).select("key", "place", "creator.*")


def unnest_tags(df: DataFrame) -> DataFrame:
    """(key, tag): one row for each tag."""
    return df.select("key", F.explode("tags.tag").alias("tag"))
