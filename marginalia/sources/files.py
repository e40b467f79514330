"""Reading corpora: files, headed tables, XML records, crawled pages and survey reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marginalia.functions.bibliography import RECORD
from marginalia.functions.text import nfc, to_boolean


def scan_corpus(spark: SparkSession, path: str, prefixes: Sequence[str] = (), deny: Sequence[str] = ()) -> DataFrame:
    """XML files below ``path``: no hidden folders or denied names, only given name prefixes, no templates."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[xX][mM][lL]").load(path)
    inner = F.regexp_replace(F.col("path"), r"^[^:]*:/*", "/")
    name = F.element_at(F.split(inner, "/"), -1)
    keep = ~inner.rlike(r"/\.[^/]") & ~F.lower(name).contains("template")
    for folder in deny:
        keep &= ~F.concat(inner, F.lit("/")).contains(f"/{folder}/")
    if prefixes:
        keep &= F.coalesce(*[F.when(name.startswith(p), True) for p in prefixes], F.lit(False))
    return files.where(keep)


def with_file_facts(df: DataFrame) -> DataFrame:
    """Add name (base name without extension), mtime in seconds, and the text: composed, null unless valid UTF-8."""
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    return df.withColumns({"name": F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1), "mtime": F.unix_timestamp("modificationTime"), "text": nfc(F.when(valid, F.decode("content", "UTF-8")))})


def read_tsv(spark: SparkSession, path: str, fields: Sequence[str] | None = None) -> DataFrame:
    """A headed TSV, cells trimmed, short rows padded with empty text; a row with too many cells is an error."""
    lines = spark.read.text(path)
    if fields is None:
        fields = [f.strip() for f in (lines.first() or [""])[0].split("\t")]
    header = "\t".join(fields)
    cells = F.split("value", "\t", -1)
    rows = lines.where((F.regexp_replace("value", r"[ ]*\t[ ]*", "\t") != header) & (F.btrim("value") != ""))
    checked = F.when(F.size(cells) <= len(fields), cells).otherwise(F.raise_error(F.concat(F.lit("too many cells: "), F.col("value"))).cast("array<string>"))
    return rows.select(checked.alias("c")).select(*[F.btrim(F.coalesce(F.get("c", F.lit(i)), F.lit(""))).alias(f) for i, f in enumerate(fields)])


def read_typed_tsv(spark: SparkSession, path: str, schema: StructType, key: str) -> DataFrame:
    """A TSV with cells cast to a schema; booleans as words; keys must not repeat."""
    df = read_tsv(spark, path, schema.names)
    typed = df.select(*[(to_boolean(F.col(f.name)) if f.dataType.simpleString() == "boolean" else F.nullif(F.col(f.name), F.lit("")).cast(f.dataType)).alias(f.name) for f in schema])
    return assert_unique(typed, key)


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """The same rows; running them fails if a key repeats."""
    n = F.count("*").over(Window.partitionBy(key))
    return df.withColumn("_n", n).withColumn(key, F.when(F.col("_n") == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"duplicate {key}: "), F.col(key).cast("string"))).cast(df.schema[key].dataType))).drop("_n")


def explode_names(df: DataFrame, column: str, defaults: dict[str, str]) -> DataFrame:
    """One row for each name in a space-separated cell; empty cells take the value of another column (``defaults``)."""
    out = df.withColumn(column, F.explode(F.split(F.btrim(column), r"\s+")))
    for empty, other in defaults.items():
        out = out.withColumn(empty, F.coalesce(F.nullif(F.btrim(empty), F.lit("")), F.col(other)))
    return assert_unique(out, column)


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """(name, text, description, search): symbols by each of their names."""
    return explode_names(read_tsv(spark, path, ["names", "text", "description", "search"]), "names", {"search": "text", "description": "names"}).withColumnRenamed("names", "name")


def read_bibliography(spark: SparkSession, path: str) -> DataFrame:
    """(key, version, data) of a file with one JSON record a line; broken lines are dropped."""
    return spark.read.text(path).select(F.from_json("value", RECORD).alias("r")).select("r.*").where("key IS NOT NULL")


def dump_sorted_json(df: DataFrame, key: str, path: str) -> None:
    """One JSON object a line, ordered by key over all files."""
    df.orderBy(key).select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def read_xml_records(spark: SparkSession, path: str, row_tag: str, schema: StructType | str) -> DataFrame:
    """Records of an XML file by their element, split and parsed in parallel."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def members(spark: SparkSession, path: str) -> DataFrame:
    """(person_id, name array, …) of a list of people with one or two name parts."""
    person = "`_xml:id` string, `_id` string, idno array<struct<_type:string,_VALUE:string>>, persName struct<forename:string,surname:string,name:string>"
    rows = read_xml_records(spark, path, "person", person)
    names = F.filter(F.array("persName.forename", "persName.surname", "persName.name"), lambda x: x.isNotNull())
    return rows.select(F.coalesce("`_xml:id`", "_id").alias("person_id"), names.alias("name"), F.map_from_entries(F.transform("idno", lambda i: F.struct(i["_type"], i["_VALUE"]))).alias("ids"))


def script_tree(nodes: DataFrame) -> DataFrame:
    """(id, aliases, name, parent) of nested ``script`` elements given as a node table."""
    scripts = nodes.where("tag = 'script'")
    ids = nodes.where("tag = 'id'").groupBy("doc_id", F.col("parent").alias("pre")).agg(F.sort_array(F.collect_list(F.struct("pre", "text"))).alias("ids"))
    named = scripts.join(ids, ["doc_id", "pre"]).select("doc_id", "pre", "parent", F.transform("ids", lambda x: F.btrim(x["text"])).alias("aliases"), F.col("attrs")["name"].alias("name"))
    up = named.select("doc_id", F.col("pre").alias("parent"), F.col("aliases")[0].alias("parent_id"))
    return named.join(up, ["doc_id", "parent"], "left").select(F.col("aliases")[0].alias("id"), "aliases", F.coalesce("name", F.col("aliases")[0]).alias("name"), F.col("parent_id").alias("parent"))


def merge_vocabularies(base: DataFrame, names: DataFrame, families: DataFrame, own: DataFrame) -> DataFrame:
    """The language catalogue: (id, name, inverted_name, iso, custom, codes).

    ``base`` is (Id, Part2b, Part2t, Part1, Ref_Name), ``names`` (Id, Print_Name,
    Inverted_Name), ``families`` (code, label), ``own`` (Id, Print_Name,
    Inverted_Name). Own entries override names; ids known to no standard are custom."""
    listed = base.select(F.col("Id").alias("id"), F.array_distinct(F.filter(F.array("Id", "Part2b", "Part2t", "Part1"), lambda x: F.coalesce(x, F.lit("")) != "")).alias("codes"), F.col("Ref_Name").alias("ref"), F.lit(3).alias("iso"))
    groups = families.select(F.col("code").alias("id"), F.array("code").alias("codes"), F.col("label").alias("ref"), F.lit(5).alias("iso"))
    known = listed.unionByName(groups).groupBy("id").agg(F.min_by("codes", "iso").alias("codes"), F.min_by("ref", "iso").alias("ref"), F.min("iso").alias("iso"))
    one = lambda df, a, b: df.groupBy(F.col("Id").alias("id")).agg(F.min(F.struct("Print_Name", "Inverted_Name")).alias("n")).select("id", F.col("n.Print_Name").alias(a), F.col("n.Inverted_Name").alias(b))
    all_ = known.join(one(names, "p", "i"), "id", "left").join(one(own, "op", "oi"), "id", "full_outer")
    return all_.select("id", F.coalesce("op", "p", "ref").alias("name"), F.coalesce("oi", "i", "op", "ref").alias("inverted_name"), "iso", F.col("iso").isNull().alias("custom"), F.coalesce("codes", F.array("id")).alias("codes"))


def code_aliases(catalogue: DataFrame) -> DataFrame:
    """(code, id) of every code; the smallest id has a code that several claim."""
    return catalogue.select(F.explode("codes").alias("code"), "id").groupBy("code").agg(F.min("id").alias("id"))


def with_parents(catalogue: DataFrame, parents: DataFrame, root: str) -> DataFrame:
    """Add ``parent``: as given by (id, parent), else the root; the root has none."""
    out = catalogue.join(parents.select("id", F.col("parent").alias("_p")), "id", "left")
    return out.withColumn("parent", F.when(F.col("id") == root, F.lit(None).cast("string")).otherwise(F.coalesce("_p", F.lit(root)))).drop("_p")


def marked_segments(df: DataFrame, key: str, text: str, start: str, end: str) -> DataFrame:
    """(key, entry, body): the lines of a text between a line like ``start`` and the next like ``end``, joined."""
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("at", "line"))
    order = Window.partitionBy(key).orderBy("at")
    opened = lines.withColumn("entry", F.sum(F.col("line").rlike(start).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    opened = opened.withColumn("shut", F.sum((F.col("line").rlike(end) & ~F.col("line").rlike(start)).cast("int")).over(Window.partitionBy(key, "entry").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    inside = opened.where((F.col("entry") > 0) & (F.col("shut") == 0) & ~F.col("line").rlike(start))
    return inside.groupBy(key, "entry").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("body"))


def page_facts(url: Column) -> tuple[Column, Column]:
    """Dictionary and page number from a crawled page's URL: what stands before ``_query.py``, and after the last equals sign."""
    return F.regexp_extract(url, r"/([^/]+)_query\.py", 1), F.nullif(F.regexp_extract(url, r"=(\d+)$", 1), F.lit("")).cast("int")


def carry_header_state(df: DataFrame, part: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Fill nulls of header columns with the last value before them in document order."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def survey_identifiers(df: DataFrame) -> DataFrame:
    """(…, identifier, in_order): header state carried on, an identifier from it, and whether pages do not fall."""
    filled = carry_header_state(df, ["doc_id"], ["pos"], ["volume", "years", "page"])
    before = F.lag("page").over(Window.partitionBy("doc_id", "volume").orderBy("pos"))
    return filled.withColumns({"identifier": F.concat_ws("/", "years", "volume", "n"), "in_order": F.coalesce(before <= F.col("page"), F.lit(True))})
